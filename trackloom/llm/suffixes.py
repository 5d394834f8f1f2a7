"""Suffix-array dedup: repeated strings from merged shard Burrows-Wheeler transforms.

A byte goes if some string of ``WINDOW`` bytes that covers it also starts in a document
with a smaller id.  Strings are judged on the input; overlaps count; matches never cross
documents.

Finding what may repeat (exact, nothing is lost).  The 24-byte substring with the smallest
hash in a window is its anchor; equal windows have equal anchors.  Consecutive windows with
one anchor form a segment.  Texts are packed into chunks of about ``CHUNK`` bytes; each chunk
sends its distinct anchor hashes, as sorted blobs, to buckets of the hash range, and gets
back one bit for each: does it occur in two documents?  Only segments whose anchor does
go on; each chunk sends every distinct one once, with the smallest id that has it, to a
bucket of its anchor.  A passage that a third of all documents share so arrives once per
chunk, not once per document.  A chunk sends to at most ``FAN`` buckets.  Where there must be
more (from about 16 GB on) they are coarse ones: the rows of a coarse bucket from a group of chunks
are merged, equal ones collapse, and the merged rows are split over the fine buckets; the
answers come back the same way.  So blobs never shrink below a few KB, and what all chunks
share arrives in its bucket once per group.

Sorting.  In a bucket equal segments collapse.  An anchor with one segment left is settled:
its windows repeat as a whole.  The others' segments stand in shards, runs of chunks of the
corpus.  Each shard sorts its suffixes to ``WINDOW`` bytes in steps of ``STEP`` bytes and keeps, for each depth, the
string of the STEP bytes before each suffix in that order: its transform at that depth.  The
shards' transforms are then merged by refining an interleave (which shard supplies the next
suffix): starting from all of shard 0, all of shard 1 and so on, each round deals the
interleave's entries by one stable counting pass over the merged transform, which makes it
right for STEP bytes more.  Only shard numbers move; suffixes are never sorted again.  Boundaries between suffixes
whose prefixes differ are carried along, so after the last round the runs between
boundaries are the intervals of equal windows (common prefix >= WINDOW), and each takes
the smallest id among its segments.

Back in the chunk a window is marked if its interval's smallest id is below the document's.

Nulls: a null text is empty; a null id counts as larger than all others, so such rows lose
what others have and take nothing away.  Texts under WINDOW bytes lose nothing.  Rows with
equal ids never take from each other.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, cut, release, ship
from .shingles import _P, _PINV, _powers, mix64

WINDOW = 50
GRAM = 24
STEP = 2
SHARDS = 4
CHUNK = 4 << 20
MOST_DOCS = 65_535
PIECE = 1 << 19
LONGEST = 64
HASH_BITS = 48
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 32
FAN = 4096
NO_ID = (1 << 63) - 1


# ---------------------------------------------------------------- chunks


def _pack(ids: list[np.ndarray], texts: list[bytes]) -> tuple:
    raw = b"".join(texts)
    codec = pa.Codec("zstd", compression_level=1)
    return np.concatenate(ids).astype(np.int64), np.array([len(t) for t in texts], np.int64), codec.compress(raw, asbytes=True), len(raw)


CHUNKED = "ids binary, lens binary, body binary, n_bytes long"


def _chunks(batches):
    ids, texts, size = [], [], 0

    def flush():
        a, b, c, n = _pack(ids, texts)
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()]), pa.array([c]), pa.array([n], pa.int64())], names=["ids", "lens", "body", "n_bytes"])

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
            t = t or b""
            if texts and (size + len(t) > CHUNK or len(texts) >= MOST_DOCS):
                yield flush()
                ids, texts, size = [], [], 0
            ids.append(np.array([NO_ID if i is None else i], np.int64))
            texts.append(t)
            size += len(t)
    if texts:
        yield flush()


class Chunk:
    """The documents of a chunk and the segments of their windows."""

    def __init__(self, ids: bytes, lens: bytes, body: bytes, n: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lens, np.int64))])
        self.data = np.frombuffer(pa.Codec("zstd").decompress(body, n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
        starts, sizes, hashes, content = [], [], [], []
        with np.errstate(over="ignore"):
            for a in range(0, max(0, len(self.data) - WINDOW + 1), PIECE):
                for out, x in zip((starts, sizes, hashes, content), self._piece(a)):
                    out.append(x)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.start, self.size = cat(starts, np.int64), cat(sizes, np.int64)
        self.anchor, self.content = cat(hashes, np.uint64), cat(content, np.uint64)
        per_doc = np.diff(np.searchsorted(self.start, self.offsets))
        self.doc = np.repeat(np.arange(len(self.ids)), per_doc)

    def _piece(self, a: int):
        """Segments of the windows that start in [a, a + PIECE)."""
        d = self.data[a : a + PIECE + WINDOW - 1]
        n = len(d) - WINDOW + 1  # windows
        total = np.zeros(len(d) + 1, np.uint64)
        np.cumsum((d.astype(np.uint64) + np.uint64(7)) * _powers(_P, len(d) + 1, "p")[: len(d)], out=total[1:])
        inv = _powers(_PINV, len(d) + 1, "q")
        m = mix64((total[GRAM:] - total[:-GRAM]) * inv[: len(d) - GRAM + 1])
        span, w = WINDOW - GRAM + 1, 1
        while 2 * w <= span:  # minimum over span positions by doubling
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        if span > w:
            m = np.minimum(m[: -(span - w)], m[span - w :])
        m = m[:n]
        # windows that would leave their document
        step = np.zeros(n + 1, np.int32)
        lo, hi = np.searchsorted(self.offsets, [a, a + n + WINDOW])
        ends, begins = self.offsets[max(1, lo) : hi + 1], self.offsets[max(1, lo) - 1 : hi]
        k = min(len(ends), len(begins))
        np.add.at(step, np.clip(np.maximum(ends[:k] - WINDOW + 1, begins[:k]) - a, 0, n), 1)
        np.add.at(step, np.clip(ends[:k] - a, 0, n), -1)
        ok = np.cumsum(step[:n]) == 0
        new = np.ones(n, bool)
        new[1:] = (m[1:] != m[:-1]) | ~ok[:-1]
        s = np.flatnonzero(new & ok)
        last = np.ones(n, bool)
        last[:-1] = (m[1:] != m[:-1]) | ~ok[1:]
        e = np.flatnonzero(last & ok) + 1
        size = e - s
        if len(size) and size.max() > LONGEST:
            parts = -(-size // LONGEST)
            j = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            s, e = np.repeat(s, parts) + j * LONGEST, np.minimum(np.repeat(s, parts) + (j + 1) * LONGEST, np.repeat(e, parts))
            size = e - s
        to = e + WINDOW - 1
        content = mix64(mix64((total[to] - total[s]) * inv[s]) + size.astype(np.uint64))
        # minima are small numbers: hashed again, so that buckets of the hash range are even
        return s + a, size, mix64(m[s] ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - HASH_BITS), content

    def distinct_anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct anchor hashes, is it in two documents of this chunk)."""
        key = np.sort((self.anchor << np.uint64(16)) | self.doc.astype(np.uint64))
        h = key >> np.uint64(16)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        last = (np.append(first[1:], len(h)) - 1)[: len(first)]  # none if all texts are shorter than a window
        # rows that share an id are one document here only if they share the row; a few candidates more do no harm
        return h[first], key[first] != key[last]

    def keep_repeated(self, masks: list[bytes], buckets: int) -> None:
        """Keep the segments whose anchor occurs in two documents, and collapse equal ones."""
        h, _ = self.distinct_anchors()
        cuts = np.searchsorted(h, _edges(buckets))
        bits = np.zeros(len(h), bool)
        for p, mask in masks:
            bits[cuts[p] : cuts[p + 1]] = np.unpackbits(np.frombuffer(mask, np.uint8), count=cuts[p + 1] - cuts[p], bitorder="little").astype(bool)
        rep = h[bits]
        at = np.minimum(np.searchsorted(rep, self.anchor), max(0, len(rep) - 1))
        on = rep[at] == self.anchor if len(rep) else np.zeros(len(self.anchor), bool)
        self.start, self.size, self.anchor, self.content, self.doc = (x[on] for x in (self.start, self.size, self.anchor, self.content, self.doc))
        #: one row for each distinct (anchor, content), sorted by anchor, so buckets are ranges
        order = np.lexsort((self.ids[self.doc], self.content, self.anchor))
        a, c = self.anchor[order], self.content[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]) if len(a) else np.zeros(0, bool)
        self.one = order[new]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.cuts = np.searchsorted(self.anchor[self.one], _edges(buckets))


def _edges(buckets: int) -> np.ndarray:
    return np.append(np.arange(buckets, dtype=np.uint64) << np.uint64(HASH_BITS - (buckets - 1).bit_length()), np.uint64((1 << HASH_BITS)))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... of ranges of the given sizes."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else np.zeros(0, np.int64)


def _binary(xs: list[bytes]) -> pa.Array:
    return pa.array(xs, pa.binary())


# ---------------------------------------------------------------- which anchors repeat


def _send_anchors(buckets: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                h, twice = Chunk(r["ids"], r["lens"], r["body"], r["n_bytes"]).distinct_anchors()
                cuts = np.searchsorted(h, _edges(buckets))
                p = np.flatnonzero(np.diff(cuts))
                parts = [(h[cuts[k] : cuts[k + 1]], twice[cuts[k] : cuts[k + 1]]) for k in p]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p, pa.int32()), pa.array([r["chunk"]] * len(p), pa.int64()),
                        _binary([_pack_anchors(x) for x, _ in parts]), _binary([_bits(t) for _, t in parts]),
                    ],
                    names=["p", "chunk", "hashes", "twice"],
                )

    return run


def _unpack_anchors(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    hashes, twice = [], []
    for x, t in zip(table.column("hashes").to_pylist(), table.column("twice").to_pylist()):
        n = len(x) // 6
        hashes.append((np.frombuffer(x, np.uint16, n).astype(np.uint64) << np.uint64(32)) | np.frombuffer(x, np.uint32, n, 2 * n))
        twice.append(np.unpackbits(np.frombuffer(t, np.uint8), count=n, bitorder="little").astype(bool))
    return hashes, twice


def _merged(hashes: list[np.ndarray], twice: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of several rows, does it occur in two documents)."""
    every, flag = np.concatenate(hashes), np.concatenate(twice)
    order = np.argsort(every, kind="stable")
    every, flag = every[order], flag[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(every)))
    return every[first], (size > 1) | (np.add.reduceat(flag, first) > 0) if len(first) else np.zeros(0, bool)


def _isin(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, values), max(0, len(sorted_) - 1))
    return sorted_[at] == values if len(sorted_) else np.zeros(len(values), bool)


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x, bitorder="little").tobytes()


def _pack_anchors(h: np.ndarray) -> bytes:
    return (h >> np.uint64(32)).astype(np.uint16).tobytes() + h.astype(np.uint32).tobytes()


def _find_repeated(keys: tuple[str, ...]):
    """One bucket: for each of its rows, which of its anchors occur in two documents."""

    def run(table: pa.Table) -> pa.Table:
        hashes, twice = _unpack_anchors(table)
        every, rep = _merged(hashes, twice)
        masks = [_bits(_isin(h, every[rep])) for h in hashes]
        return pa.table({**{k: table.column(k) for k in keys}, "mask": _binary(masks)})

    return run


def _split_anchors(buckets: int):
    """The rows of a coarse bucket and a group of chunks as one set of anchors, dealt to the fine buckets."""

    def run(table: pa.Table) -> pa.Table:
        h, rep = _merged(*_unpack_anchors(table))
        cuts = np.searchsorted(h, _edges(buckets))
        f = np.flatnonzero(np.diff(cuts))
        one = lambda c: pa.array([table.column(c)[0].as_py()] * len(f), pa.int32())
        parts = [(h[cuts[k] : cuts[k + 1]], rep[cuts[k] : cuts[k + 1]]) for k in f]
        return pa.table({"f": pa.array(f, pa.int64()), "p": one("p"), "g": one("g"), "hashes": _binary([_pack_anchors(x) for x, _ in parts]), "twice": _binary([_bits(t) for _, t in parts])})

    return run


def _anchors_back(table: pa.Table, found: pa.Table) -> pa.Table:
    """The fine buckets' answers, told to each chunk of the group."""
    hashes, twice = _unpack_anchors(table)
    h, _ = _merged(hashes, twice)
    order = np.argsort(found.column("f").to_numpy())
    cuts, rep = [0], []
    for k in order.tolist():  # parts of the group's anchors, in order
        n = found.column("n")[k].as_py()
        rep.append(np.unpackbits(np.frombuffer(found.column("mask")[k].as_py(), np.uint8), count=n, bitorder="little").astype(bool))
        cuts.append(cuts[-1] + n)
    rep = h[np.concatenate(rep)] if rep else h[:0]
    return pa.table({"chunk": table.column("chunk"), "p": table.column("p"), "mask": _binary([_bits(_isin(x, rep)) for x in hashes])})


# ---------------------------------------------------------------- transforms and their merge


def _transform(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order of their first WINDOW bytes, transforms at depth 0, STEP, ...) of a circular text."""
    n = len(text)
    before = np.roll(text, 2).astype(np.uint16) << np.uint16(8) | np.roll(text, 1)
    order, levels = np.arange(n), []
    for _ in range(WINDOW // STEP):
        levels.append(before[order])
        order = (order[_deal(levels[-1])] - STEP) % n
    return order, levels


def _deal(symbols: np.ndarray) -> np.ndarray:
    """Stable order of 16-bit symbols: a counting pass (numpy's stable sort of such integers), linear in their number."""
    return np.argsort(symbols, kind="stable")


def merge_transforms(levels: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, interval of each entry) at depth WINDOW from the shards' transforms."""
    z = np.repeat(np.arange(len(levels), dtype=np.uint8), [len(x[0]) for x in levels])
    interval = np.zeros(len(z), np.int32)
    symbols = np.empty(len(z), np.uint16)
    for depth in range(WINDOW // STEP):
        # the entries of a shard, in the interleave's order, stand for its symbols one after the other
        symbols[_deal(z)] = np.concatenate([x[depth] for x in levels])
        order = _deal(symbols)
        z, old, dealt = z[order], interval[order], symbols[order]
        edge = np.zeros(len(z), bool)
        edge[1:] = (dealt[1:] != dealt[:-1]) | (old[1:] != old[:-1])
        interval = np.cumsum(edge, dtype=np.int32)
    return z, interval


def smallest_ids(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """For each window of each segment (in order) the smallest id whose segment holds that window.

    Segment i is text[starts[i] : starts[i] + sizes[i] + WINDOW - 1] with sizes[i] windows, of the corpus shard ``shard[i]``.
    """
    to = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(to[-1], np.int64)
    parts = []
    for which in np.unique(shard):
        rows = np.flatnonzero(shard == which)
        lens = sizes[rows] + WINDOW - 1
        body = np.zeros(lens.sum() + len(rows), np.uint8)  # each segment and a zero behind it
        at = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        body[_ragged(at, lens)] = text[_ragged(starts[rows], lens)]
        window = np.full(len(body), -1)  # the window, if the suffix starts one
        window[_ragged(at, sizes[rows])] = _ragged(to[rows], sizes[rows])
        order, levels = _transform(body)
        parts.append((window[order], levels))
    z, interval = merge_transforms([x for _, x in parts])
    window = np.empty(len(z), np.int64)
    for s, (w, _) in enumerate(parts):
        window[z == s] = w
    on = window >= 0
    window, interval = window[on], interval[on]
    mine = np.repeat(ids, sizes)[window]
    first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    least = np.minimum.reduceat(mine, first)
    out[window] = np.repeat(least, np.diff(np.append(first, len(interval))))
    return out


# ---------------------------------------------------------------- segments to buckets and back


def _pack_segments(anchor: np.ndarray, ids: np.ndarray, size: np.ndarray, text: np.ndarray) -> bytes:
    # anchors are sorted: their steps compress well
    return np.diff(anchor, prepend=np.uint64(0)).tobytes() + ids.tobytes() + size.astype(np.uint8).tobytes() + text.tobytes()


def _send_segments(buckets: int):
    def run(batches):
        codec = pa.Codec("zstd", compression_level=3)
        for b in batches:
            for r in b.to_pylist():
                c = Chunk(r["ids"], r["lens"], r["body"], r["n_bytes"])
                c.keep_repeated([(m["p"], m["mask"]) for m in r["masks"] or []], buckets)
                q = np.flatnonzero(np.diff(c.cuts))
                counts, packed, sizes = [], [], []
                for k in q:
                    one = c.one[c.cuts[k] : c.cuts[k + 1]]
                    text = c.data[_ragged(c.start[one], c.size[one] + WINDOW - 1)]
                    raw = _pack_segments(c.anchor[one], c.ids[c.doc[one]], c.size[one], text)
                    counts.append(len(one))
                    sizes.append(len(raw))
                    packed.append(codec.compress(raw, asbytes=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, pa.int32()), pa.array([r["chunk"]] * len(q), pa.int64()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), _binary(packed)],
                    names=["q", "chunk", "n", "n_bytes", "packed"],
                )

    return run


def _contents(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of segments."""
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for rows in np.array_split(np.arange(len(start)), max(1, len(text) // PIECE)):
            if len(rows):
                lo, hi = int(start[rows[0]]), int(start[rows[-1]] + size[rows[-1]]) + WINDOW - 1
                total = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum((text[lo:hi].astype(np.uint64) + np.uint64(7)) * _powers(_P, hi - lo + 1, "p")[: hi - lo], out=total[1:])
                s = start[rows] - lo
                e = s + size[rows] + WINDOW - 1
                out[rows] = mix64(mix64((total[e] - total[s]) * _powers(_PINV, hi - lo + 1, "q")[s]) + size[rows].astype(np.uint64))
    return out


class Segments:
    """The segments of several rows, in their order, and the distinct ones, sorted by (anchor, content), each with its smallest id."""

    def __init__(self, table: pa.Table):
        codec = pa.Codec("zstd")
        self.counts, parts = table.column("n").to_pylist(), []
        for n, n_bytes, packed in zip(self.counts, table.column("n_bytes").to_pylist(), table.column("packed").to_pylist()):
            raw = codec.decompress(packed, n_bytes, asbytes=True)
            parts.append((np.cumsum(np.frombuffer(raw, np.uint64, n)), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n), np.frombuffer(raw, np.uint8, -1, 17 * n)))
        self.anchor, self.ids, size, self.text = (np.concatenate(x) for x in zip(*parts))
        self.size = size.astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size + WINDOW - 1)[:-1]])
        content = _contents(self.text, self.start, self.size)
        order = np.lexsort((self.ids, content, self.anchor))
        a, c = self.anchor[order], content[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        self.one = order[new]  # the smallest id stands first
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def answers(self, runs_to: np.ndarray, run: np.ndarray, run_id: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
        """For each row the runs of its segments: how many each has, their lengths, their ids."""
        n_runs, out, lo = np.diff(runs_to), [], 0
        for k in self.counts:
            w = self.which[lo : lo + k]
            lo += k
            pick = _ragged(runs_to[w], n_runs[w])
            out.append((n_runs[w].astype(np.uint8).tobytes(), run[pick].tobytes(), run_id[pick].tobytes()))
        return out


ANSWER = ("n_runs", "runs", "run_ids")


def _settle(keys: tuple[str, ...]):
    """One bucket: for each row's segments, in order, the runs of windows with one smallest id."""

    def settle(table: pa.Table) -> pa.Table:
        x = Segments(table)
        # windows of the distinct segments, flat
        n, least = x.size[x.one], x.ids[x.one]
        to = np.concatenate([[0], np.cumsum(n)])
        found = np.repeat(least, n)
        same = x.anchor[x.one]
        both = np.zeros(len(x.one), bool)
        both[1:] = same[1:] == same[:-1]
        contested = np.flatnonzero(both | np.append(both[1:], False))
        if len(contested):
            # a shard is a run of chunks of the corpus; a collapsed segment stands in its first document's
            shard = np.repeat(np.arange(len(x.counts)) * SHARDS // len(x.counts), x.counts)[x.one[contested]]
            found[_ragged(to[contested], n[contested])] = smallest_ids(x.text, x.start[x.one[contested]], n[contested], least[contested], shard)
        # runs of one id within a segment
        edge = np.ones(len(found), bool)
        edge[1:] = found[1:] != found[:-1]
        edge[to[:-1]] = True
        at = np.flatnonzero(edge)
        out = x.answers(np.searchsorted(at, to), np.diff(np.append(at, len(found))).astype(np.uint8), found[at])
        return pa.table({**{k: table.column(k) for k in keys}, **{name: _binary([o[i] for o in out]) for i, name in enumerate(ANSWER)}})

    return settle


def _split_segments(buckets: int):
    """The rows of a coarse bucket and a group of chunks as one set of distinct segments, dealt to the fine buckets."""

    def run(table: pa.Table) -> pa.Table:
        x, codec = Segments(table), pa.Codec("zstd", compression_level=3)
        cuts = np.searchsorted(x.anchor[x.one], _edges(buckets))
        f = np.flatnonzero(np.diff(cuts))
        counts, sizes, packed = [], [], []
        for k in f:
            one = x.one[cuts[k] : cuts[k + 1]]
            raw = _pack_segments(x.anchor[one], x.ids[one], x.size[one], x.text[_ragged(x.start[one], x.size[one] + WINDOW - 1)])
            counts.append(len(one))
            sizes.append(len(raw))
            packed.append(codec.compress(raw, asbytes=True))
        same = lambda c: pa.array([table.column(c)[0].as_py()] * len(f), pa.int32())
        return pa.table({"f": pa.array(f, pa.int64()), "q": same("q"), "g": same("g"), "n": pa.array(counts, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "packed": _binary(packed)})

    return run


def _segments_back(table: pa.Table, settled: pa.Table) -> pa.Table:
    """The fine buckets' answers, told to each chunk of the group."""
    x = Segments(table)
    order = np.argsort(settled.column("f").to_numpy()).tolist()
    join = lambda name, t: np.concatenate([np.frombuffer(settled.column(name)[k].as_py(), t) for k in order] or [np.zeros(0, t)])
    runs_to = np.concatenate([[0], np.cumsum(join("n_runs", np.uint8).astype(np.int64))])
    out = x.answers(runs_to, join("runs", np.uint8), join("run_ids", np.int64))
    return pa.table({"chunk": table.column("chunk"), "q": table.column("q"), **{name: _binary([o[i] for o in out]) for i, name in enumerate(ANSWER)}})


DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _mark(buckets: int, with_text: bool):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                c = Chunk(r["ids"], r["lens"], r["body"], r["n_bytes"])
                c.keep_repeated([(m["p"], m["mask"]) for m in r["masks"] or []], buckets)
                settled = sorted(r["settled"] or [], key=lambda x: x["q"])
                join = lambda n, t: np.concatenate([np.frombuffer(x[n], t) for x in settled] or [np.zeros(0, t)])
                n_runs, runs, run_ids = join("n_runs", np.uint8).astype(np.int64), join("runs", np.uint8).astype(np.int64), join("run_ids", np.int64)
                first = np.concatenate([[0], np.cumsum(n_runs)[:-1]]).astype(np.int64)
                within = np.concatenate([[0], np.cumsum(runs)])
                size = len(c.data)
                step = np.zeros(size + 1, np.int32)
                e = c.entry
                pick = _ragged(first[e], n_runs[e]) if len(e) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(e)), n_runs[e]) if len(e) else pick
                gone = run_ids[pick] < c.ids[c.doc[owner]]
                pick, owner = pick[gone], owner[gone]
                begin = c.start[owner] + within[pick] - within[first[e[owner]]]
                np.add.at(step, begin, 1)
                np.add.at(step, begin + runs[pick] + WINDOW - 1, -1)
                np.cumsum(step, out=step)
                cover = step[:size] > 0
                lo, hi = c.offsets[:-1], c.offsets[1:]
                total = np.zeros(size + 1, np.int32 if size < 1 << 31 else np.int64)
                np.cumsum(cover, out=total[1:])
                rise = cover.copy()
                rise[1:] &= ~cover[:-1]
                starts = lo[(hi > lo)]
                rise[starts] = cover[starts]
                removed = (total[hi] - total[lo]).astype(np.int64)
                np.cumsum(rise, out=total[1:])
                spans = (total[hi] - total[lo]).astype(np.int64)
                del step, total, rise
                shas, kept = [], []
                for x, y, n in zip(lo.tolist(), hi.tolist(), removed.tolist()):
                    t = (c.data[x:y] if not n else c.data[x:y][~cover[x:y]]).tobytes()
                    shas.append(hashlib.sha256(t).hexdigest())
                    kept.append(t if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, mask=c.ids == NO_ID), pa.array(hi - lo), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas), _binary(kept)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def dedup(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    kept: the remaining bytes, null unless ``with_text``.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_batches(spark, 1000):
        chunks = cut(rows.mapInArrow(_chunks, CHUNKED).withColumn("chunk", F.monotonically_increasing_id()))
    size = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).head()[0]
    buckets = max(LEAST_BUCKETS, 1 << max(0, (size // BUCKET_BYTES)).bit_length())
    with arrow_batches(spark, 4):  # rows are chunks or parts of them
        return _dedup(chunks, buckets, with_text)


def _dedup(chunks: DataFrame, buckets: int, with_text: bool) -> DataFrame:
    coarse = min(buckets, FAN)
    anchors = chunks.mapInArrow(_send_anchors(coarse), "p int, chunk long, hashes binary, twice binary")
    answer = "n_runs binary, runs binary, run_ids binary"
    packed = "n long, n_bytes long, packed binary"
    if coarse == buckets:
        masks = anchors.groupBy("p").applyInArrow(_find_repeated(("chunk", "p")), "chunk long, p int, mask binary")
    else:
        anchors = cut(anchors.withColumn("g", _group(anchors, F.length("hashes"), coarse)))
        fine = anchors.groupBy("p", "g").applyInArrow(_split_anchors(buckets), "f long, p int, g int, hashes binary, twice binary")
        fine = cut(fine.withColumn("n", (F.length("hashes") / 6).cast("long")))
        found = fine.groupBy("f").applyInArrow(_find_repeated(("f", "p", "g", "n")), "f long, p int, g int, n long, mask binary")
        masks = anchors.groupBy("p", "g").cogroup(found.groupBy("p", "g")).applyInArrow(_anchors_back, "chunk long, p int, mask binary")
    masks = cut(masks.groupBy("chunk").agg(F.collect_list(F.struct("p", "mask")).alias("masks")))
    with_masks = chunks.join(masks, "chunk", "left")

    segments = with_masks.mapInArrow(_send_segments(coarse), f"q int, chunk long, {packed}")
    if coarse == buckets:
        settled = segments.groupBy("q").applyInArrow(_settle(("chunk", "q")), f"chunk long, q int, {answer}")
    else:
        segments = cut(segments.withColumn("g", _group(segments, F.col("n_bytes"), coarse)))
        fine = segments.groupBy("q", "g").applyInArrow(_split_segments(buckets), f"f long, q int, g int, {packed}")
        done = fine.groupBy("f").applyInArrow(_settle(("f", "q", "g")), f"f long, q int, g int, {answer}")
        settled = segments.groupBy("q", "g").cogroup(done.groupBy("q", "g")).applyInArrow(_segments_back, f"chunk long, q int, {answer}")
    settled = cut(settled.groupBy("chunk").agg(F.collect_list(F.struct("q", "n_runs", "runs", "run_ids")).alias("settled")))
    out = cut(with_masks.join(settled, "chunk", "left").mapInArrow(_mark(coarse, with_text), DONE))
    release(chunks, masks, settled)
    return out


def _group(rows: DataFrame, size, coarse: int):
    """The group of a chunk: so many that a group's rows of one coarse bucket have about ``BUCKET_BYTES``."""
    total = cut(rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n"))).head()[0]
    return F.pmod(F.xxhash64("chunk"), F.lit(max(1, -(-total // (coarse * BUCKET_BYTES))))).cast("int")


#: Windows of 50 bytes, the smallest id of each, and the islands that those of smaller ids cover.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents),
w AS (SELECT r, doc_id, i, b[i + 1 : i + {WINDOW}] AS g FROM (SELECT r, doc_id, b, unnest(range(octet_length(b) - {WINDOW - 1})) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS first_id FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, i FROM w JOIN least USING (g) WHERE first_id < coalesce(doc_id, {NO_ID})),
isle AS (SELECT r, i, sum(CASE WHEN i <= before + {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k
         FROM (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM hit)),
run AS (SELECT r, k, min(i) AS lo, max(i) + {WINDOW} AS hi FROM isle GROUP BY ALL),
edge AS (SELECT r, lo, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS done FROM (
         SELECT r, lo, hi FROM run UNION ALL SELECT r, octet_length(b), octet_length(b) FROM d)),
kept AS (SELECT r, unhex(string_agg(hex(b[done + 1 : lo]), '' ORDER BY lo)) AS b FROM edge JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, sum(hi - lo) AS n, count(*) AS spans FROM run GROUP BY r)
SELECT doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(kept.b) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)
"""
