"""Benchmark decontamination: SimHash of item-sized windows, exact weighted-shingle check.

For every benchmark item of w words, all windows of w words in a document are the
candidates; a document of fewer words is the one window itself.  A window whose weighted
5-word-shingle similarity (multiset Jaccard, the weights are the shingles' counts) with an
item reaches the threshold shares at least ``threshold * (item's shingles)`` shingle
occurrences with the items of its length, so only windows with that many hits in the table
of benchmark shingles get a fingerprint (a lossless sieve: a running sum per window length).

A window's SimHash is looked up in ``RADIUS + 1`` disjoint bit blocks: two fingerprints within
the radius agree in at least one of them, so every item within the radius is found
(``Items.near``) and verified by the exact similarity.  No radius is safe, though: an item cut
at an edge loses one shingle per word, so at the threshold a seventh of its words may differ
and its fingerprint can lie beyond any radius that still selects.  So the items of the
window's length that share enough shingles with it, but lie beyond the radius, are verified
in the same way (``Items.beyond``), and no item over the threshold is missed.

The benchmark side is shipped to the tasks in passes of about ``ITEMS_PER_PASS`` items and
``BYTES_PER_PASS`` bytes.  One pass is a lazy plan.  A larger benchmark is worked off pass by
pass, the findings of each written to a table before the next one's items are fetched, so
the driver and the tasks never hold more than one pass; documents are read once a pass.

Nulls: a null or empty text or item matches nothing.  Items with fewer than five words
count as one shingle of all their words.  Repeated items and documents each give their own
rows.  Extra columns are ignored by ``find`` and kept by ``clean``.  Either table may be empty.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, ship
from .shingles import N, mix64, slices, windows, words

THRESHOLD = 0.75
RADIUS = 15
BITS = 64
ITEMS_PER_PASS = 20_000
BYTES_PER_PASS = 32 << 20
_LOW = np.uint64((1 << 22) - 1)


def simhash(word_hashes: np.ndarray) -> int:
    """SimHash of a bag of words; repeats weigh more."""
    bits = np.unpackbits(mix64(word_hashes ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = bits.sum(axis=0, dtype=np.int64) * 2 - len(word_hashes)
    return int(np.packbits(votes > 0, bitorder="little").view(np.uint64)[0])


class Items:
    """The benchmark items of one pass, ready for lookups."""

    def __init__(self, ids: list, texts: list, threshold: float, radius: int):
        self.threshold, self.radius = threshold, radius
        self.ids, self.shingles, self.size, self.count, prints, need = [], [], [], [], [], []
        with np.errstate(over="ignore"):
            for item, text in zip(ids, texts):
                for _, data, offsets in slices(pa.array([text], pa.large_string())):
                    _, _, h, first = words(data, offsets)
                    if len(h):
                        w, _ = windows(h, first)
                        self.ids.append(item)
                        self.shingles.append(Counter(w.tolist()))
                        self.size.append(len(h))
                        self.count.append(len(w))
                        prints.append(simhash(h))
                        need.append(len(w))
        self.prints = np.array(prints, np.uint64)
        self.table = np.unique(np.array([s for c in self.shingles for s in c], np.uint64))
        self.sieve = np.zeros(int(_LOW) + 1, bool)
        self.sieve[(self.table & _LOW).astype(np.int64)] = True
        #: shingle -> lengths of the items that hold it
        of = defaultdict(set)
        for size, c in zip(self.size, self.shingles):
            for x in c:
                of[x].add(size)
        self.sizes_of = {x: sorted(v) for x, v in of.items()}
        #: shingle -> the items that hold it
        self.holders: dict[int, list[int]] = defaultdict(list)
        for i, c in enumerate(self.shingles):
            for x in c:
                self.holders[x].append(i)
        #: window length -> least number of shared shingle occurrences
        self.least: dict[int, int] = {}
        for size, n in zip(self.size, need):
            n = max(1, int(np.ceil(threshold * n - 1e-9)))
            self.least[size] = min(n, self.least.get(size, n))
        # radius + 1 disjoint blocks of bits: by the pigeonhole principle one agrees within the radius
        edges = np.linspace(0, BITS, radius + 2).astype(int)
        self.blocks = [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:])]
        self.index: list[dict[int, list[int]]] = []
        for a, n in self.blocks:
            by = defaultdict(list)
            for i, p in enumerate(prints):
                by[(p >> a) & ((1 << n) - 1)].append(i)
            self.index.append({k: np.array(v) for k, v in by.items()})

    def near(self, fingerprint: int) -> np.ndarray:
        """All items whose fingerprint is within the radius."""
        found = [x for (a, n), by in zip(self.blocks, self.index) if (x := by.get((fingerprint >> a) & ((1 << n) - 1))) is not None]
        if not found:
            return np.zeros(0, int)
        c = np.unique(np.concatenate(found))
        return c[np.bitwise_count(self.prints[c] ^ np.uint64(fingerprint)) <= self.radius]

    def hits(self, shingle_hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.sieve[(shingle_hashes & _LOW).astype(np.int64)])
        out = np.zeros(len(shingle_hashes), bool)
        if len(maybe) and len(self.table):
            at = np.minimum(np.searchsorted(self.table, shingle_hashes[maybe]), len(self.table) - 1)
            out[maybe] = self.table[at] == shingle_hashes[maybe]
        return out

    def search(self, h: np.ndarray, sh: np.ndarray, hit: np.ndarray) -> dict[int, tuple[float, int]]:
        """item index -> (best similarity, first word) for one document: words, shingles, shingle in table."""
        best: dict[int, tuple[float, int]] = {}
        spots: dict[int, np.ndarray] = {}
        if len(h) >= N:  # a shorter document shares no shingle with an item of five words or more
            at_size = defaultdict(list)
            for p in np.flatnonzero(hit).tolist():
                for size in self.sizes_of[int(sh[p])]:
                    at_size[size].append(p)
            for size, at in at_size.items():  # windows with enough shingles of items of just that length
                if size >= N and len(at) >= self.least[size]:
                    mine = np.zeros(len(sh), np.int64)
                    mine[at] = 1
                    run = np.concatenate([[0], np.cumsum(mine)])
                    n = min(size, len(h)) - N + 1
                    got = run[n:] - run[: len(run) - n]
                    if len(s := np.flatnonzero(got >= self.least[size])):
                        spots[size] = s
        for size in [s for s in self.least if s < N and s <= len(h)]:  # items of fewer than five words: windows of exactly their words
            w = [windows(h[i : i + size], np.array([0, size]))[0][0] for i in range(len(h) - size + 1)]
            if (ok := self.hits(np.array(w, np.uint64))).any():
                spots[size] = np.flatnonzero(ok)
        for size, at in spots.items():
            wide = min(size, len(h))
            for start in at.tolist():
                w = h[start : start + wide]
                mine = Counter(windows(w, np.array([0, wide]))[0].tolist())
                near = [i for i in self.near(simhash(w)).tolist() if self.size[i] == size]
                for i in {*near, *self.beyond(mine, size)}:
                    sim = self.similarity(mine, i)
                    if sim >= self.threshold - 1e-12 and (i not in best or sim > best[i][0]):
                        best[i] = (sim, start)
        return best

    def similarity(self, window: Counter, item: int) -> float:
        theirs = self.shingles[item]
        both = sum(min(n, theirs[x]) for x, n in window.items() if x in theirs)
        return both / (window.total() + self.count[item] - both)

    def beyond(self, window: Counter, size: int) -> list[int]:
        """Items of that length which share enough of a window's shingles, whatever their fingerprints."""
        shared: Counter = Counter()
        for x, n in window.items():
            for i in self.holders.get(x, ()):
                if self.size[i] == size:
                    shared[i] += min(n, self.shingles[i][x])
        return [i for i, n in shared.items() if n >= self.threshold * self.count[i] - 1e-9]


FOUND = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _findings(items: Items, texts: pa.Array):
    """(row, item index, similarity, first word, words of the window) of a batch, row by row."""
    with np.errstate(over="ignore"):
        for lo, data, offsets in slices(texts):
            _, _, h, first = words(data, offsets)
            w, to = windows(h, first)
            hit = items.hits(w)
            if min(items.least, default=N) < N:
                rows = range(len(to) - 1)
            else:
                rows = np.unique(np.searchsorted(to, np.flatnonzero(hit), "right") - 1).tolist()
            for i in rows:
                if to[i] < to[i + 1]:
                    n = int(first[i + 1] - first[i])
                    found = items.search(h[first[i] : first[i + 1]], w[to[i] : to[i + 1]], hit[to[i] : to[i + 1]])
                    for k, (sim, start) in sorted(found.items()):
                        yield lo + i, k, sim, start, min(items.size[k], n)


class Pass:
    """The items of one pass as texts; each worker builds the lookup tables once."""

    def __init__(self, rows: list[tuple], threshold: float, radius: int):
        self.rows, self.threshold, self.radius, self.items = rows, threshold, radius, None

    def built(self) -> Items:
        if self.items is None:
            self.items = Items([r[0] for r in self.rows], [r[1] for r in self.rows], self.threshold, self.radius)
        return self.items


def _scan(items: Pass):
    def run(batches):
        for b in batches:
            t = items.built()
            out = [(b.column(0)[r].as_py(), t.ids[k], sim, start, n) for r, k, sim, start, n in _findings(t, b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
            )

    return run


def _drop(items: Pass, at: int):
    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[r for r, *_ in _findings(items.built(), b.column(at))]] = False
            yield b.filter(pa.array(keep))

    return run


def _passes(benchmark: DataFrame, threshold: float, radius: int, items_per_pass: int):
    """(number of passes, an iterator that fetches the items of one pass when asked)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()
    passes = max(1, -(-n // items_per_pass), -(-size // BYTES_PER_PASS))
    part = F.pmod(F.xxhash64("text", "item_id"), F.lit(passes))
    return passes, (Pass([tuple(r) for r in items.where(part == k).collect()], threshold, radius) for k in range(passes))


def find(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, radius: int = RADIUS, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """A row for each (document, benchmark item) with a window at or over the threshold: its best window."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, passes = _passes(benchmark, threshold, radius, items_per_pass)
    found = None
    for items in passes:
        here = rows.mapInArrow(_scan(items), FOUND)
        here = cut(here) if n > 1 else here
        found = here if found is None else found.unionByName(here)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, radius: int = RADIUS, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, judged row by row, so null and repeated ids make no difference."""
    ship(docs.sparkSession)
    n, passes = _passes(benchmark, threshold, radius, items_per_pass)
    for items in passes:
        docs = docs.mapInArrow(_drop(items, docs.columns.index("text")), docs.schema)
        docs = cut(docs) if n > 1 else docs
    return docs
