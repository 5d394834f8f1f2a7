"""Language ID by segmentation-marginalised unigrams.

A fixed public piece vocabulary; per language a probability for each piece.  A word
(maximal run of letters, lower-cased, with the word mark in front) may be segmented in
many ways; the forward algorithm sums the probabilities of all of them, and a text's
score is the product over its words.  Probabilities are learned by expectation
maximisation over the same lattices (forward-backward), from a bounded sample of labelled
rows: about ``SAMPLE_ROWS`` per language, chosen by a hash of id and text.

Every word of every text is scored whole, however long; distinct words of a slice are
scored once, in numpy, grouped by length.  Words of more than ``LONGEST`` letters run through
the same recursion with a rolling, scaled window, so neither memory nor underflow bounds
their length; only for fitting are they cut into parts of that length.  A text over
``SLICE`` bytes is scored piece by piece, cut where no word is cut.  The model that is shipped to
the tasks has vocabulary x languages numbers.

Nulls and texts without a letter get ``und`` with score 0.  A null id is hashed as the
empty text.  Rows without a language are never learned from.  With no labelled row at all
every text is ``und``.  Ties go to the language that sorts first.  Repeated rows give a row
each, extra columns are ignored (``accepted`` carries them along), an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import md5_long, ship
from .shingles import _P, _PINV, _powers, mix64, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 2 << 20
SAMPLE_ROWS = 500
FOLDS = 5
EM_ROUNDS = 3
LONGEST = 24
FLOOR = 1e-7
SMOOTH = 0.02
MARK = "▁"
UNDECIDED = "und"

_M = np.uint64(0xD1342543DE82EF95)


def pieces_of(path: str) -> list[str]:
    """Pieces made of letters only, the word mark allowed in front."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    all_ = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return sorted({p for x in all_ if (p := x.lower()).removeprefix(MARK).isalpha() and len(p) <= LONGEST + 1})


class Vocabulary:
    """Piece lookup by hash of code points in two direct tables, as large as it takes to place every piece."""

    def __init__(self, pieces: list[str], bits: int = 20):
        self.n = len(pieces)
        self.longest = max(map(len, pieces))
        with np.errstate(over="ignore"):
            h = np.array([self._hash(p) for p in pieces], np.uint64)
        self.hash = np.append(h, np.uint64(0))
        while not self._place(h.tolist(), bits):
            bits += 1

    def _place(self, hashes: list[int], bits: int) -> bool:
        self.bits = np.uint64(bits)
        self.first, self.second = (np.full(1 << bits, self.n, np.int32) for _ in range(2))
        for i, x in enumerate(hashes):
            a, b = x >> (64 - bits), x & ((1 << bits) - 1)
            if self.first[a] == self.n:
                self.first[a] = i
            elif self.second[b] == self.n:
                self.second[b] = i
            else:
                return False
        return True

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * _M + np.uint64(ord(c) + 1)
        return int(mix64(h)[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; ``n`` where there is none."""
        h = mix64(h)
        a = self.first[(h >> (np.uint64(64) - self.bits)).astype(np.int64)]
        a = np.where(self.hash[a] == h, a, self.n)
        miss = np.flatnonzero(a == self.n)
        b = self.second[(h[miss] & ((np.uint64(1) << self.bits) - np.uint64(1))).astype(np.int64)]
        a[miss] = np.where(self.hash[b] == h[miss], b, self.n)
        return a


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and its lower case where that is one code point."""
    every = range(0x110000)
    letter = np.fromiter((chr(i).isalpha() for i in every), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        x = chr(i).lower()
        if len(x) == 1:
            lower[i] = ord(x)
    return letter, lower


def letters(data: np.ndarray, offsets: np.ndarray, part: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased code points, word starts, word ends, first word of each document); ``part`` cuts long words."""
    letter, lower = _tables()
    raw = data.tobytes()
    text = raw.decode("utf-8", "replace")
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if len(cps) != at[-1]:  # not valid UTF-8: count document by document
        parts = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:])]
        cps, at = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    ok = np.concatenate([[False], letter[cps], [False]])
    edge = np.zeros(len(cps) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(ok[1:-1] & (~ok[:-2] | edge[:-1]))
    ends = np.flatnonzero(ok[1:-1] & (~ok[2:] | edge[1:])) + 1
    if part and len(starts) and (ends - starts).max() > part:
        n = -(-(ends - starts) // part)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts, ends = np.repeat(starts, n) + k * part, np.minimum(np.repeat(starts, n) + (k + 1) * part, np.repeat(ends, n))
    return lower[cps], starts, ends, np.searchsorted(starts, at)


def distinct(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one word for each distinct word, distinct word of each word)."""
    total = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(mix64(cps.astype(np.uint64) + _M) * _powers(_P, len(cps) + 1, "p")[: len(cps)], out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_PINV, len(cps) + 1, "q")[starts]
    _, one, inverse = np.unique(mix64(h + (ends - starts).astype(np.uint64)), return_index=True, return_inverse=True)
    return one, inverse


def pieces_at(data: np.ndarray, most: int) -> np.ndarray:
    """Offsets that cut one text into pieces of about ``most`` bytes, at ASCII characters that are no letters."""
    plain = np.flatnonzero((data < 0x41) | ((data > 0x5A) & (data < 0x61)) | ((data > 0x7A) & (data < 0x80)))
    cuts = plain[np.minimum(np.searchsorted(plain, np.arange(most, len(data), most)), len(plain) - 1)] if len(plain) else []
    return np.unique(np.concatenate([[0], cuts, [len(data)]])).astype(np.int64)


def lattices(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary):
    """By word length: (positions in ``starts``, n, {(i, j): piece numbers of the span}); the word mark is symbol 0."""
    size = ends - starts
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        for block in np.array_split(at, -(-len(at) // 100_000)):
            c = np.empty((n + 1, len(block)), np.uint64)
            c[0] = ord(MARK) + 1
            for k in range(n):
                c[k + 1] = cps[starts[block] + k].astype(np.uint64) + np.uint64(1)
            spans = {}
            for i in range(n + 1):
                h = np.zeros(len(block), np.uint64)
                for j in range(i + 1, min(n + 1, i + vocabulary.longest) + 1):
                    h = h * _M + c[j - 1]
                    p = vocabulary.find(h)
                    if j == i + 1 or (p < vocabulary.n).any():
                        spans[i, j] = p
            yield block, n + 1, spans


def forward(n: int, spans: dict, table: np.ndarray, unknown: int) -> list[np.ndarray]:
    """alpha[j]: total probability of all segmentations of the first j symbols, per word and language."""
    w = len(next(iter(spans.values())))
    alpha = [np.ones((w, table.shape[1]))] + [np.zeros((w, table.shape[1])) for _ in range(n)]
    for (i, j), p in sorted(spans.items()):
        if j == i + 1:
            alpha[j] += alpha[i] * np.where((p == unknown)[:, None], FLOOR, table[p])
        else:
            on = np.flatnonzero(p < unknown)
            if len(on) * 3 < len(p):
                alpha[j][on] += alpha[i][on] * table[p[on]]
            else:
                alpha[j] += alpha[i] * table[p]
    return alpha


def log_long(symbols: np.ndarray, vocabulary: Vocabulary, table: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Log probability per language of one word of any length: the forward recursion over a ring of ``longest`` sums.

    The sums are scaled per language; pieces are looked up for a block of positions at a time.
    """
    deep, unknown = vocabulary.longest, vocabulary.n
    n = len(symbols)
    power = np.ones(deep + 1, np.uint64)
    for k in range(deep):
        power[k + 1] = power[k] * _M
    ring, scale = np.zeros((deep + 1, table.shape[1])), np.zeros(table.shape[1])
    ring[0] = 1
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        found = np.full((hi - lo, deep), unknown, np.int32)  # [end, length]
        for size in range(1, min(deep, hi) + 1):
            first = max(lo, size - 1)  # the last symbol of the first piece of this length
            h = np.zeros(hi - first, np.uint64)
            for k in range(size):
                h = h * _M + symbols[first - size + 1 + k : hi - size + 1 + k]
            found[first - lo :, size - 1] = vocabulary.find(h)
        for j in range(lo, hi):
            sizes = np.flatnonzero(found[j - lo] < unknown)
            got = (ring[(j - sizes) % (deep + 1)] * table[found[j - lo, sizes]]).sum(axis=0)
            if not len(sizes) or sizes[0] != 0:
                got = got + ring[j % (deep + 1)] * FLOOR
            ring[(j + 1) % (deep + 1)] = got
            if got.max() < 1e-60 or got.min() < 1e-60:
                most = np.maximum(ring.max(axis=0), 1e-300)
                ring /= most
                scale += np.log(most)
    return np.log(np.maximum(ring[n % (deep + 1)], 1e-300)) + scale


class Model:
    def __init__(self, vocabulary: Vocabulary, langs: list[str], table: np.ndarray, prior: np.ndarray):
        self.vocabulary, self.langs, self.table, self.prior = vocabulary, langs, table, prior

    @staticmethod
    def fit(rows: list[tuple[str, str]], pieces: list[str], rounds: int = EM_ROUNDS) -> "Model":
        """rows: (text, lang)."""
        vocabulary = Vocabulary(pieces)
        langs = sorted({lang for _, lang in rows})
        v = vocabulary.n
        table = np.zeros((v + 1, max(1, len(langs))))
        with np.errstate(over="ignore"):
            for k, lang in enumerate(langs):
                text = "\n".join(t for t, x in rows if x == lang).encode()
                cps, starts, ends, _ = letters(np.frombuffer(text, np.uint8), np.array([0, len(text)]), LONGEST)
                if not len(starts):
                    table[:v, k] = 1 / v
                    continue
                one, inverse = distinct(cps, starts, ends)
                times = np.bincount(inverse).astype(float)
                lat = list(lattices(cps, starts[one], ends[one], vocabulary))
                p = np.full((v + 1, 1), 1 / v)
                p[v] = 0
                for _ in range(rounds):
                    count = np.zeros(v + 1)
                    for block, n, spans in lat:
                        a = forward(n, spans, p, v)
                        b = [np.zeros((len(block), 1)) for _ in range(n)] + [np.ones((len(block), 1))]
                        for (i, j), q in sorted(spans.items(), reverse=True):
                            b[i] += b[j] * (np.where((q == v)[:, None], FLOOR, p[q]) if j == i + 1 else p[q])
                        whole = a[n][:, 0]
                        for (i, j), q in spans.items():
                            share = a[i][:, 0] * p[q, 0] * b[j][:, 0] / whole * times[block]
                            count += np.bincount(q, share, v + 1)
                    count[v] = 0
                    p[:v, 0] = (count[:v] + SMOOTH) / (count.sum() + SMOOTH * v)
                table[:v, k] = p[:v, 0]
        n = np.array([sum(x == lang for _, x in rows) for lang in langs], float)
        return Model(vocabulary, langs, table, np.log(np.maximum(n, 1) / max(1, n.sum())))

    def log_words(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), self.table.shape[1]))
        long = ends - starts > LONGEST
        short = np.flatnonzero(~long)
        for block, n, spans in lattices(cps, starts[short], ends[short], self.vocabulary):
            out[short[block]] = np.log(np.maximum(forward(n, spans, self.table, self.vocabulary.n)[n], 1e-300))
        for i in np.flatnonzero(long):
            word = np.concatenate([[ord(MARK)], cps[starts[i] : ends[i]]]).astype(np.uint64) + np.uint64(1)
            out[i] = log_long(word, self.vocabulary, self.table)
        return out

    def log_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each document per language, its number of words)."""
        if len(offsets) == 2 and len(data) > 2 * SLICE and len(cuts := pieces_at(data, SLICE)) > 2:
            parts = [self.log_texts(data[a:b], np.array([0, b - a])) for a, b in zip(cuts[:-1], cuts[1:])]
            return sum(x for x, _ in parts), sum(n for _, n in parts)
        cps, starts, ends, first = letters(data, offsets)
        total = np.zeros((len(starts) + 1, len(self.langs)))
        if len(starts):
            one, inverse = distinct(cps, starts, ends)
            np.cumsum(self.log_words(cps, starts[one], ends[one])[inverse], axis=0, out=total[1:])
        return total[first[1:]] - total[first[:-1]], np.diff(first)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        if not self.langs:
            return [UNDECIDED] * n, np.zeros(n)
        with np.errstate(over="ignore"):
            logs, count = self.log_texts(data, offsets)
        logs = logs + self.prior
        best = logs.argmax(axis=1)
        share = np.exp(logs - logs.max(axis=1, keepdims=True))
        score = (share / share.sum(axis=1, keepdims=True))[np.arange(n), best]
        some = count > 0
        return [self.langs[b] if s else UNDECIDED for b, s in zip(best, some)], np.where(some, np.clip(score, 0, 1), 0.0)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def sample(docs: DataFrame, rows_per_lang: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """About ``rows_per_lang`` (text, lang) of each language, by hash of the id, outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().collect()  # one row per language
    name = F.concat_ws(":", F.lit("langid"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.col("text")))  # null ids fall apart by text
    turn = md5_long(name) / float(1 << 60)
    chosen = F.lit(False)
    for r in counts:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (turn < rows_per_lang / r["count"]))
    rows = known.where(chosen).select("text", "lang").distinct()  # copies of one row count once
    first = rows.orderBy(md5_long(F.col("text")), "lang").limit(2 * rows_per_lang * max(1, len(counts)))
    return sorted((r[0], r[1]) for r in first.collect())


PREDICTED = "lang_pred string, score double"


def _predict(model: Model, columns: list[str]):
    def run(batches):
        for b in batches:
            text = b.column(len(columns) - 1)
            for lo, data, offsets in slices(text, SLICE):
                lang, score = model.predict(data, offsets)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, len(lang)) for i in range(len(columns) - 1)), pa.array(lang, pa.string()), pa.array(score)], names=[*columns[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, *, model: Model | None = None, vocabulary: str = VOCABULARY, rows_per_lang: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    ship(docs.sparkSession)
    model = model or Model.fit(sample(docs, rows_per_lang), pieces_of(vocabulary))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predict(model, ["doc_id", "held_out", "text"]), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep(model: Model, at: int, least: float):
    def run(batches):
        for b in batches:
            parts = [np.zeros(0, bool)]
            for _, data, offsets in slices(b.column(at), SLICE):
                lang, score = model.predict(data, offsets)
                parts.append((np.array(lang) != UNDECIDED) & (score >= least))
            yield b.filter(pa.array(np.concatenate(parts)))

    return run


def accepted(docs: DataFrame, *, model: Model | None = None, vocabulary: str = VOCABULARY, rows_per_lang: int = SAMPLE_ROWS, least: float = 0.5) -> DataFrame:
    """The rows whose text is in a known language with at least the given score; all columns stay."""
    ship(docs.sparkSession)
    model = model or Model.fit(sample(docs, rows_per_lang), pieces_of(vocabulary))
    return docs.mapInArrow(_keep(model, docs.columns.index("text"), least), docs.schema)
