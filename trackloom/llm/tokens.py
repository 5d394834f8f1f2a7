"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A byte-level BPE never merges across pre-tokens, so a text's token count is the sum over
its pre-tokens.  A document keeps a tree whose leaves hold up to ``LEAF`` pre-tokens
(characters and tokens of each) and whose inner nodes hold sums.  An edit re-encodes only
the pre-tokens it touches and their boundary context: scanning starts at the last old
boundary that the edit cannot have moved (the pattern looks at most two characters past a
match) and ends at the first old boundary, behind the edit, where a new match ends too.  The
pattern has no look-behind, so everything behind that point stays as it was.  Then the
sums on the paths above the changed leaves are set anew.

Counts always equal those of encoding the edited text whole.  The tokenizer is a fixed
public vocabulary (a file of ranks, a parameter); it is never trained, its strings for
special tokens are ordinary text.

Nulls: a null text counts as empty; an edit with a null start or stop is skipped, a null
replacement inserts nothing; positions are code points and are clipped to the text.
Edits of a document apply in the order of ``seq`` (then start, stop, replacement) to the
text as the edits before left it; repeated edits apply repeatedly.  Repeated documents
each get the edits of their id.  Extra columns of either table are ignored; an empty table
of documents gives no rows, one of edits leaves every document as it is.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import ship

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the pre-token pattern that belongs to the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
CACHE = 200_000
LOOKAHEAD = 2


class Counter(dict):
    """Pre-token -> number of tokens; a bounded memo over the tokenizer."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 40:
            self[piece] = n
        return n


class CountedText:
    """A text with its pre-token tree."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        pieces = counter.pattern.findall(text)
        chars, tokens = list(map(len, pieces)), [counter[p] for p in pieces]
        self._build(chars, tokens)

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = [(chars[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(chars), LEAF)] or [([], [])]
        n = self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.sums = [0] * (2 * n), [0] * (2 * n)
        for k, (c, t) in enumerate(self.leaves):
            self.chars[n + k], self.sums[n + k] = sum(c), sum(t)
        for k in range(n - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    @property
    def pretokens(self) -> int:
        return sum(len(c) for c, _ in self.leaves)

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """(leaf that holds the character at ``at``, its first character); the last leaf at the end."""
        k, start = 1, 0
        if at >= self.chars[1]:
            last = len(self.leaves) - 1
            return last, self.chars[1] - self.chars[self.width + last]
        while k < self.width:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def _set(self, leaf: int, chars: list[int], tokens: list[int]) -> None:
        self.leaves[leaf] = (chars, tokens)
        k = self.width + leaf
        self.chars[k], self.sums[k] = sum(chars), sum(tokens)
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def edit(self, start: int, stop: int, put: str) -> int:
        """Replace text[start:stop]; returns the number of characters encoded anew."""
        start = min(max(0, start), len(self.text))
        stop = min(max(start, stop), len(self.text))
        shift = len(put) - (stop - start)
        # the first pre-token that the edit or the look-ahead reaches
        first, base = self._leaf_at(max(0, start - LOOKAHEAD))
        ends = list(accumulate(self.leaves[first][0], initial=base))
        i = max(0, bisect_right(ends, max(0, start - LOOKAHEAD)) - 1)
        i = min(i, len(self.leaves[first][0]))
        if i and ends[i] >= max(0, start - LOOKAHEAD):
            i -= 1
        begin = ends[i]
        self.text = self.text[:start] + put + self.text[stop:]
        # old boundaries behind the edit, read leaf by leaf as the scan gets there
        leaf, at, j, old = first, ends[i], i, self.leaves[first][0]
        chars, tokens, new = [], [], begin
        done = False
        for m in self.counter.pattern.finditer(self.text, begin):
            piece = m[0]
            chars.append(len(piece))
            tokens.append(self.counter[piece])
            new = m.end()
            if new - shift < stop:
                continue
            while at < new - shift:  # walk the old boundaries
                while j >= len(old) and leaf + 1 < len(self.leaves):
                    leaf, j = leaf + 1, 0
                    old = self.leaves[leaf][0]
                if j >= len(old):
                    break
                at += old[j]
                j += 1
            if at == new - shift and at >= stop:
                done = True
                break
        if not done:  # the scan reached the end of the text
            leaf, j = len(self.leaves) - 1, len(self.leaves[-1][0])
        keep_c, keep_t = self.leaves[first][0][:i], self.leaves[first][1][:i]
        rest_c, rest_t = self.leaves[leaf][0][j:], self.leaves[leaf][1][j:]
        for k in range(first + 1, leaf + 1):
            self._set(k, [], [])
        self._set(first, keep_c + chars + rest_c, keep_t + tokens + rest_t)
        if len(self.leaves[first][0]) > 4 * LEAF:
            self._build([c for x, _ in self.leaves for c in x], [t for _, x in self.leaves for t in x])
        return new - begin


COUNTED = "doc_id long, n_tokens long, n_pretokens long, n_tokens_edited long, n_chars_encoded long"


def _count(ranks):
    def run(batches):
        counter = Counter(ranks.value)
        for b in batches:
            ids, texts, edits = (b.column(i) for i in range(3))
            out = []
            for i in range(b.num_rows):
                doc = CountedText(texts[i].as_py() or "", counter)
                before, pieces, encoded = doc.tokens, doc.pretokens, 0
                for e in edits[i].as_py() or []:
                    if e["start"] is not None and e["stop"] is not None:
                        encoded += doc.edit(e["start"], e["stop"], e["put"] or "")
                out.append((before, pieces, doc.tokens, encoded))
            cols = [pa.array([r[k] for r in out], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "n_tokens", "n_pretokens", "n_tokens_edited", "n_chars_encoded"])

    return run


def count(docs: DataFrame, edits: DataFrame | None = None, *, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_tokens_edited, n_chars_encoded) for every document.

    edits: (doc_id, seq, start, stop, put).  Those of one document are applied by one task.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(ranks, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())  # fixed size: the vocabulary
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "array<struct<seq:long,start:long,stop:long,put:string>>"
    if edits is None:
        rows = rows.withColumn("edits", F.lit(None).cast(kind))
    else:
        each = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(c).cast(t) for c, t in (("seq", "long"), ("start", "long"), ("stop", "long"), ("put", "string"))]).alias("e"))
        by_doc = each.groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).cast(kind).alias("edits"))
        rows = rows.join(by_doc, "doc_id", "left")
    return rows.select("doc_id", "text", "edits").mapInArrow(_count(shipped), COUNTED)


def count_inline(docs: DataFrame, edits, *, ranks: str = RANKS) -> DataFrame:
    """``count`` where the edits are an array column expression of each document: no join, no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    with open(ranks, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", edits.alias("edits")).mapInArrow(_count(shipped), COUNTED)


def house_edits(text):
    """The edits of the registered query: a heading mark in front, ten characters in the middle redacted, a final newline."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")

    def e(seq, start, stop, put):
        return F.struct(F.lit(seq).cast("long").alias("seq"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(put).alias("put"))

    middle = F.floor(n / 2) + 2
    return F.array(e(1, F.lit(0), F.lit(0), "# "), e(2, middle, middle + 10, "[redacted]"), e(3, n + 100, n + 100, "\n"))
