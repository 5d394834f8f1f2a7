"""Cost-balanced packing of documents into fixed-length training sequences.

1. Every document becomes token ids (``tokenise``): runs between white space are encoded by
   the given tokenizer or its merges and kept in a bounded memo; ids of a text are those of its
   runs one after another, because this vocabulary drops white space and no merge, lower-casing
   or composition crosses it (a file of another kind encodes texts whole).  An end id follows.  A document longer than a sequence is cut
   into pieces of a sequence's length at once.
2. Pieces are dealt by a hash into groups of about ``GROUP_TOKENS`` tokens, so no task holds
   more than that, however large a source, a document or a group of copies is.
3. In a group (``deal``) the attention cost of a piece of n tokens is estimated as
   n + n * n / (6 * width): linear layers, and scores between its own tokens.  Pieces go in
   descending order to the sequence of lowest cost that has room for them whole; if none has
   room, the piece fills the sequence with the most room and the rest of it is dealt later.
   The sequences of a group have room for just its tokens: full ones, and one for each
   power of two in the remainder, so none needs padding.  Each cut fills a sequence, so a
   group has fewer cuts than sequences.

Null texts are empty and give the end id alone, as do texts of white space.  Texts of any
length are read whole.  Repeated rows are packed each; ties in length go by id, place in the
document, place of the row in its file.  Null ids are packed like others.  Columns other
than id and text are ignored, whatever their names; an empty table gives no rows.  Packing
the same files again gives the same rows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from .common import cut, ensure_checkpoint_dir, keyed, ship

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 2
LIMIT = 4096
GROUP_TOKENS = 1 << 22
WIDTH = 4096
MEMO, MEMO_CHARS = 500_000, 40
#: Python's ``split`` takes these for white space, the tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = re.compile(r"[\t-\r ]+")
#: How the vocabulary's file prepares texts and cuts them into words.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable characters that stay as they are in composed form and have one lower case whatever stands beside them ...
PLAIN = re.compile("[!-~\xa1-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
#: ... and ``WORDS`` for those, in Python's own classes.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\d\u00b2\u00b3\u00b9\u00bc-\u00be]|[\W_]+")


def byte_letters() -> list[str]:
    """A letter for each byte as byte-level vocabularies write them: printable ones as they are, the rest from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in kept else next(others)) for b in range(256)]


class Words(dict):
    """Word as ``PLAIN_WORDS`` finds it -> its ids, two bytes each; a bounded memo over the merges."""

    def __init__(self, tokenizer):
        self.model, self.letters = tokenizer.model, byte_letters()
        self.each = [i.to_bytes(2, "little") for i in range(1 << 16)]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        ids = b"".join([self.each[t.id] for t in self.model.tokenize(letters)])
        if len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids


_kept: dict[str, "Ids"] = {}


class Ids(dict):
    """Run of characters without white space -> its ids as bytes; a bounded memo over the tokenizer.

    A run of plain characters is cut into words here, any other is given to the tokenizer, as is
    the whole text if the file is not of the known kind.
    """

    @classmethod
    def kept(cls, path: str) -> "Ids":
        """One for each file and Python worker: tasks that come later find the memo filled."""
        if path not in _kept:
            _kept[path] = cls(path)
        return _kept[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text())
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.drops_spaces = steps == NORMALIZERS and cuts == [WORDS, None] and not spec.get("truncation") and self.kind.itemsize == 2
        self.words = Words(self.tokenizer) if self.drops_spaces else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def __missing__(self, run: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        if run.isascii() and run.isalpha():
            ids = self.words[run.lower()]
        elif PLAIN.fullmatch(run) and "<|" not in run:
            ids = b"".join([self.words[w] for w in PLAIN_WORDS.findall(run.lower())])
        else:
            ids = self.whole(run)
        if len(run) <= MEMO_CHARS:
            self[run] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not self.drops_spaces:
            return self.whole(text)
        return b"".join([self[r] for r in (SPACES.split(text) if SEPARATORS.search(text) else text.split())])


def tokenise(rows: DataFrame, path: str = TOKENIZER, end: int = END, limit: int = LIMIT) -> DataFrame:
    """(doc_id, row, start, length, doc_tokens, ids) for the columns doc_id, row and text: pieces of at most ``limit`` ids."""
    doc_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids.kept(path)
        last, step = np.array([end], dtype=ids.kind).tobytes(), limit * ids.kind.itemsize
        for b in batches:
            n = b.num_rows
            for lo in range(0, n, 256):  # a few hundred documents' ids at a time
                part = b.slice(lo, 256)
                at, start, length, total, found = [], [], [], [], []
                for k, text in enumerate(part.column("text")):
                    of_doc = ids.of(text.as_py() or "") + last
                    size = len(of_doc) // ids.kind.itemsize
                    for s in range(0, len(of_doc), step):
                        piece = of_doc[s : s + step]
                        at.append(k), start.append(s // ids.kind.itemsize), length.append(len(piece) // ids.kind.itemsize), total.append(size), found.append(piece)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("row").take(at), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(found, pa.binary())],
                    names=["doc_id", "row", "start", "length", "doc_tokens", "ids"],
                )

    ship(rows.sparkSession)
    return rows.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {doc_type}, row long, start long, length long, doc_tokens long, ids binary")


def cost(tokens: int, width: int = WIDTH) -> float:
    """Estimated attention cost of a piece: linear layers and its own tokens' scores, in units of a token's linear layers."""
    return tokens + tokens * tokens / (6 * width)


def rooms(total: int, limit: int = LIMIT) -> list[int]:
    """Sequence lengths that hold ``total`` tokens exactly: full ones, then powers of two."""
    return [limit] * (total // limit) + [1 << k for k in reversed(range(limit.bit_length())) if total % limit >> k & 1]


def deal(lengths: list[int], limit: int = LIMIT, width: int = WIDTH) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """((piece, its tokens before, tokens, sequence, offset) ..., cost of each sequence); ``lengths`` are at most ``limit``."""
    room = rooms(sum(lengths), limit)
    size, costs, placed = room.copy(), [0.0] * len(room), []
    low = [(0.0, j) for j in range(len(room))]  # by cost
    tight: list[tuple[int, int]] = []  # by room; too small for the pieces seen so far
    todo = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapq.heapify(todo)
    while todo:
        n, k, before = heapq.heappop(todo)
        n = -n
        while tight and -tight[0][0] >= n:
            j = heapq.heappop(tight)[1]
            heapq.heappush(low, (costs[j], j))
        while low and room[low[0][1]] < n:
            j = heapq.heappop(low)[1]
            if room[j]:
                heapq.heappush(tight, (-room[j], j))
        j = heapq.heappop(low)[1] if low else heapq.heappop(tight)[1]
        put = min(n, room[j])
        placed.append((k, before, put, j, size[j] - room[j]))
        if put < n:
            heapq.heappush(todo, (put - n, k, before + put))
        room[j] -= put
        costs[j] += cost(put, width)
        if room[j]:
            heapq.heappush(low, (costs[j], j))
    return placed, costs


def pack(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end: int = END, limit: int = LIMIT, width: int = WIDTH, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, sequence_cost."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "file", "row")
    pieces = cut(tokenise(rows, tokenizer, end, limit))
    total = pieces.agg(F.sum("length")).head()[0] or 0
    groups = -(-total // group_tokens) or 1
    doc_type = pieces.schema["doc_id"].dataType.simpleString()

    def group(at: tuple, found: pa.Table) -> pa.Table:
        found = found.sort_by([(c, "ascending") for c in ("doc_id", "start", "row")])
        lengths, ids = found["length"].to_numpy(), found["ids"].to_pylist()
        placed, costs = deal(lengths.tolist(), limit, width)
        kind = np.dtype("<u2" if len(ids[0]) == 2 * lengths[0] else "<u4")
        crc = [zlib.crc32(np.frombuffer(ids[k], kind, n, before * kind.itemsize).astype("<u4").tobytes()) for k, before, n, _, _ in placed]
        k, before, n, j, offset = np.array(placed, dtype=np.int64).T
        full = np.array(rooms(int(n.sum()), limit), dtype=np.int64)
        return pa.table({
            "doc_id": found["doc_id"].take(pa.array(k)), "start": found["start"].to_numpy()[k] + before, "length": n, "ids_crc32": np.array(crc, dtype=np.int64),
            "doc_tokens": found["doc_tokens"].to_numpy()[k], "sequence_id": (at[0].as_py() << 32) + j, "offset": offset, "sequence_tokens": full[j], "sequence_cost": np.array(costs)[j],
        })

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(
        group, f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"
    )
