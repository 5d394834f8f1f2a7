"""Vectorised words and word shingles over batches of texts (numpy).

A batch is worked off in slices of about ``SLICE`` bytes, so memory stays bounded however
many the texts are; one text longer than that is a slice of its own, whose words are found
piece by piece, so besides the text only its words (24 bytes each) are held.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 512 << 10
N = 5

_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def _powers(base: int, n: int, name: str) -> np.ndarray:
    n, have = int(n), _POW.get(name)
    if have is None or len(have) < n:
        m = 1 << max(12, (n - 1).bit_length())
        out = np.empty(m, np.uint64)
        out[0] = 1
        done = 1
        while done < m:  # doubling: out[k:2k] = out[:k] * base**k
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        if m > 8 * SLICE:
            return out
        _POW[name] = have = out
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null counts as empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, hash) of every word and, per document, the index of its first word.

    More bytes than ``SLICE`` are worked off in pieces cut before white space, which changes nothing.
    """
    if len(data) <= 2 * SLICE:
        starts, ends, h = _words(data, offsets)
        return starts, ends, h, np.searchsorted(starts, offsets)
    space = np.flatnonzero(_SPACE[data])
    cuts = [0, len(data)]
    if len(space):
        cuts += space[np.minimum(np.searchsorted(space, np.arange(SLICE, len(data), SLICE)), len(space) - 1)].tolist()
    cuts = sorted(set(cuts))
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        starts, ends, h = _words(data[a:b], np.unique(np.clip(offsets - a, 0, b - a)))
        parts.append((starts + a, ends + a, h))
    starts, ends, h = (np.concatenate(x) for x in zip(*parts))
    return starts, ends, h, np.searchsorted(starts, offsets)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    space = _SPACE[data] if n else np.zeros(0, bool)
    inside = ~space
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_P, n + 1, "p")[:n], out=total[1:])
    return starts, ends, mix64((total[ends] - total[starts]) * _powers(_PINV, n + 1, "q")[starts])


_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(64)]


def windows(h: np.ndarray, first: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words and, per document, the index of its first run.

    A document with 1 to n - 1 words has one run: all its words.
    """
    counts = np.diff(first)
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    to = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(to[-1], np.uint64)
    if len(h) >= n:
        acc = h[: len(h) - n + 1] * _STEP[0]
        for k in range(1, n):
            acc = acc + h[k : len(h) - n + 1 + k] * _STEP[k]
        long = counts >= n
        where = np.repeat(np.where(long, first[:-1] - to[:-1], 0), runs) + np.arange(to[-1])
        keep = np.repeat(long, runs)
        out[keep] = mix64(acc[where[keep]])
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        w = h[first[i] : first[i + 1]]
        x = np.uint64(len(w))
        for k, v in enumerate(w):
            x = x + np.uint64(v) * _STEP[k + 8]
        out[to[i]] = mix64(np.array([x]))[0]
    return out, to


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each document) slice by slice."""
    with np.errstate(over="ignore"):
        for lo, data, offsets in slices(texts):
            _, _, h, first = words(data, offsets)
            w, to = windows(h, first)
            yield lo, [np.unique(w[to[i] : to[i + 1]]) for i in range(len(to) - 1)]
