"""Words and texts of any length: the same numbers as by the plain recursion, and as by pieces of any size."""

import math
import random

import numpy as np
import pytest

from trackloom.llm import langid, shingles

PIECES = ["a", "b", "ab", "▁", "▁a", "ba", "abba", "bb"]


def _plain(word: str, prob: dict, floor: float) -> float:
    """Log of the sum over all segmentations, in exact scaled arithmetic."""
    s = "▁" + word
    alpha = [0.0] + [None] * len(s)  # logs
    for j in range(1, len(s) + 1):
        terms = []
        for i in range(max(0, j - 8), j):
            p = prob.get(s[i:j], floor if j == i + 1 else 0)
            if p and alpha[i] is not None:
                terms.append(alpha[i] + math.log(p))
        top = max(terms)
        alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms))
    return alpha[-1]


@pytest.mark.parametrize("n", [1, 3, 24, 25, 60, 700])
def test_words_of_any_length(n):
    v = langid.Vocabulary(PIECES)
    rng = np.random.default_rng(n)
    table = np.zeros((v.n + 1, 2))
    table[: v.n] = rng.random((v.n, 2)) / 4
    model = langid.Model(v, ["x", "y"], table, np.zeros(2))
    word = "".join(random.Random(n).choice("abc") for _ in range(n))
    cps = np.array([ord(c) for c in word], np.uint32)
    with np.errstate(over="ignore"):
        got = model.log_words(cps, np.array([0]), np.array([n]))[0]
        long = langid.log_long(np.concatenate([[ord(langid.MARK)], cps]).astype(np.uint64) + np.uint64(1), v, table, block=16)
    for k in range(2):
        want = _plain(word, {p: table[i, k] for i, p in enumerate(PIECES)}, langid.FLOOR)
        assert math.isclose(got[k], want, rel_tol=1e-9) and math.isclose(long[k], want, rel_tol=1e-9)


def test_tables_grow_until_every_piece_has_a_place():
    v = langid.Vocabulary([chr(97 + i) + chr(97 + j) for i in range(20) for j in range(20)], bits=4)
    with np.errstate(over="ignore"):
        h = np.array([ord("c") + 1], np.uint64) * langid._M + np.uint64(ord("d") + 1)
        assert v.bits > 4 and v.find(h)[0] == 2 * 20 + 3


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 40))) for _ in range(400)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    v = langid.Vocabulary(PIECES)
    table = np.zeros((v.n + 1, 2))
    table[: v.n] = np.random.default_rng(1).random((v.n, 2)) / 4
    model = langid.Model(v, ["x", "y"], table, np.zeros(2))
    with np.errstate(over="ignore"):
        whole, words = model.log_texts(data, offsets), shingles.words(data, offsets)
        monkeypatch.setattr(langid, "SLICE", 500)
        monkeypatch.setattr(shingles, "SLICE", 500)
        again, cut = model.log_texts(data, offsets), shingles.words(data, offsets)
    assert np.allclose(whole[0], again[0]) and (whole[1] == again[1]).all()
    assert all((a == b).all() for a, b in zip(words, cut))
