"""Recall at the threshold: end, inner and block edits of items of 20 to 200 words, against brute force over all windows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import decontam, shingles

PAIRS = 60


def bag(ws):
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))


def similarity(a, b):
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both)


def edited(item, kind, rng, fresh):
    """The item with as many words changed as leave the similarity at or just over the threshold."""
    ws, n, best = list(item), len(item), list(item)
    places = {"end": range(n - 1, -1, -1), "block": range(n // 3, n), "inner": rng.sample(range(n), n)}[kind]
    whole = bag(item)
    for p in places:
        ws[p] = fresh()
        if similarity(bag(ws), whole) < 0.75:
            break
        best = list(ws)
    return best


@pytest.mark.parametrize("n", [20, 50, 100, 200])
@pytest.mark.parametrize("kind", ["end", "inner", "block"])
def test_every_item_over_the_threshold_is_found(n, kind):
    rng = random.Random(n)
    vocab = [f"w{i}" for i in range(2000)]
    fresh = lambda: rng.choice(vocab)
    items = [[fresh() for _ in range(n)] for _ in range(PAIRS)]
    docs = []
    for item in items:
        docs.append([fresh() for _ in range(rng.randint(0, 9))] + edited(item, kind, rng, fresh) + [fresh() for _ in range(rng.randint(0, 9))])
    table = decontam.Items(list(range(PAIRS)), [" ".join(x) for x in items], 0.75, decontam.RADIUS)
    got = {(r, table.ids[k]): round(sim, 9) for r, k, sim, _, _ in decontam._findings(table, pa.array([" ".join(d) for d in docs]))}
    want = {}
    for r, d in enumerate(docs):
        whole = bag(items[r])
        best = max(similarity(bag(d[i : i + n]), whole) for i in range(len(d) - n + 1))
        assert best >= 0.75
        want[r, r] = round(best, 9)
    assert got == want


def test_fingerprints_beyond_the_radius_are_verified_too(monkeypatch):
    """With the exact path off, the radius alone loses items cut at an edge; that is why it exists."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(2000)]
    fresh = lambda: rng.choice(vocab)
    items = [[fresh() for _ in range(200)] for _ in range(120)]
    docs = pa.array([" ".join(edited(x, "end", rng, fresh)) for x in items])
    table = decontam.Items(list(range(len(items))), [" ".join(x) for x in items], 0.75, decontam.RADIUS)
    both = {r for r, *_ in decontam._findings(table, docs)}
    monkeypatch.setattr(decontam.Items, "beyond", lambda *a: [])
    near = {r for r, *_ in decontam._findings(table, docs)}
    assert both == set(range(len(items))) and near < both


def test_one_long_document():
    rng = random.Random(9)
    item = [f"w{rng.randrange(2000)}" for _ in range(30)]
    text = "lorem ipsum " * 300_000 + " ".join(item) + " dolor sit" * 300_000
    table = decontam.Items([7], [" ".join(item)], 0.75, decontam.RADIUS)
    (found,) = decontam._findings(table, pa.array([text, None, ""]))
    assert found[:3] == (0, 0, 1.0) and found[3] == 600_000
    assert shingles.SLICE < len(text) and np.isclose(found[2], 1)
