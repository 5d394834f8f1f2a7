"""Documents shorter than an item, against brute force over windows of at most the document's words."""

import random
from collections import Counter

from trackloom.llm import decontam


def _bag(ws):
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)])


def _sim(a, b):
    x, y = _bag(a), _bag(b)
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def _brute(docs, items):
    want = {}
    for d, t in docs:
        ws = t.split()
        for k, x in items:
            xs = x.split()
            n = min(len(xs), len(ws))
            best = max((_sim(ws[i : i + n], xs) for i in range(len(ws) - n + 1)), default=0) if n else 0
            if best >= 0.75:
                want[d, k] = round(best, 9)
    return want


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(11)
    vocab = [f"t{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((38, 38, 20, 6, 5, 4, 3, 2, 1, 1))]
    docs = []
    for _, x in items:
        xs = x.split()
        docs += [" ".join(xs[a : len(xs) - b]) for a in range(2) for b in range(2)]
        docs += [f"{x} one", f"one {x}", f"one {x} more"]
    docs = list(enumerate(docs))
    want = _brute(docs, items)
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.find(df, b).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == want
    assert (1, 0) in want  # the item of 38 words without its last one
    size = {d: len(t.split()) for d, t in docs}
    assert all(r.first_word + r.n_words <= size[r.doc_id] for r in rows)


def test_items_cut_at_an_edge_are_found(spark):
    rng = random.Random(12)
    vocab = [f"t{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(20))) for i in range(40)]
    docs = []
    for _, x in items:
        xs = x.split()
        docs += [" ".join(xs[a : len(xs) - b]) for a in range(4) for b in range(5 - a)]
        filler = [rng.choice(vocab) for _ in range(30)]
        docs += [" ".join(filler[:15] + xs[:-4] + filler[15:]), " ".join(filler[:15] + xs[4:] + filler[15:])]
    docs = list(enumerate(docs))
    want = _brute(docs, items)
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.find(df, b).collect()} == want
