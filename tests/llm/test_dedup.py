"""Near-duplicates, repeated strings and vectors against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import embeddings, graph, neardup, suffixes


def _words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def _shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({" ".join(ws)} if ws else set())


def _components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_docs():
    rng, rows = random.Random(4), []
    line = _words(rng, 12)
    for base in range(6):
        ws = _words(rng, rng.choice([6, 30, 80, 200]))
        for copy in range(30):
            w = list(ws)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(["x", "Y", "zz"])
            rows.append(" ".join(w + (line if copy % 3 == 0 else [])))
    rows += ["", None, "one two", "ONE\ttwo", "a b c d e", " \n", "!", "word " * 50, "word " * 60, "a" * 5000]
    return list(enumerate(rows))


def test_neardup_equals_brute_force(spark):
    rows = near_docs()
    sets = {i: _shingles(t) for i, t in rows}
    links = [(a, b) for a, s in sets.items() for b, t in sets.items() if a < b and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    comp = _components(sets, links)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sketch": F.lit(1), "cid": F.lit("x"), "v": F.lit(2.0)})
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, tile=8).collect()}
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_neardup_empty_null_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (5, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5
    assert {r.component_id for r in got if r.n_shingles} == {1}
    assert {(r.doc_id, r.component_id) for r in got if not r.n_shingles} == {(None, None), (5, 5)}


def test_components_chain_star_and_loops(spark):
    rng, n = random.Random(1), 60
    links = [(i, i + 1) for i in range(20, 39)] + [(0, i) for i in range(1, 15)] + [(50, 50), (55, 41), (41, 55)]
    rng.shuffle(links)
    got = {r.v: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = _components(range(n), links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {v: want[v] for v in touched}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _strings(rows, width=50):
    first = {}
    top = (1 << 63) - 1
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            first[b[k : k + width]] = min(first.get(b[k : k + width], top), top if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < (top if i is None else i):
                gone[k : k + width] = True
        runs = int((gone & ~np.append([False], gone[:-1])).sum()) if len(b) else 0
        out.append((-1 if i is None else i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def string_docs():
    rng = random.Random(3)
    base = ["".join(rng.choice("ab \u00e9") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(80):
        t, k = rng.choice(base), rng.random()
        if k < 0.2:
            t = t[: rng.randint(0, 300)]
        elif k < 0.5:
            p = rng.randint(0, 299)
            t = t[:p] + "X" + t[p + 1 :]
        elif k < 0.6:
            t = "a" * rng.randint(0, 400)
        elif k < 0.8:
            t = rng.choice(base)[rng.randint(0, 250) :] + rng.choice(base)[: rng.randint(0, 250)]
        rows.append((7 if k > 0.95 else i, None if k > 0.98 else t))
    return rows + [(None, base[0]), (None, base[0]), (3, base[1]), (3, base[1])]


def test_string_dedup_equals_brute_force(spark):
    rows = string_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("chunk", F.lit("clash"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(df).collect())
    assert got == _strings(rows)
    kept = suffixes.dedup(df, with_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept)


def test_string_dedup_long_text_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 256)
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, long), (2, long[500:1500] + "!" + long[100:200]), (3, "short"), (4, "")]
    c = suffixes._chunks(iter([__import__("pyarrow").RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])]))
    r = next(c).to_pylist()[0]
    whole = suffixes.Chunk(r["ids"], r["lens"], r["body"], r["n_bytes"])
    monkeypatch.setattr(suffixes, "PIECE", 1 << 20)
    again = suffixes.Chunk(r["ids"], r["lens"], r["body"], r["n_bytes"])
    assert whole.size.sum() == again.size.sum() == sum(max(0, len(t) - 49) for _, t in rows)


def test_string_dedup_empty(spark):
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _dedup_of(spark, partitions):
    """Rows dealt to partitions as given."""
    rdd = spark.sparkContext.parallelize(list(enumerate(partitions)), max(1, len(partitions))).flatMap(lambda x: x[1])
    df = spark.createDataFrame(rdd, "doc_id long, text string")
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(df).collect())


LONG = "abcdefghij" * 8


@pytest.mark.parametrize("partitions", [
    [[(1, "short"), (2, ""), (3, "short")]],
    [[(1, None)]],
    [[(1, "a" * 49), (2, None), (3, "b")], [(4, LONG), (5, "x" + LONG)]],
    [[(1, LONG)], [(2, None)], [(3, "a" * 50), (4, "a" * 49)]],
    [[(9, LONG), (None, LONG), (2, "tiny")], [(None, None)], [], [(3, LONG + "y")]],
])
def test_string_dedup_partitions_of_short_texts(spark, partitions):
    assert _dedup_of(spark, partitions) == _strings([r for p in partitions for r in p])


def test_string_dedup_over_random_partitions(spark):
    rng = random.Random(11)
    for _ in range(3):
        some = lambda: rng.choice([None, "", "s" * rng.randint(1, 49), LONG[rng.randint(0, 30) :], "z" * rng.randint(45, 55) + LONG])
        partitions = [[(rng.randint(0, 30), some()) for _ in range(rng.randint(0, 6))] for _ in range(5)]
        assert _dedup_of(spark, partitions) == _strings([r for p in partitions for r in p])


@pytest.mark.parametrize("texts", [[], [b"short"] * 3, [b"short", LONG.encode()], [LONG.encode()] * 2])
def test_a_chunk_of_any_lengths(texts):
    _, lens, body, n = suffixes._pack([np.array([k]) for k in range(len(texts))] or [np.zeros(0, np.int64)], texts)
    hashes, repeated = suffixes.Chunk(np.arange(len(texts)).tobytes(), lens.tobytes(), body, n).distinct_anchors()
    assert len(hashes) == len(repeated) and repeated.any() == (texts.count(LONG.encode()) == 2)


def test_merged_transforms_equal_sorted_windows():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    starts, sizes = np.arange(0, 3800, 95), np.full(40, 12)
    text[starts[5] : starts[5] + 61] = text[starts[20] : starts[20] + 61]
    ids = rng.permutation(40).astype(np.int64)
    got = suffixes.smallest_ids(text, starts, sizes, ids, np.arange(len(ids)) % 4)
    least = {}
    for s, n, i in zip(starts, sizes, ids):
        for k in range(n):
            w = text[s + k : s + k + 50].tobytes()
            least[w] = min(least.get(w, 1 << 60), int(i))
    assert got.tolist() == [least[text[s + k : s + k + 50].tobytes()] for s, n in zip(starts, sizes) for k in range(n)]


def vectors(rng, n=240, d=16):
    base = rng.standard_normal((12, d))
    x = base[rng.integers(0, 12, n)] + rng.standard_normal((n, d)) * rng.choice([0.0, 0.05, 0.2, 0.35], n)[:, None]
    return x


def test_vectors_equal_brute_force(spark):
    x = vectors(np.random.default_rng(5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T >= 0.9
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    n = len(rows)
    odd = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [None] + [1.0] * 15), (n + 4, [0.0] * 16), (None, None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"cid": F.lit(1), "copies": F.lit(2)})
    got = embeddings.near_duplicates(df, window=16, block=64, tile=16, recall=0.99999).collect()
    comp = _components(range(n), [(i, j) for i in range(n) for j in range(i) if sim[i, j]])
    want = {i: (int(sim[i].sum()) - 1, comp[i]) for i in range(n)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < n} == want
    assert all(r.n_links == 0 and r.component_id == r.vec_id for r in got if r.vec_id is None or r.vec_id >= n)
    assert len(got) == n + len(odd)


def test_vectors_empty_and_all_bad(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    got = embeddings.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.kept) for r in got) == [(1, 0, True), (2, 0, True)]


@pytest.mark.parametrize("n", [1, 1000, 10**6, 10**9])
def test_passes_grow_slowly(n):
    assert 4 <= embeddings.passes_for(n) <= 400


def test_coarse_and_fine_buckets_agree(spark, monkeypatch):
    """The way through coarse buckets and groups of chunks, forced on a small corpus."""
    rng = random.Random(12)
    shared = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta", "eps")) + str(rng.randrange(99)) for _ in range(30)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(shared)[rng.randrange(40) :] if rng.random() < 0.5 else f"own{rng.random()} words {rng.random()}" for _ in range(6))) for i in range(120)]
    rows += [(None, shared[0]), (5, None), (300, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda out: sorted((str(r.doc_id), r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())
    want = key(suffixes.dedup(df))
    monkeypatch.setattr(suffixes, "FAN", 4)
    monkeypatch.setattr(suffixes, "CHUNK", 4000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 6000)
    assert key(suffixes.dedup(df)) == want and sum(r[1] for r in want) > 1000
