"""Sharding and mixing: laws, nulls, hot groups, empty tables; pipeline against plain Python."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm import mixing, queries, sharding

SF = "/root/testdata/sf0.001"


def shard_rows():
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(400)) for i in range(600)] + [(1000 + i, "hot " * 25) for i in range(300)] + [(-5, None), (None, "n"), (None, None), (7, "same"), (7, "same"), (-(1 << 63), "low"), ((1 << 63) - 1, "high")]
    return rows


def test_sharding_law_and_slots(spark):
    rows = shard_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("clash"), "sort_h": F.lit(1), "sub": F.lit(2), "count": F.lit(3)})
    out = sharding.shard(df, 10).collect()
    assert len(out) == len(rows)
    size = [0] * 10
    slots = [[] for _ in range(10)]
    for r in out:
        assert r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(size) - min(size) <= 2 * (416 + 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    small = {}
    for r in out:
        small.setdefault(r.text, set()).add(r.shard)
    assert len(small["hot " * 25]) > 2  # a hot group is spread
    assert all(len(v) == 1 for k, v in small.items() if k != "hot " * 25 and k is not None and len(k) < 60)  # small groups stay whole
    again = sorted((str(r.doc_id), r.shard, r.slot, str(r.text)) for r in sharding.shard(df.repartition(7), 10).collect())
    assert again == sorted((str(r.doc_id), r.shard, r.slot, str(r.text)) for r in out)


def test_groups_stay_whole_up_to_a_shard_and_split_above(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(400)) for i in range(800)]
    rows += [(2000 + i, "fits " * 20) for i in range(180)]  # more than half a shard
    rows += [(5, "one row again and again " * 4)] * 600 + [(None, "no id " * 9)] * 600  # equal rows: a group of several shards
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    size, spread = [0] * 10, {}
    for r in out:
        size[r.shard] += r.size
        spread.setdefault(r.text, set()).add(r.shard)
    ideal = sum(size) / 10
    assert len(out) == len(rows) and len(spread["fits " * 20]) == 1 and 0.5 * ideal < 180 * 116 < ideal
    assert len(spread["one row again and again " * 4]) > 2 and len(spread["no id " * 9]) > 1
    assert max(size) < ideal + 180 * 116 / 2 + 500 and min(size) > ideal - 180 * 116 / 2 - 500


def test_sharding_empty_and_one(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.slot for r in sharding.shard(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [0]


def mix_rows():
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(200), f"s{min(rng.randrange(12), 5)}") for i in range(800)]
    return rows + [(900, None, "s1"), (901, "", None), (902, "a b c", None), (None, "q " * 50, "s2"), (903, "z " * 5000, "big"), (5, "dup dup", "s1"), (5, "dup dup", "s1")]


def water(sizes):
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted((x for x in sizes if x is not None)) + ([None] if None in sizes else []))}
    left, total, out = set(sizes), 1.5 * sum(sizes.values()), {}
    while left:
        level = (total - sum(out.values())) / sum(w[s] for s in left)
        over = [s for s in left if level * w[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in left}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left.discard(s)
    return out


def test_mixing_targets_and_bounds(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "shard": F.lit(1)})
    out = mixing.mix(df, rows_per_shard=100).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = water(sizes), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(out) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, s
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(out) == key(mixing.mix(df.repartition(5), rows_per_shard=100).collect())


def seat_count(wants, open_):
    """Sainte-Lague by ranking every quotient; ties to the name that sorts first."""
    won = sorted((-w / (2 * k + 1), s, k) for s, w in wants.items() for k in range(int(w) + 9))[:open_]
    return {s: sum(1 for x in won if x[1] == s) for s in wants}


@pytest.mark.parametrize("block", [1, 32])
def test_quotas_are_sainte_lague(spark, block):
    rng = random.Random(block)
    cells = [(k, f"s{i}", rng.randint(0, 300) * (i + 1)) for i in range(5) for k in range(13)]
    df = spark.createDataFrame(cells, "shard long, source string, size long")
    targets = mixing.source_targets(df.select("source", "size"))
    t = {r.source: r.target / block for r in targets.collect()}
    blocks = seat_count(t, int(sum(t.values()) + 0.5))
    assert {r.source: r.got for r in mixing.source_blocks(targets, block).collect()} == blocks
    got = {(r.shard, r.source): r["take"] for r in mixing.quotas(df, mixing.source_blocks(targets, block), 13, block, fan=1024).collect()}
    for s in blocks:
        size = {k: n for k, x, n in cells if x == s}
        want = seat_count({k: blocks[s] * n / sum(size.values()) for k, n in size.items()}, blocks[s])
        assert {k: got[k, s] for k in size} == {k: min(want[k] * block, 2 * size[k]) for k in size}
    # top down through groups of three shards: the sums stay
    deep = mixing.quotas(df, mixing.source_blocks(targets, 1), 13, 1, fan=3).groupBy("source").agg(F.sum("take").alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 1 for r in deep)


def test_a_rare_source_of_short_texts_meets_its_target(spark):
    rows = [(i, "w " * 200, "big") for i in range(3000)] + [(5000 + i, "four short words here", "rare") for i in range(10)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows_per_shard=50)
    got = {r.source: (r.n, r.t) for r in out.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()}
    assert got["rare"] == (80, 80.0) and abs(got["big"][0] - got["big"][1]) <= 1


def test_mixing_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        before, after = docs.count(), out.count()
        assert after <= before or name == "mixing"
        docs = corpus_pipeline.cut(out)
    end = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert end.count() == docs.count() and {"shard", "slot"} <= set(end.columns)


def test_pipeline_stages_on_nulls_and_nothing(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, "the people of the house and the water with that", "en", None, 3), (1, "the people of the house and the water with that", "en", None, 3), (2, None, None, None, None), (None, "the water of the people and that house with the", "en", "a", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema).withColumn("shard", F.lit("x"))
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.cut(stage(spark, docs, SF))
        assert docs.count() <= 8
        if data:
            assert docs.where("text is null").count() == 0
            assert 1 <= docs.select("doc_id").distinct().count() <= 2  # the mix may leave a small source out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0 or name.startswith("op7")
