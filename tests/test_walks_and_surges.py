"""Walks over cyclic graphs, density surges and row differences against plain Python."""

import random
from collections import Counter

import pytest

from trackloom.operators import evaluation as V, zones
from trackloom.plans import traversals as Q
from trackloom.sources import sequences as S


def walks(edges, starts, low, high):
    """Fewest edges of a walk of low to high edges, by sets of nodes."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in starts:
        at = {s}
        for k in range((high if high is not None else 40) + 1):
            if k >= low:
                for b in at:
                    out.setdefault((s, b), k)
            at = {y for x in at for y in near.get(x, ())}
    return out


@pytest.mark.parametrize(("low", "high"), [(0, 2), (1, 3), (1, 10), (2, 5), (1, None), (3, None)])
def test_reach_on_a_cyclic_graph(spark, low, high):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 4), (8, 8), (9, 10), (10, 9), (2, 3)]
    df = spark.createDataFrame(edges, "x long, y long")
    got = {(r.a, r.b): r.hops for r in Q.reach(df, spark.createDataFrame([(1,), (8,), (9,), (99,), (None,), (1,)], "n long"), "x", "y", low, high).collect()}
    want = walks(edges, (1, 8, 9, 99), low, high)
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] for k in want)


def test_reach_of_nothing(spark):
    none = spark.createDataFrame([], "x long, y long")
    assert Q.paths(none, "x", "y", 1, None).count() == Q.paths(none, "x", "y", 0, 3).count() == 0
    assert [tuple(r) for r in Q.reach(none, spark.createDataFrame([(4,)], "n long"), "x", "y", 0, 2).collect()] == [(4, 4, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_surges_equal_a_walk_over_all_frames(spark, seed):
    rng = random.Random(seed)
    frames = sorted(rng.sample(range(120), 70))
    seen = {z: {f: float(rng.choice((0, 1, 2, 4, 9))) for f in frames if rng.random() < share} for z, share in (("a", 1.0), ("b", 0.4), ("c", 0.08))}
    window, least, want = 7, 2.0, []
    for z, d in seen.items():
        for f in frames:
            inside = [(g, x) for g, x in sorted(d.items()) if f - window < g <= f]
            if inside and inside[-1][1] >= least and inside[-1][1] > 2 * inside[0][1]:
                want.append((f, z, inside[-1][1]))
    stats = spark.createDataFrame([("s", f, z, x) for z, d in seen.items() for f, x in d.items()], "sequence_id string, frame_id int, zone_id string, density double")
    table = spark.createDataFrame([("s", f) for f in frames], "sequence_id string, frame_id int")
    got = [(r.frame_id, r.zone_id, r.current) for r in zones.surges(stats, table, window, least).collect()]
    assert sorted(got) == sorted(want) and want


def test_a_quiet_zone_costs_its_changes(spark):
    """One burst in 20,000 frames: what meets the frames is one interval, not a row for every frame."""
    stats = spark.createDataFrame([("s", 0, "z", 1.0), ("s", 3, "z", 9.0)], "sequence_id string, frame_id int, zone_id string, density double")
    table = spark.range(20_000).selectExpr("'s' AS sequence_id", "cast(id AS int) AS frame_id")
    got = [r.frame_id for r in zones.surges(stats, table, 60, 8.0).collect()]
    assert sorted(got) == list(range(3, 60))


def test_difference_counts_multisets(spark):
    rng = random.Random(4)
    rows = lambda n: [(rng.choice([None, "a", "b"]), rng.randint(0, 2)) for _ in range(n)]
    for a, b in ((rows(20), rows(25)), (rows(5), []), ([], []), ([("a", 1)] * 2, [("a", 1)])):
        r = V.difference(spark.createDataFrame(a, "k string, v int"), spark.createDataFrame(b, "k string, v int")).head()
        x, y = Counter(a), Counter(b)
        assert (r.missing, r.extra, r.equal) == ((x - y).total(), (y - x).total(), x == y)
    again = rows(30)
    assert V.same_rows(spark.createDataFrame(again, "k string, v int"), spark.createDataFrame(again[::-1], "k string, v int"))


def test_manifests_as_rows(spark):
    df = spark.createDataFrame([(1, '["a", "b"]'), (2, ' {"sequence_ids": ["c"]}'), (3, "[]")], "m int, value string")
    assert sorted((r.m, r.sequence_id) for r in S.manifest_rows(df).collect()) == [(1, "a"), (1, "b"), (2, "c")]
    for wrong in ('"text"', "{}", '{"other": []}', ""):
        with pytest.raises(Exception, match="manifest"):
            S.manifest_rows(spark.createDataFrame([(wrong,)], "value string")).collect()
