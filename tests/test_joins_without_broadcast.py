"""Joins of the graph's tables are merged: a compressed file's size says little of its rows, so none of them goes through the driver."""

import pytest
from pyspark.sql import functions as F

from trackloom.config import DEFAULT
from trackloom.operators import events as E, graph, lifecycle as L, motion, zones
from trackloom.operators.neighbours import overlapping, within
from trackloom.plans import traversals as Q

CFG = DEFAULT.merge({"near_miss": {"dedup_frames": 4}, "convoy": {"frames": 2}, "crowd": {"density": 2.0, "window": 6}, "jaywalking": {"vehicle_ratio": 0.5}})


@pytest.fixture(scope="module")
def states(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("states") / "t")
    t = spark.range(600).select(
        F.concat(F.lit("s"), F.expr("cast(id % 3 as string)")).alias("sequence_id"), F.expr("id div 3 % 10").alias("track_id"), F.expr("cast(id div 30 as int)").alias("frame_id"),
        F.element_at(F.array(*map(F.lit, ("pedestrian", "car", "truck"))), F.expr("cast(id div 3 % 3 + 1 as int)")).alias("class_name"),
        *((F.expr("id * 37 % 200") + o).cast("double").alias(c) for c, o in (("x1", 0), ("y1", 0), ("x2", 40), ("y2", 40))), F.lit(1000.0).alias("frame_width"), F.lit(1000.0).alias("frame_height"), F.lit(0).alias("occlusion"),
    )
    t.write.parquet(path)
    return motion.enrich(spark.read.parquet(path), CFG)


PLANS = {
    "within": lambda s: within(s, s, 0.1, ("track_id",)),
    "overlapping": lambda s: overlapping(s, s, 0.05, ("track_id",)),
    "near": lambda s: graph.near(s, CFG),
    "all_events": lambda s: E.all_events(s, CFG),
    "lost": lambda s: motion.lost(s, motion.frames(s)),
    "approaching": L.approaching,
    "following": lambda s: L.following(s, motion.frames(s)),
    "surges": lambda s: zones.surges(zones.frame_stats(s, CFG), motion.frames(s), 6, 2.0),
    "occurred_in": lambda s: graph.build(s, CFG)["edge_occurred_in"],
    "involves": lambda s: graph.build(s, CFG)["edge_involves"],
    "events_of": lambda s: Q.events_of(graph.build(s, CFG), None),
    "near_misses_in": lambda s: Q.near_misses_in(graph.build(s, CFG), weather="clear"),
    "violations": lambda s: L.graph_violations(graph.build(s, CFG)),
}


@pytest.mark.parametrize("name", PLANS)
def test_no_side_is_broadcast(states, name):
    plan = PLANS[name](states)._jdf.queryExecution().executedPlan().toString()
    kept = [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "name#" not in x]  # the twelve classes are broadcast on purpose
    assert "SortMergeJoin" in plan and not kept
