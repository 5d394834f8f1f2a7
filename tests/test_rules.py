"""Motion, zones and event rules on literal fixtures with known results."""

import pytest
from pyspark.sql import functions as F

from trackloom.config import DEFAULT
from trackloom.functions import geometry as G
from trackloom.operators import events as E, motion, zones

CFG = DEFAULT.merge(
    {"loiter": {"frames": 3}, "convoy": {"frames": 3}, "crowd": {"density": 3.0, "window": 4}, "motion": {"buffer": 3}}
)


def states(spark, rows):
    """rows: (track, frame, class, cx, cy, zone, speed, heading, pattern)"""
    df = spark.createDataFrame(
        [("s", *r) for r in rows],
        "sequence_id string, track_id long, frame_id int, class_name string, cx double, cy double, zone_id string, speed double, heading_deg double, movement_pattern string",
    )
    return df.withColumn("event_role", motion.role(F.col("class_name")))


def test_motion_features(spark):
    boxes = [(0, [0, 0, 100, 100]), (1, [20, 0, 120, 100]), (2, [40, 0, 140, 100]), (3, [60, 0, 160, 100])]
    df = spark.createDataFrame([("s", 1, f, "car", *map(float, b), 200.0, 200.0, 0) for f, b in boxes], "sequence_id string, track_id long, frame_id int, class_name string, x1 double, y1 double, x2 double, y2 double, frame_width double, frame_height double, occlusion int")
    out = motion.enrich(df, CFG).orderBy("frame_id").collect()
    assert [(round(r.speed, 9), r.heading_deg, r.movement_pattern) for r in out] == [(0, 0, "stationary")] + [(0.1, 0, "linear")] * 3
    assert out[0].zone_id == "cell_1_1"
    assert [[round(x, 9) for x in p] for p in out[3].trajectory] == [[0.35, 0.25], [0.45, 0.25], [0.55, 0.25]]


@pytest.mark.parametrize("cx,cy,zone", [(0.74, 0.26, "cell_1_2"), (1.2, 0.0, "cell_0_3"), (-0.3, 0.1, "cell_0_-1")])
def test_zone(spark, cx, cy, zone):
    assert spark.range(1).select(G.zone_id(F.lit(cx), F.lit(cy)).alias("z")).head().z == zone


@pytest.mark.parametrize("s,h,want", [([0.001, 0.002], [0, 0], "stationary"), ([0.01, 0.012], [10, 12], "linear"), ([0.01, 0.012, 0.02], [0, 90, 180], "erratic"), ([0.1] * 3, [359, 1, 359], "erratic")])
def test_movement_class(spark, s, h, want):
    df = spark.createDataFrame(list(zip(map(float, s), map(float, h))), "s double, h double")
    assert df.agg(F.avg("s").alias("s"), F.var_pop("h").alias("v")).select(motion.classify(F.col("s"), F.col("v")).alias("m")).head().m == want


def test_heading_and_iou(spark):
    one = spark.range(1).select(
        G.heading(F.lit(0.0), F.lit(0.2)).alias("up"), G.heading(F.lit(0.0), F.lit(-1.0)).alias("down"), G.heading_difference(F.lit(350.0), F.lit(10.0)).alias("d"),
        G.iou(tuple(map(F.lit, (0.0, 0.0, 2.0, 2.0))), tuple(map(F.lit, (1.0, 0.0, 3.0, 2.0)))).alias("i"), G.iou(tuple(map(F.lit, (0.0, 0.0, 1.0, 1.0))), tuple(map(F.lit, (2.0, 2.0, 3.0, 3.0)))).alias("none"),
        G.inverse_score(F.lit(5), 10).alias("half"), G.inverse_score(F.lit(5), 0).alias("zero"),
    ).head()
    assert (one.up, one.down, one.d, round(one.i, 9), one.none, one.half, one.zero) == (90, 270, 20, round(1 / 3, 9), 0, 0.5, 0)


def test_near_miss_cooldown(spark):
    rows = [(t, f, c, x, y, "z", v, 0.0, "linear") for f in (0, 5, 10, 20) for t, c, x, y, v in ((1, "pedestrian", 0.10, 0.10, 0.01), (2, "car", 0.13, 0.12, 0.02))]
    out = E.near_miss(states(spark, rows)).orderBy("frame_id").collect()
    assert [(r.frame_id, r.primary_track_id, r.secondary_track_id) for r in out] == [(0, 1, 2), (20, 1, 2)]
    assert abs(out[0].distance - 0.0013**0.5) < 1e-9 and abs(out[0].confidence - (1 - 0.0013**0.5 / 0.05)) < 1e-9


def test_loiter_survives_a_missed_frame(spark):
    row = lambda f, z="z", p="stationary": (1, f, "pedestrian", 0.1, 0.1, z, 0.0, 0.0, p)
    assert [r.frame_id for r in E.loiter(states(spark, [row(1), row(2), row(3), row(4)]), CFG).collect()] == [3]
    assert [r.frame_id for r in E.loiter(states(spark, [row(1), row(2), row(9)]), CFG).collect()] == [9]
    assert E.loiter(states(spark, [row(1), row(2, "other"), row(3)]), CFG).count() == 0
    assert E.loiter(states(spark, [row(1), row(2, p="linear"), row(3), row(4)]), CFG).count() == 0


def test_convoy_resets_on_a_missed_processed_frame(spark):
    pair = lambda f: [(1, f, "truck", 0.20, 0.20, "z", 0.1, 10.0, "linear"), (2, f, "truck", 0.28, 0.21, "z", 0.1, 18.0, "linear")]
    s = states(spark, [r for f in (1, 2, 3) for r in pair(f)])
    assert [r.frame_id for r in E.convoy(s, motion.frames(s), CFG).collect()] == [3]
    alone = (9, 3, "car", 0.9, 0.9, "z", 0.1, 0.0, "linear")
    s = states(spark, [r for f in (1, 2, 4) for r in pair(f)] + [alone])
    assert E.convoy(s, motion.frames(s), CFG).count() == 0


def test_crowd_fires_while_stale(spark):
    walkers = lambda f, n: [(10 + k, f, "pedestrian", 0.1, 0.1, "cell_0_0", 0.0, 0.0, "linear") for k in range(n)]
    other = lambda f: [(1, f, "car", 0.9, 0.9, "cell_3_3", 0.0, 0.0, "linear")]
    s = states(spark, walkers(1, 1) + walkers(2, 3) + other(3) + other(9))
    out = E.crowd_form(zones.frame_stats(s), motion.frames(s), CFG).orderBy("frame_id").collect()
    assert [(r.frame_id, r.zone_id, r.density, r.primary_track_id) for r in out] == [(2, "cell_0_0", 3.0, -1), (3, "cell_0_0", 3.0, -1)]
    s = states(spark, walkers(1, 3))
    assert E.crowd_form(zones.frame_stats(s), motion.frames(s), CFG).count() == 0


def test_jaywalking_and_zone_stats(spark):
    s = states(spark, [(1, 1, "pedestrian", 0.1, 0.1, "z", 0.0, 0.0, "linear")] + [(2 + k, 1, "car", 0.1, 0.1, "z", 0.0, 0.0, "linear") for k in range(5)] + [(9, 1, "dog", 0.9, 0.9, "q", 0.0, 0.0, "linear")])
    stats = zones.frame_stats(s)
    (e,) = E.jaywalking(s, stats).collect()
    assert abs(e.confidence - 5 / 6) < 1e-9
    by = {r.zone_id: r for r in stats.collect()}
    assert (by["z"].density, by["q"].density, by["q"].vehicle_ratio) == (6.0, 0.0, 0.0)


def test_event_metadata_and_keys(spark):
    s = states(spark, [(1, 1, "pedestrian", 0.1, 0.1, "z", 0.0, 0.0, "stationary")])
    (e,) = E.keyed(E.metadata_json(E.loiter(s, CFG.merge({"loiter": {"frames": 1}})))).collect()
    assert (e.event_key, e.metadata_json) == ("s:1:LOITER:1:None", '{"zone":"z"}')


def test_config_merge():
    assert CFG.loiter.frames == 3 and DEFAULT.loiter.frames == 90 and CFG.loiter.classes == DEFAULT.loiter.classes
    for bad in ({"nope": 1}, {"loiter": 5}, [1]):
        with pytest.raises(ValueError):
            DEFAULT.merge(bad)
