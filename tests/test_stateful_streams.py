"""Stateful stream rules against their batch rules over micro-batches out of order; what is kept goes away."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from trackloom.config import DEFAULT
from trackloom.operators import events as E, motion, zones
from trackloom.streaming import behaviour as B

CFG = DEFAULT.merge({"near_miss": {"dedup_frames": 4}, "convoy": {"frames": 2}, "crowd": {"density": 3.0, "window": 6}, "jaywalking": {"vehicle_ratio": 0.6}})
SCHEMA = "sequence_id string, track_id long, frame_id int, class_name string, event_role string, zone_id string, cx double, cy double, speed double, heading_deg double"
ROLES = {"pedestrian": "pedestrian", "car": "vehicle", "truck": "vehicle", "dog": None}


def state(rng, sequence, frame, track):
    name = ("pedestrian", "car", "car", "truck", "pedestrian", "dog")[track % 6]
    return sequence, track, frame, name, ROLES[name], rng.choice(("z0", "z0", "z1", "z2")), 0.3 + 0.01 * rng.randint(0, 12), 0.3 + 0.01 * rng.randint(0, 12), 0.02, float(rng.choice((0, 5, 90)))


def table(seed, frames=40, tracks=9):
    """Frames with few and many objects, and with none."""
    rng = random.Random(seed)
    rows = []
    for sequence in ("s1", "s2"):
        for frame in range(frames):
            if rng.random() < 0.85:
                rows += [state(rng, sequence, frame, t) for t in rng.sample(range(tracks), rng.choice((1, 3, tracks)))]
    return rows


def batches_of(rows, rng, late):
    """In order of arrival: the frame plus a delay of less than the watermark's."""
    arrived = sorted(rows, key=lambda r: r[2] + rng.uniform(0, late - 1))
    cuts = [0, *sorted(rng.sample(range(len(arrived)), 2)), len(arrived)]
    return [arrived[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


@contextmanager
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, batches, build, path, far=100_000, more=1):
    """A micro-batch for each list of rows, then later rows: the first moves the watermark, ``more`` batches run under it."""
    for rows in [*batches, *([("far", 999, far, "dog", None, "z", 0.0, 0.0, 0.0, 0.0)] for _ in range(1 + more))]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with B.rocks(spark), few_partitions(spark):
        q = build(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    return spark.read.parquet(f"{path}/out")


def rounded(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.na.fill(-9).na.fill("-").collect())


RULES = {
    "near_miss": (lambda s: B.near_miss(s, CFG, "5 seconds"), lambda s: E.near_miss(s, CFG)),
    "convoy": (lambda s: B.convoy(s, CFG, "5 seconds"), lambda s: E.convoy(s, motion.frames(s), CFG)),
    "crowd": (lambda s: B.crowd_form(s, CFG, "5 seconds"), lambda s: E.crowd_form(zones.frame_stats(s, CFG), motion.frames(s), CFG)),
    "jaywalking": (lambda s: B.jaywalking(s, CFG, "5 seconds"), lambda s: E.jaywalking(s, zones.frame_stats(s, CFG), CFG)),
}


@pytest.mark.parametrize("rule", RULES)
def test_a_stream_out_of_order_equals_the_batch_rule(spark, tmp_path, rule):
    rows = table(list(RULES).index(rule))
    stream, batch = RULES[rule]
    want = rounded(batch(spark.createDataFrame(rows, SCHEMA)))
    got = run(spark, batches_of(rows, random.Random(7), 5), stream, str(tmp_path))
    assert rounded(got) == want and len(want) >= 5


def kept(spark, path, variable, number=0):
    """Rows of a state variable at the end of a run."""
    return spark.read.format("statestore").option("stateVarName", variable).option("operatorId", number).load(f"{path}/ck").count()


def test_a_silent_pair_leaves_no_state(spark, tmp_path):
    row = lambda f, t, name: ("s", t, f, name, ROLES[name], "z", 0.5, 0.5, 0.02, 0.0)
    rows = [row(f, t, n) for f in (0, 1, 5, 6) for t, n in ((1, "pedestrian"), (2, "car"))]
    early, whole = str(tmp_path / "early"), str(tmp_path / "whole")
    got = run(spark, [rows], RULES["near_miss"][0], early, far=14)  # past the last hit, not past its cool-down
    assert {r.frame_id for r in got.collect()} == {0, 5} and kept(spark, early, "fired") == 1
    got = run(spark, [rows], RULES["near_miss"][0], whole, more=2)  # timers set in a batch fire in the next one
    assert {r.frame_id for r in got.collect()} == {0, 5}
    assert kept(spark, whole, "fired") == kept(spark, whole, "last") == kept(spark, whole, "waiting") == 0


def test_a_broken_convoy_and_a_silent_sequence_leave_no_state(spark, tmp_path):
    car = lambda f, t, x, s="s": (s, t, f, "car", "vehicle", "z", x, 0.5, 0.02, 0.0)
    rows = [car(f, t, 0.5 + 0.05 * t) for f in range(4) for t in (1, 2)] + [car(9, 7, 0.1)]
    got = run(spark, [rows], lambda s: B.convoy(s, CFG, "2 seconds", silent=100), str(tmp_path / "a"), far=40)
    assert [(r.frame_id, r.primary_track_id, r.secondary_track_id) for r in got.collect()] == [(1, 1, 2)]
    assert kept(spark, str(tmp_path / "a"), "runs") == 0  # frame 9 has other cars only
    rows = [car(f, t, 0.5 + 0.05 * t) for f in range(2) for t in (1, 2)]
    for far, left in ((40, 1), (400, 0)):
        run(spark, [rows], lambda s: B.convoy(s, CFG, "2 seconds", silent=100), str(tmp_path / str(far)), far=far, more=2)
        assert kept(spark, str(tmp_path / str(far)), "runs") == left


def test_late_rows_join_two_visits(spark, tmp_path):
    row = lambda f, z="a", t=1: ("s", t, f, "car", "vehicle", z, 0.0, 0.0, 0.0, 0.0)
    batches = [[row(0), row(2), row(8), row(1, t=2)], [row(5)], [row(12), row(40)], [row(41)], [row(5, t=2), row(6, t=2)]]  # the last two come too late
    got = run(spark, batches, lambda s: B.zone_visits(s, gap=3, late="20 seconds"), str(tmp_path))
    seen = sorted((r.track_id, r.first_frame, r.last_frame, r.n_states) for r in got.where("sequence_id = 's'").collect())
    assert seen == [(1, 0, 12, 5), (1, 40, 41, 2), (2, 1, 1, 1)]


def test_visits_equal_islands(spark, tmp_path):
    rows = [r[:3] + r[3:] for r in table(5)]
    got = run(spark, batches_of(rows, random.Random(3), 5), lambda s: B.zone_visits(s, gap=3, late="5 seconds"), str(tmp_path))
    visits, last = {}, {}
    for s, t, f, *_, in sorted(rows, key=lambda r: r[2]):
        z = next(r[5] for r in rows if r[:3] == (s, t, f))
        key = (s, t, z)
        if key not in last or f - last[key] > 4:
            visits[key, f] = [f, f, 0]
            current = f
        else:
            current = next(a for (k, a) in reversed(list(visits)) if k == key)
        visits[key, current][1] = f
        visits[key, current][2] += 1
        last[key] = f
    want = sorted((*k, *v) for (k, _), v in visits.items())
    assert sorted((r.sequence_id, r.track_id, r.zone_id, r.first_frame, r.last_frame, r.n_states) for r in got.where(F.col("sequence_id") != "far").collect()) == want
