"""Streams in several micro-batches: state is carried, late rows find their place, upserts merge, a live pace is kept."""

import random

import pandas as pd
from pyspark.sql import functions as F

from trackloom.config import DEFAULT
from trackloom.operators import events as E
from trackloom.streaming import events as stream

CFG = DEFAULT.merge({"loiter": {"frames": 5}})
SCHEMA = "sequence_id string, track_id long, frame_id int, class_name string, movement_pattern string, zone_id string, event_role string"


def run(spark, batches, build, path, late="5 seconds"):
    """A micro-batch for each list of rows, then one far later row; everything that was emitted."""
    for k, rows in enumerate([*batches, [("s", 999, 10_000, "car", "linear", "z", "vehicle")]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    for _ in range(2):
        q = build(source, CFG, late).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    return spark.read.parquet(f"{path}/out"), len(q.recentProgress)


def test_loiter_counts_in_frame_order_over_batches(spark, tmp_path):
    row = lambda f, z="a", p="stationary", t=1: ("s", t, f, "person", p, z, "pedestrian")
    batches = [[row(1), row(2), row(4)], [row(3), row(5), row(6)], [row(8, "b"), row(7), row(9, "b")], [row(f, t=2) for f in (12, 10)], [row(f, t=2) for f in (11, 13, 14)]]
    got, _ = run(spark, batches, stream.loiter, str(tmp_path))
    whole = E.loiter(spark.createDataFrame([r for b in batches for r in b], SCHEMA), CFG)
    key = lambda df: sorted((r.primary_track_id, r.frame_id, r.zone_id) for r in df.collect())
    assert key(got) == key(whole) == [(1, 5, "a"), (2, 14, "a")]


def test_zone_statistics_close_with_the_watermark(spark, tmp_path):
    rng = random.Random(2)
    rows = [("s", t, f, "car", "linear", rng.choice("xy"), "vehicle") for f in range(30) for t in range(4)]
    batches = [rows[k : k + 12] for k in range(0, len(rows), 12)]
    batches[3], batches[4] = batches[4], batches[3]  # three frames late
    got, _ = run(spark, batches, stream.zone_stats, str(tmp_path))
    want = {}
    for _, _, f, _, _, z, _ in rows:
        want[f, z] = want.get((f, z), 0) + 1
    assert {(r.frame_id, r.zone_id): r.vehicle_count for r in got.where("frame_id < 1000").collect()} == want


def test_upserts_keep_the_last_write_over_batches(spark, tmp_path):
    put = stream.upsert_sink(str(tmp_path / "t"), ["k"], ["v"])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, frame_id int, v int")
    put(batch(("a", 1, 10), ("a", 3, 30), ("b", 2, 20)), 0)
    put(batch(("a", 2, 99), ("b", 2, 21), ("c", 5, 50)), 1)
    put(batch(("c", 7, 70)), 2)
    put(batch(("c", 6, 60)), 2)  # the batch is replayed with other rows: only they count
    got = stream.upserted(spark, str(tmp_path / "t"), ["k"], ["v"])
    assert {r.k: (r.frame_id, r.v) for r in got.collect()} == {"a": (3, 30), "b": (2, 21), "c": (6, 60)}


def test_a_live_pace_spreads_the_batches(spark, tmp_path):
    rows = [("s", 1, f, "car", "linear", "z", "vehicle") for f in range(12)]
    source, seen = stream.frame_batches(spark.createDataFrame(rows, SCHEMA), 3), []
    q = stream.start(source, lambda df, n: seen.append(df.agg(F.min("frame_id"), F.max("frame_id")).head()), str(tmp_path / "ck"), frames_per_second=10, batch_frames=3)
    for _ in range(100):
        if len(seen) >= 4:
            break
        q.awaitTermination(0.3)
    q.stop()
    assert [tuple(r) for r in seen[:4]] == [(0, 2), (3, 5), (6, 8), (9, 11)]


class Calls:
    """A group's state as the rule sees it."""

    def __init__(self):
        self.get, self.hasTimedOut, self.watermark, self.wakes = None, False, 0, []

    exists = property(lambda self: self.get is not None)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, new):
        self.get = new

    def remove(self):
        self.get = None

    def setTimeoutTimestamp(self, at):
        self.wakes.append(at)


def test_many_tracks_share_a_call(spark, tmp_path, monkeypatch):
    rules = []

    class Grouped:
        def applyInPandasWithState(self, run, out, state, mode, timeout):
            rules.append(run)
            return spark.createDataFrame([], out)

    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    monkeypatch.setattr(type(source), "groupBy", lambda self, *keys: rules.append(keys) or Grouped())
    stream.loiter(source, CFG)
    keys, rule = rules
    assert keys == ("dealt",)
    rows = lambda frames: iter([pd.DataFrame([("s", t, f, "person", "stationary", "a") for f in frames for t in range(40)], columns=["sequence_id", "track_id", "frame_id", "class_name", "movement_pattern", "zone_id"])])
    state, at = Calls(), lambda frame: stream.FIRST_MS + 1000 * frame
    assert pd.concat(rule((0,), rows((3, 1, 2)), state)).empty and state.wakes == [at(1)]
    state.watermark = at(4)
    assert pd.concat(rule((0,), rows((6, 4)), state)).empty and state.wakes[-1] == at(4) + 1
    state.watermark, state.hasTimedOut = at(7), True
    out = pd.concat(rule((0,), iter([]), state))
    assert sorted(zip(out["track_id"], out["frame_id"], out["zone_id"])) == [(t, 6, "a") for t in range(40)] and state.wakes[-1] == at(6 + stream.SILENT + 1)
    state.watermark = at(6 + stream.SILENT + 2)
    assert pd.concat(rule((0,), iter([]), state)).empty and not state.exists


def test_loitering_of_many_tracks_over_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"s{t % 3}", t, f, rng.choice(("person", "person", "person", "car")), rng.choice(("stationary",) * 9 + ("linear",)), rng.choice("aaaaab"), "pedestrian") for t in range(30) for f in range(60) if rng.random() < 0.9]
    batches = [[r for r in rows if r[2] // 12 == k] for k in range(5)]
    got, _ = run(spark, batches, lambda s, cfg, late: stream.loiter(s, cfg, late, groups=4), str(tmp_path))
    key = lambda df: sorted((r.sequence_id, r.primary_track_id, r.frame_id, r.zone_id) for r in df.collect())
    want = key(E.loiter(spark.createDataFrame(rows, SCHEMA), CFG))
    assert key(got) == want and len(want) > 30
