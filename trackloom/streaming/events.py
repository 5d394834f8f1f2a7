"""The stateful parts as Structured Streaming: zone statistics with a watermark, loiter runs with keyed state.

Frames are event time: frame n is n seconds after the first day of the epoch (a time of
zero would count as late before any watermark is known).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Config
from ..operators import events as E
from ..sources.shared import folder

LATE = "10 seconds"
FIRST_MS = 86_400_000
#: A frame far behind all others.
FAR = 10_000_000
#: A track without news for so many frames is forgotten.
SILENT = 3600
#: Tracks of a loitering stream share so many keys.
GROUPS = 1024


def with_time(states: DataFrame) -> DataFrame:
    return states.withColumn("event_ts", F.timestamp_seconds(F.col("frame_id") + 86_400))


def zone_stats(stream: DataFrame, cfg: Config = DEFAULT, late: str = LATE) -> DataFrame:
    """Zone statistics of a stream of states, emitted once a frame is older than the watermark."""
    n = lambda r: F.count_if(F.col("event_role") == r)
    z = with_time(stream).withWatermark("event_ts", late).groupBy("event_ts", "sequence_id", "frame_id", "zone_id")
    z = z.agg(n("pedestrian").alias("pedestrian_count"), n("vehicle").alias("vehicle_count"))
    total = F.col("pedestrian_count") + F.col("vehicle_count")
    ratio = lambda c, d: F.when(total > 0, F.col(c) / total).otherwise(d)
    return z.withColumns({"density": total.cast("double"), "pedestrian_ratio": ratio("pedestrian_count", cfg.zones.pedestrian_ratio), "vehicle_ratio": ratio("vehicle_count", cfg.zones.vehicle_ratio)}).drop("event_ts")


def sliding_density(stream: DataFrame, width: int = 10, step: int = 5, late: str = LATE) -> DataFrame:
    """(sequence_id, zone_id, first_frame, n_states): states of a zone in windows of ``width`` frames, one every ``step`` frames."""
    w = F.window("event_ts", f"{width} seconds", f"{step} seconds")
    counts = with_time(stream).withWatermark("event_ts", late).groupBy(w.alias("w"), "sequence_id", "zone_id").agg(F.count(F.lit(1)).alias("n_states"))
    return counts.select("sequence_id", "zone_id", (F.unix_timestamp(F.col("w.start")) - FIRST_MS // 1000).cast("int").alias("first_frame"), "n_states")


def loiter(stream: DataFrame, cfg: Config = DEFAULT, late: str = LATE, groups: int = GROUPS) -> DataFrame:
    """LOITER events; the state of a track is its zone, its run and the observations that are not yet older than the watermark.

    Observations count in frame order, whatever order they arrive in within the watermark; later
    ones are dropped by it.  A track whose observations are all counted keeps three values, and is
    forgotten if it stays silent for ``SILENT`` frames.  Tracks are dealt by a hash to ``groups`` keys,
    so a micro-batch makes at most that many calls, however many tracks it holds; a stream keeps its
    number for as long as its checkpoint.
    """
    limit, classes = cfg.loiter.frames, set(cfg.loiter.classes)
    names = ["sequence_id", "track_id", "frame_id", "zone_id"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks = _held(state.get) if state.exists else {}
        if not state.hasTimedOut:
            for p in batches:
                for s, t, f, c, m, z in zip(*(p[n].tolist() for n in ("sequence_id", "track_id", "frame_id", "class_name", "movement_pattern", "zone_id"))):
                    own = tracks.get((s, t))
                    if own is None:
                        own = tracks[s, t] = ["", 0, 0, []]
                    own[3].append((f, c in classes and m == "stationary", z))
        due = (state.getCurrentWatermarkMs() - FIRST_MS) / 1000  # no row of an earlier frame can come any more
        out, kept = [], {}
        for track, (zone, count, last, waiting) in tracks.items():
            waiting.sort()
            counted = 0
            for f, ok, z in waiting:
                if f >= due:
                    break
                counted += 1
                count = count + 1 if ok and count and zone == z else int(ok)
                zone, last = z, f
                if ok and count == limit:
                    out.append((*track, f, z))
            waiting = waiting[counted:]
            if waiting or last + SILENT >= due:
                kept[track] = (zone, count, last, waiting)
        if kept:
            state.update(_flat(kept))
            wake = min(waiting[0][0] if waiting else last + SILENT + 1 for _, _, last, waiting in kept.values())
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, FIRST_MS + 1000 * wake))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    timed = with_time(stream.select("sequence_id", "track_id", "frame_id", "class_name", "movement_pattern", "zone_id")).withWatermark("event_ts", late)
    found = timed.withColumn("dealt", F.pmod(F.xxhash64("sequence_id", "track_id"), F.lit(groups))).groupBy("dealt").applyInPandasWithState(
        run, "sequence_id string, track_id long, frame_id int, zone_id string",
        "sequences array<string>, tracks array<long>, zone array<string>, n array<long>, last array<int>, of array<int>, frames array<long>, still array<boolean>, zones array<string>", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return E._events(found.withColumnRenamed("track_id", "primary_track_id").withColumn("confidence", F.lit(1.0)), "LOITER")


def _held(arrays: tuple) -> dict[tuple, list]:
    """Tracks of a group from its state: zone, run, last frame, waiting observations."""
    sequences, ids, zone, count, last, of, *waiting = arrays
    own = [[*x, []] for x in zip(zone, count, last)]
    for k, w in zip(of, zip(*waiting)):
        own[k][3].append(w)
    return dict(zip(zip(sequences, ids), own))


def _flat(tracks: dict[tuple, tuple]) -> tuple:
    """The state of a group: arrays over its tracks, then over their waiting observations, each with its track's place."""
    columns = [[s for s, _ in tracks], [t for _, t in tracks], *([x[k] for x in tracks.values()] for k in range(3))]
    waiting = [(k, *w) for k, x in enumerate(tracks.values()) for w in x[3]]
    return (*columns, *([w[k] for w in waiting] for k in range(4)))


def upsert_sink(path: str, keys: list[str], values: list[str], by: str = "frame_id") -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: the last write of each key in a micro-batch; a replayed batch overwrites its own folder."""
    from ..operators.graph import last_write

    def put(batch: DataFrame, number: int) -> None:
        last_write(batch, keys, values, by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def upserted(spark: SparkSession, path: str, keys: list[str], values: list[str], by: str = "frame_id") -> DataFrame:
    """What an ``upsert_sink`` holds: one row per key, the last write over all batches (of equal ``by`` the later batch)."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(by, *values), F.struct(by, "batch")).alias("s"))
    return newest.select(*keys, "s.*")


def start(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, frames_per_second: float | None = None, batch_frames: int = DEFAULT.graph.batch_frames):
    """Run a stream into a ``foreachBatch`` writer; with a frame rate at the pace of a live feed of ``batch_frames`` a batch, else all that is there."""
    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    if frames_per_second is None:
        return w.trigger(availableNow=True).start()
    return w.trigger(processingTime=f"{max(1, round(1000 * batch_frames / frames_per_second))} milliseconds").start()


def frame_batches(states: DataFrame, frames: int, closing: bool = False) -> DataFrame:
    """A stream over a finite table: a micro-batch for every so many frames, in their order.

    The table is written once, a file for each batch; the files' times, which put them in order,
    are set afterwards, so the store must allow that.  ``closing`` adds two batches of one far
    later row each: the first moves the watermark past everything, the second runs under it.
    """
    spark = states.sparkSession
    top = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    whole = states.withColumn("batch", F.floor(F.col("frame_id") / frames).cast("int"))
    if closing:
        one = states.limit(1)
        for k in (0, 1):
            whole = whole.unionByName(one.withColumns({"frame_id": (F.lit(FAR) + k).cast("int"), "batch": F.lit(FAR) + k}))
    whole.repartition("batch").write.partitionBy("batch").parquet(top)
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    batches = [x.getPath() for x in fs.listStatus(path) if x.isDirectory()]
    for second, at in enumerate(sorted(batches, key=lambda p: int(p.getName().removeprefix("batch=")))):
        for file in fs.listStatus(at):
            fs.setTimes(file.getPath(), 1_000_000_000_000 + 1000 * second, -1)
    return spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(top).drop("batch")


def _replay(states: DataFrame, build: Callable[[DataFrame], DataFrame], frames: int = 10) -> DataFrame:
    """Run a streaming plan over a finite table in batches of frames to its end and read what it wrote."""
    spark = states.sparkSession
    source = frame_batches(states, frames, closing=True)
    out = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    q = build(source).writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(f"{out}/out")


def replay(states: DataFrame, rule: Callable[[DataFrame], DataFrame], frames: int = 20) -> DataFrame:
    """A rule of ``behaviour`` over a finite table."""
    from .behaviour import rocks

    with rocks(states.sparkSession):
        return _replay(states.drop("trajectory"), rule, frames).where(F.coalesce("frame_id", F.lit(0)) < FAR)


def replay_zone_stats(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return _replay(states.drop("trajectory"), lambda s: zone_stats(s, cfg))


def replay_loiter(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return _replay(states.drop("trajectory"), lambda s: loiter(s, cfg))


def replay_windows(states: DataFrame) -> DataFrame:
    return _replay(states.drop("trajectory"), sliding_density).where("first_frame < 1000000")


def replay_upserts(states: DataFrame, cfg: Config = DEFAULT, frames: int = 10) -> DataFrame:
    """NEAR edges written batch by batch, as a graph store would hold them in the end."""
    from ..operators.graph import near_pairs

    spark = states.sparkSession
    out = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    keys, values = ["sequence_id", "a_track_id", "b_track_id"], ["distance", "both_moving"]
    put = upsert_sink(f"{out}/near", keys, values)
    q = start(frame_batches(states.drop("trajectory"), frames), lambda batch, number: put(near_pairs(batch, cfg), number), f"{out}/ck")
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return upserted(spark, f"{out}/near", keys, values)
