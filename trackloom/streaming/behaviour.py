"""Event rules over streams as stateful processors with timers: near miss, convoy, crowd, jaywalking; visits as sessions.

Rows wait until the watermark has passed their frame; a timer then hands the frames to the rule
in order (``_InFrameOrder``), so rows may arrive in any order within the watermark, and later
ones are dropped by it.  Jaywalking looks at one frame at a time and is an aggregation.  What a rule remembers:

| rule | key | state | dropped |
|---|---|---|---|
| near miss | pair | frame that fired last | when the cool-down is over |
| convoy | sequence | run of each pair of the last frame | with the next frame without the pair |
| crowd | sequence | densities of each zone in the window | when they leave the window |
| jaywalking | sequence, frame and zone | counts, persons | with the frame |

Convoys and crowds follow the processed frames of a sequence, so they are keyed by it; what
reaches them is narrow (close pairs and one mark a frame; a row for each zone and frame).
A sequence that is silent for ``SILENT`` frames is forgotten altogether and starts anew.
Pairs of a frame meet in a stream-stream join over grid cells whose keys hold the event time,
so the join forgets frames behind the watermark.

Event time drives the timers; state with a time to live would follow the clock instead and
drop what a replay still needs.  The state store must be RocksDB (``rocks``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..config import DEFAULT, Config
from ..operators import events as E
from .events import FIRST_MS, LATE, with_time

SILENT = 3600
FRAME = ("event_ts", "sequence_id", "frame_id")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


TYPES = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "string": StringType()}

#: Pandas makes floats of whole numbers beside nulls; state takes none for a whole number.
KINDS = {"int": int, "long": int, "double": float, "string": str}


def _struct(arrays: bool = False, **columns: str) -> StructType:
    """A row of state; workers have no session that could parse it from text."""
    return StructType([StructField(c, ArrayType(TYPES[t]) if arrays else TYPES[t]) for c, t in columns.items()])


@contextmanager
def rocks(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, as these processors need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _time(frame: int) -> int:
    """A timer that fires once no row of the frame can come any more."""
    return FIRST_MS + 1000 * frame + 1


class _InFrameOrder(StatefulProcessor):
    """Hands a key's rows to ``frame`` frame by frame.

    A key's ``columns`` wait as arrays under one value, so a micro-batch costs a key a few calls to the state
    store however many frames it holds.  The timer of the earliest frame hands over all frames that
    the watermark has passed.  ``kept`` is how many frames after the last one ``forget`` is called,
    if no other came meanwhile.  What the rule remembers is read and written once for all of them.
    """

    columns: dict[str, str] = {}
    output: list[str] = []
    kept: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", _struct(arrays=True, frame="int", **self.columns))
        self.last = handle.getValueState("last", _struct(frame="int"))
        self.prepare(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [list(c) for c in self.waiting.get()] if self.waiting.exists() else [[] for _ in range(1 + len(self.columns))]
        earliest = min(known[0], default=None)
        for part in rows:
            for had, (c, t) in zip(known, {"frame_id": "int", **self.columns}.items()):
                had += [None if x is None or x != x else KINDS[t](x) for x in part[c]]
        if known[0]:
            if earliest is None or min(known[0]) < earliest:
                self.handle.registerTimer(_time(min(known[0])))
            self.waiting.update(tuple(known))
        yield self._table([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = (max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) - FIRST_MS - 1) // 1000
        held = list(zip(*self.waiting.get())) if self.waiting.exists() else []
        ready: dict[int, list[tuple]] = {}
        for frame, *row in held:
            if frame <= due:
                ready.setdefault(frame, []).append(tuple(row))
        last = self.last.get()[0] if self.kept is not None and self.last.exists() else None
        silent = not ready and last is not None and due - last >= self.kept
        out: list[tuple] = []
        if ready or silent:
            self.load()
            for frame in sorted(ready):
                if last is not None and frame - last > self.kept:
                    self.forget()
                out += self.frame(key, frame, ready[frame])
                last = frame if self.kept is not None else None
            if silent:
                self.last.clear()
                self.forget()
            elif last is not None:
                self.last.update((last,))
                self.handle.registerTimer(_time(last + self.kept))
            self.save()
        if ready:
            rest = [r for r in held if r[0] > due]
            if rest:
                self.waiting.update(tuple(list(c) for c in zip(*rest)))
                self.handle.registerTimer(_time(min(r[0] for r in rest)))
            else:
                self.waiting.clear()
        yield self._table(out)

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.output)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        """States of the rule."""

    def load(self) -> None:
        """Read what the rule remembers."""

    def save(self) -> None:
        """Write what the rule remembers."""

    def frame(self, key: tuple, frame: int, rows: list[tuple]) -> list[tuple]:
        """What the rule says of a frame."""
        raise NotImplementedError

    def forget(self) -> None:
        """Drop what the rule remembers."""

    def close(self) -> None:
        """Nothing to close."""


def _rows(state) -> list[tuple]:
    """Rows of a value of arrays."""
    return list(zip(*state.get())) if state.exists() else []


def _keep(state, rows: list[tuple]) -> None:
    if rows:
        state.update(tuple(list(c) for c in zip(*rows)))
    elif state.exists():
        state.clear()


class NearMiss(_InFrameOrder):
    """A pair fires if its last firing is at least the cool-down ago; after that its state is dropped."""

    columns = {"distance": "double"}
    output = ["sequence_id", "primary_track_id", "secondary_track_id", "frame_id", "distance"]

    def __init__(self, cooldown: int):
        self.kept = self.cooldown = cooldown

    def prepare(self, handle):
        self.fired = handle.getValueState("fired", _struct(arrays=True, frame="int"))

    def load(self):
        self.at = next((f for (f,) in _rows(self.fired)), None)

    def save(self):
        _keep(self.fired, [] if self.at is None else [(self.at,)])

    def frame(self, key, frame, rows):
        if self.at is not None and frame - self.at < self.cooldown:
            return []
        self.at = frame
        return [(*key, frame, min(d for (d,) in rows))]

    def forget(self):
        self.at = None


class Convoy(_InFrameOrder):
    """Runs of pairs over the processed frames of a sequence; a row without a pair marks a frame."""

    columns = {"a": "long", "b": "long", "distance": "double", "heading_diff": "double"}
    output = ["sequence_id", "frame_id", "primary_track_id", "secondary_track_id", "distance", "heading_diff"]

    def __init__(self, frames: int, kept: int):
        self.frames, self.kept = frames, kept

    def prepare(self, handle):
        self.runs = handle.getValueState("runs", _struct(arrays=True, a="long", b="long", run="int"))

    def load(self):
        self.run_of = {(a, b): run for a, b, run in _rows(self.runs)}

    def save(self):
        _keep(self.runs, [(a, b, run) for (a, b), run in self.run_of.items()])

    def frame(self, key, frame, rows):
        pairs = {(a, b): (d, h) for a, b, d, h in rows if a is not None}
        self.run_of = {pair: self.run_of.get(pair, 0) + 1 for pair in pairs}
        return [(key[0], frame, *pair, *measures) for pair, measures in sorted(pairs.items()) if self.run_of[pair] == self.frames]

    def forget(self):
        self.run_of = {}


class Crowd(_InFrameOrder):
    """Densities of the zones of a sequence within the window; a zone whose last one has left it is dropped."""

    columns = {"zone": "string", "density": "double"}
    output = ["sequence_id", "frame_id", "zone_id", "density"]

    def __init__(self, density: float, window: int, kept: int):
        self.density, self.window, self.kept = density, window, kept

    def prepare(self, handle):
        self.history = handle.getValueState("history", _struct(arrays=True, zone="string", frame="int", density="double"))

    def load(self):
        self.seen: dict[str, list[tuple]] = {}
        for zone, frame, density in _rows(self.history):
            self.seen.setdefault(zone, []).append((frame, density))

    def save(self):
        _keep(self.history, [(zone, *x) for zone, own in self.seen.items() for x in own])

    def frame(self, key, frame, rows):
        for zone, density in dict(rows).items():
            self.seen.setdefault(zone, []).append((frame, density))
        recent = {zone: [x for x in own if x[0] > frame - self.window] for zone, own in self.seen.items()}
        self.seen = {zone: own for zone, own in recent.items() if own}
        return [(key[0], frame, zone, own[-1][1]) for zone, own in sorted(self.seen.items()) if own[-1][1] >= self.density and own[-1][1] > 2 * own[0][1]]

    def forget(self):
        self.seen = {}


def _run(stream: DataFrame, keys: list[str], processor: _InFrameOrder, schema: str) -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime")


def _timed(stream: DataFrame, late: str) -> DataFrame:
    """``stream`` with its watermark.  Rows of every role must move it, so the role is made to depend on the
    event time: filters on it then stay above the watermark."""
    timed = with_time(stream).withWatermark("event_ts", late)
    return timed.withColumn("event_role", F.when(F.col("event_ts").isNotNull(), F.col("event_role")))


def near_miss(stream: DataFrame, cfg: Config = DEFAULT, late: str = LATE) -> DataFrame:
    hits = E.near_miss_hits(_timed(stream, late), cfg, FRAME).select("event_ts", "sequence_id", F.col("a_track_id").cast("long").alias("a"), F.col("b_track_id").cast("long").alias("b"), "frame_id", "distance")
    out = _run(hits, ["sequence_id", "a", "b"], NearMiss(cfg.near_miss.dedup_frames), "sequence_id string, primary_track_id long, secondary_track_id long, frame_id int, distance double")
    return E._events(out.withColumn("confidence", 1 - F.least(F.col("distance") / cfg.near_miss.distance, F.lit(1.0))), "NEAR_MISS")


def convoy(stream: DataFrame, cfg: Config = DEFAULT, late: str = LATE, silent: int = SILENT) -> DataFrame:
    timed = _timed(stream, late)
    pairs = E.convoy_pairs(timed, cfg, FRAME).select(*FRAME, F.col("a_track_id").cast("long").alias("a"), F.col("b_track_id").cast("long").alias("b"), "distance", "heading_diff")
    none = {"a": "long", "b": "long", "distance": "double", "heading_diff": "double"}
    marks = timed.select(*FRAME).dropDuplicatesWithinWatermark(["sequence_id", "frame_id"]).select(*FRAME, *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    out = _run(pairs.unionByName(marks), ["sequence_id"], Convoy(cfg.convoy.frames, silent), "sequence_id string, frame_id int, primary_track_id long, secondary_track_id long, distance double, heading_diff double")
    return E._events(out.withColumn("confidence", F.lit(1.0)), "CONVOY")


def crowd_form(stream: DataFrame, cfg: Config = DEFAULT, late: str = LATE, silent: int = SILENT) -> DataFrame:
    zones = _timed(stream, late).groupBy("event_ts", "sequence_id", "frame_id", "zone_id").agg(F.count("event_role").cast("double").alias("density"))
    zones = zones.select("event_ts", "sequence_id", "frame_id", F.col("zone_id").alias("zone"), "density")
    out = _run(zones, ["sequence_id"], Crowd(cfg.crowd.density, cfg.crowd.window, silent), "sequence_id string, frame_id int, zone_id string, density double")
    return E._events(out.withColumns({"primary_track_id": F.lit(-1), "confidence": F.lit(1.0)}), "CROWD_FORM")


def jaywalking(stream: DataFrame, cfg: Config = DEFAULT, late: str = LATE) -> DataFrame:
    """Persons of a zone in a frame that is mostly vehicles: one aggregation that closes with the frame."""
    c = cfg.jaywalking
    person = F.when(F.col("class_name").isin(*c.classes), F.col("track_id").cast("long"))
    z = _timed(stream, late).groupBy(*FRAME, "zone_id").agg(F.count_if(F.col("event_role") == "vehicle").alias("vehicles"), F.count("event_role").alias("n"), F.collect_list(person).alias("persons"))
    busy = z.withColumn("vehicle_ratio", F.when(F.col("n") > 0, F.col("vehicles") / F.col("n")).otherwise(cfg.zones.vehicle_ratio)).where(F.col("vehicle_ratio") > c.vehicle_ratio)
    out = busy.select("sequence_id", "zone_id", "frame_id", F.explode("persons").alias("primary_track_id"), "vehicle_ratio")
    return E._events(out.withColumn("confidence", F.col("vehicle_ratio")), "JAYWALKING")


def zone_visits(stream: DataFrame, gap: int = 3, late: str = LATE) -> DataFrame:
    """(sequence_id, track_id, zone_id, first_frame, last_frame, n_states): visits of tracks to zones; ``gap`` unseen frames end one.

    Late rows within the watermark may join two sessions; a visit is given once it can't change.
    """
    session = F.session_window("event_ts", f"{gap + 1} seconds")
    v = _timed(stream, late).groupBy(session.alias("w"), "sequence_id", "track_id", "zone_id").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.count(F.lit(1)).alias("n_states"))
    return v.drop("w")
