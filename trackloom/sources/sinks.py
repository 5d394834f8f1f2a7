"""Writers: audit logs, dead letters, run summaries."""

from __future__ import annotations

import json
import resource
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..config import DEFAULT


def audit(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines: ambiguous identities, failed queries, empty answers."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def write_or_keep(df: DataFrame, write: Callable[[DataFrame], None], dead_letters: str) -> None:
    """Write a batch; if that fails for good, keep its rows as JSON and raise the error again."""
    try:
        write(df)
    except Exception as e:
        kept = df.withColumn("error", F.lit(str(e).splitlines()[0][:500]))
        kept.write.mode("append").json(dead_letters)
        raise


class FrameBuffer:
    """Writes whole batches of frames: parts are held until ``batch_frames`` frames are there; what is left goes out at the end, errors or not.

    Use as a context manager.  Only plans are held, no rows.
    """

    def __init__(self, write: Callable[[DataFrame], None], dead_letters: str, batch_frames: int = DEFAULT.graph.batch_frames):
        self.write, self.dead_letters, self.batch_frames = write, dead_letters, batch_frames
        self.parts: list[DataFrame] = []
        self.frames = self.flushes = 0

    def add(self, part: DataFrame, frames: int = 1) -> None:
        self.parts.append(part)
        self.frames += frames
        if self.frames >= self.batch_frames:
            self.flush()

    def flush(self) -> None:
        parts, self.parts, self.frames = self.parts, [], 0
        if parts:
            self.flushes += 1
            write_or_keep(reduce(DataFrame.unionByName, parts), self.write, self.dead_letters)

    def __enter__(self) -> "FrameBuffer":
        return self

    def __exit__(self, *error) -> None:
        self.flush()


def replay(spark: SparkSession, dead_letters: str, schema, write: Callable[[DataFrame], None]) -> int:
    """Write kept rows again; returns how many there were."""
    rows = spark.read.schema(schema).json(dead_letters)
    n = rows.count()
    if n:
        write(rows)
    return n


def run_summary(states: DataFrame, events: DataFrame) -> DataFrame:
    """Per sequence: frames, objects, states and events of a run."""
    s = states.groupBy("sequence_id").agg(
        F.countDistinct("frame_id").alias("frame_count"), F.countDistinct("track_id").alias("object_count"), F.count(F.lit(1)).alias("state_count")
    )
    e = events.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("event_count"))
    return s.join(e, "sequence_id", "left").fillna(0, ["event_count"])


def write_counted(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Write tables below ``path`` and tell their rows: counted by the write itself, so nothing is scanned again."""
    counts = {}
    for name, df in tables.items():
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = seen.get["n"]
    return counts


def written_summary(states: DataFrame, objects: DataFrame, events: DataFrame, path: str, began: float) -> dict:
    """``summary`` of a run whose tables are written now: frames, objects, states and events from the writes."""
    tables = {"frame": states.select("sequence_id", "frame_id").distinct(), "object": objects, "state": states, "event": events}
    return {f"{k}_count": n for k, n in write_counted(tables, path).items()} | _process(began)


def _process(began: float) -> dict:
    return {"duration_sec": time.time() - began, "peak_rss_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024}


def summary(states: DataFrame, events: DataFrame, began: float) -> dict:
    """Frames, objects and events of a run, its seconds, and the driver's peak memory."""
    total = run_summary(states, events).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("frame_count", "object_count", "event_count"))).head()
    return {**total.asDict(), **_process(began)}


def report(payload: dict, path: str | None = None) -> str:
    """A summary or a set of metrics as JSON text, written to a file if one is named."""
    text = json.dumps(payload, indent=2, sort_keys=True, default=str)
    if path is not None:
        with open(path, "w") as f:
            f.write(text + "\n")
    return text
