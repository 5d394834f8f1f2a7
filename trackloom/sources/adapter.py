"""Object tracks from the generic ``events`` table: a fixed, integer-only mapping.

50 tracks a sequence, 12-hour bins as frames, the newest event per track and frame; even
tracks stand still with a small jitter, odd ones move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT, Config

#: Thresholds that suit 60 frames; everything else stays at its default.
CONFIG: Config = DEFAULT.merge(
    {"near_miss": {"dedup_frames": 4}, "loiter": {"frames": 5}, "convoy": {"frames": 3}, "crowd": {"density": 3.0, "window": 10}, "jaywalking": {"vehicle_ratio": 0.6}}
)
BIN_US = 43200000000


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence_id, track_id, frame_id, class_name, x1, y1, x2, y2, frame_width, frame_height, occlusion)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    # a zone-less difference does not depend on the session's time zone
    frame = F.expr(f"cast(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div {BIN_US} as int)")
    binned = events.select(F.col("user_id").alias("track_id"), frame.alias("frame_id"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    one = binned.groupBy("track_id", "frame_id").agg(F.max_by("k", "event_id").alias("k"))
    j = F.col("track_id") % 50
    cx = ((j * 97 + F.when(j % 2 == 0, 0).otherwise(F.col("frame_id") * 5)) % 1000) / 1000
    cy = ((j * 53 + F.coalesce(F.col("k"), F.lit(0)) % 3) % 1000) / 1000
    name = F.element_at(F.array(*map(F.lit, ("pedestrian", "car", "people", "car", "truck"))), (j % 5 + 1).cast("int"))
    out = one.select(
        F.concat(F.lit("seq_"), F.expr("track_id div 50").cast("string")).alias("sequence_id"), "track_id", "frame_id", name.alias("class_name"),
        cx.alias("px"), cy.alias("py"),
    )
    return out.select(
        "sequence_id", "track_id", "frame_id", "class_name", (F.col("px") - 0.02).alias("x1"), (F.col("py") - 0.02).alias("y1"),
        (F.col("px") + 0.02).alias("x2"), (F.col("py") + 0.02).alias("y2"), F.lit(1.0).alias("frame_width"), F.lit(1.0).alias("frame_height"), F.lit(0).alias("occlusion"),
    )
