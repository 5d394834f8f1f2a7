"""Zone statistics: per frame, latest, and as graph nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import DEFAULT, Config


def frame_stats(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Counts and ratios of each zone in each frame; a zone with other classes only has count 0 and default ratios."""
    n = lambda r: F.count_if(F.col("event_role") == r)
    z = states.groupBy("sequence_id", "frame_id", "zone_id").agg(n("pedestrian").alias("pedestrian_count"), n("vehicle").alias("vehicle_count"))
    total = F.col("pedestrian_count") + F.col("vehicle_count")
    ratio = lambda c, d: F.when(total > 0, F.col(c) / total).otherwise(d)
    return z.withColumns(
        {"density": total.cast("double"), "pedestrian_ratio": ratio("pedestrian_count", cfg.zones.pedestrian_ratio), "vehicle_ratio": ratio("vehicle_count", cfg.zones.vehicle_ratio)}
    )


def latest(stats: DataFrame) -> DataFrame:
    """The newest statistics of every zone ever seen, stale ones included."""
    cols = ("density", "pedestrian_ratio", "vehicle_ratio", "pedestrian_count", "vehicle_count")
    s = stats.groupBy("sequence_id", "zone_id").agg(F.max("frame_id").alias("frame_id"), F.max_by(F.struct(*cols), "frame_id").alias("s"))
    return s.select("sequence_id", "zone_id", "frame_id", *(F.col(f"s.{c}").alias(c) for c in cols))


def nodes(stats: DataFrame, states: DataFrame) -> DataFrame:
    """Zone nodes: a stale zone keeps its values but is updated with every frame."""
    end = states.groupBy("sequence_id").agg(F.max("frame_id").alias("updated_at_frame"))
    z = latest(stats).join(end.hint("merge"), "sequence_id")
    return z.select("sequence_id", "zone_id", F.col("density").alias("last_density"), "vehicle_ratio", "pedestrian_ratio", "updated_at_frame")


def surges(stats: DataFrame, frames: DataFrame, window: int, least: float, factor: float = 2.0) -> DataFrame:
    """(sequence_id, frame_id, zone_id, current): processed frames in which a zone's density is at least ``least`` and more than ``factor`` times the oldest in the window.

    The density of a zone that is empty now is its last one within the window.  Nothing is built for
    every frame: an observation counts as the current one until the next, and as the oldest one
    while its predecessor has left the window and it has not, so each dense observation gives the few
    intervals of frames in which the rule holds, and only those meet the processed frames, bucket by bucket.
    """
    zone = W.partitionBy("sequence_id", "zone_id").orderBy("frame_id")
    o = stats.select("sequence_id", "zone_id", "frame_id", "density", F.lead("frame_id").over(zone).alias("next"), F.collect_list(F.struct("frame_id", "density")).over(zone.rangeBetween(-(window - 1), 0)).alias("seen"))
    o = o.where(F.col("density") >= least)
    until = F.least(F.coalesce(F.col("next") - 1, F.lit((1 << 31) - 1)), F.col("frame_id") + (window - 1))

    def interval(x, k):
        since = F.when(k == 0, F.col("frame_id")).otherwise(F.greatest(F.col("frame_id"), F.get("seen", k - 1)["frame_id"] + window))
        return F.struct(since.alias("since"), F.least(until, x["frame_id"] + (window - 1)).alias("until"), (F.col("density") > factor * x["density"]).alias("grown"))

    held = F.filter(F.transform("seen", interval), lambda i: i["grown"] & (i["since"] <= i["until"]))
    spans = o.select("sequence_id", "zone_id", F.col("density").alias("current"), F.explode(held).alias("i")).select("sequence_id", "zone_id", "current", "i.since", "i.until")
    bucket = lambda c: F.floor(F.col(c) / window)
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket("since"), bucket("until"))))
    at = frames.select("sequence_id", "frame_id", bucket("frame_id").alias("bucket"))
    return spans.join(at.hint("merge"), ["sequence_id", "bucket"]).where(F.col("frame_id").between(F.col("since"), F.col("until"))).select("sequence_id", "frame_id", "zone_id", "current")
