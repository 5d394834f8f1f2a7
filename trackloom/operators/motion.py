"""Motion features of tracks: one shuffle by (sequence, track) serves all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G

TRACK = ("sequence_id", "track_id")


def role(class_name: Column) -> Column:
    from ..config import PEDESTRIAN_CLASSES, VEHICLE_CLASSES

    return F.when(class_name.isin(*PEDESTRIAN_CLASSES), "pedestrian").when(class_name.isin(*VEHICLE_CLASSES), "vehicle")


def classify(mean_speed: Column, heading_variance: Column, cfg: Config = DEFAULT) -> Column:
    """stationary, erratic or linear; the variance is linear, not circular, so 359 and 1 degree differ much."""
    m = cfg.motion
    return F.when(mean_speed < m.stationary, "stationary").when(heading_variance > m.erratic_variance, "erratic").otherwise("linear")


def enrich(tracks: DataFrame, cfg: Config = DEFAULT, *, reproject: bool = False) -> DataFrame:
    """Object states: normalised box and centroid, speed, heading, movement pattern, zone, trajectory.

    Boxes are taken in the pixels they come in and divided by the frame's size; with
    ``reproject`` they are first mapped back from the letterbox and clamped.
    Speed and heading refer to the track's previous observation, whatever the gap.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    if reproject:
        lb = G.letterbox(F.col("frame_width"), F.col("frame_height"), cfg.vision.letterbox)
        x1, x2 = (G.unletterbox(c, lb["pad_left"], lb["scale"], F.col("frame_width")) for c in (x1, x2))
        y1, y2 = (G.unletterbox(c, lb["pad_top"], lb["scale"], F.col("frame_height")) for c in (y1, y2))
    states = tracks.withColumns({"x1": x1 / F.col("frame_width"), "y1": y1 / F.col("frame_height"), "x2": x2 / F.col("frame_width"), "y2": y2 / F.col("frame_height")})
    states = states.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    track = W.partitionBy(*TRACK).orderBy("frame_id")
    last = track.rowsBetween(-(cfg.motion.buffer - 1), 0)
    dx, dy = (F.col(c) - F.lag(c).over(track) for c in ("cx", "cy"))
    states = states.withColumns({"dx": F.coalesce(dx, F.lit(0.0)), "dy": F.coalesce(dy, F.lit(0.0))})
    states = states.withColumns({"speed": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "heading_deg": G.heading(F.col("dx"), F.col("dy"))})
    pattern = classify(F.avg("speed").over(last), F.var_pop("heading_deg").over(last), cfg)
    return states.withColumns(
        {"movement_pattern": pattern, "trajectory": F.collect_list(F.array("cx", "cy")).over(last), "zone_id": G.zone_id(F.col("cx"), F.col("cy"), cfg.motion.grid), "event_role": role(F.col("class_name"))}
    ).drop("dx", "dy")


def frames(states: DataFrame) -> DataFrame:
    """Processed frames of each sequence with their ordinal and the previous one."""
    seq = W.partitionBy("sequence_id").orderBy("frame_id")
    return states.select("sequence_id", "frame_id").distinct().withColumns({"ordinal": F.row_number().over(seq), "previous": F.lag("frame_id").over(seq)})


def is_new(states: DataFrame) -> DataFrame:
    """First observation of each track."""
    return states.select(*TRACK, "frame_id", (F.row_number().over(W.partitionBy(*TRACK).orderBy("frame_id")) == 1).alias("is_new"))


def lost(states: DataFrame, frame_table: DataFrame) -> DataFrame:
    """One row when a track is missing: at the processed frame after its last sighting, with that sighting's frame."""
    at = states.join(frame_table.select("sequence_id", "frame_id", "ordinal").hint("merge"), ["sequence_id", "frame_id"])
    nxt = F.lead("ordinal").over(W.partitionBy(*TRACK).orderBy("ordinal"))
    gaps = at.withColumn("next", nxt).where(F.col("next").isNull() | (F.col("next") > F.col("ordinal") + 1))
    following = frame_table.select("sequence_id", F.col("frame_id").alias("lost_at"), (F.col("ordinal") - 1).alias("ordinal"))
    return gaps.join(following.hint("merge"), ["sequence_id", "ordinal"]).select(*TRACK, F.col("frame_id").alias("last_frame"), "lost_at")


def stationary_runs(states: DataFrame, at_least: int, classes: tuple[str, ...] | None = None) -> DataFrame:
    """Runs of stationary observations of a track with more than ``at_least`` of them."""
    track = W.partitionBy(*TRACK).orderBy("frame_id")
    still = F.col("movement_pattern") == "stationary"
    s = states if classes is None else states.where(F.col("class_name").isin(*classes))
    s = s.withColumn("island", F.sum(F.when(still, 0).otherwise(1)).over(track)).where(still)
    runs = s.groupBy(*TRACK, "class_name", "island").agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.count(F.lit(1)).alias("n_frames"))
    return runs.where(F.col("n_frames") > at_least).drop("island")
