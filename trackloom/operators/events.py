"""Behavioural events: near miss, loiter, convoy, crowd, jaywalking.

Every rule returns (event_type, sequence_id, frame_id, primary_track_id,
secondary_track_id, confidence, zone_id, distance, heading_diff, density,
vehicle_ratio); what a rule does not set is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G
from ..functions.text import event_key
from . import zones
from .neighbours import FRAME, within

META = {"zone_id": "string", "distance": "double", "heading_diff": "double", "density": "double", "vehicle_ratio": "double"}
KEYS = ("event_type", "sequence_id", "frame_id", "primary_track_id", "secondary_track_id", "confidence")


def _events(df: DataFrame, kind: str) -> DataFrame:
    have = set(df.columns)
    meta = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in META.items()]
    second = (F.col("secondary_track_id") if "secondary_track_id" in have else F.lit(None)).cast("long").alias("secondary_track_id")
    return df.select(F.lit(kind).alias("event_type"), "sequence_id", "frame_id", F.col("primary_track_id").cast("long").alias("primary_track_id"), second, F.col("confidence").cast("double").alias("confidence"), *meta)


def near_miss_hits(states: DataFrame, cfg: Config = DEFAULT, frame: tuple[str, ...] = FRAME) -> DataFrame:
    """Pedestrian and vehicle of one frame closer than the limit with one of them moving."""
    c = cfg.near_miss
    pairs = within(states.where("event_role = 'pedestrian'"), states.where("event_role = 'vehicle'"), c.distance, ("track_id", "speed"), frame)
    return pairs.where((F.col("distance") < c.distance) & (F.greatest("a_speed", "b_speed") > c.min_speed))


def near_miss(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Hits of a pair that come less than ``dedup_frames`` after the last *fired* one are silent.

    A recurrence, so it runs as a fold over the pair's hits in frame order.
    """
    c = cfg.near_miss
    by_pair = near_miss_hits(states, cfg).groupBy("sequence_id", "a_track_id", "b_track_id").agg(F.sort_array(F.collect_list(F.struct("frame_id", "distance"))).alias("hits"))
    fired = F.aggregate(
        F.slice("hits", 2, F.greatest(F.lit(1), F.size("hits"))), F.slice("hits", 1, 1),
        lambda acc, x: F.when(x["frame_id"] - F.element_at(acc, -1)["frame_id"] >= c.dedup_frames, F.concat(acc, F.array(x))).otherwise(acc),
    )
    out = by_pair.select("sequence_id", F.col("a_track_id").alias("primary_track_id"), F.col("b_track_id").alias("secondary_track_id"), F.explode(fired).alias("hit"))
    out = out.select("sequence_id", "primary_track_id", "secondary_track_id", "hit.*").withColumn("confidence", 1 - F.least(F.col("distance") / c.distance, F.lit(1.0)))
    return _events(out, "NEAR_MISS")


def loiter_runs(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Stationary observations of persons with their position in a run within one zone; a missed frame does not break it."""
    track = W.partitionBy("sequence_id", "track_id").orderBy("frame_id")
    s = states.withColumn("ok", F.col("class_name").isin(*cfg.loiter.classes) & (F.col("movement_pattern") == "stationary"))
    same = F.coalesce(F.col("ok") & F.lag("ok").over(track) & (F.col("zone_id") == F.lag("zone_id").over(track)), F.lit(False))
    s = s.withColumn("breaks", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("breaks").over(track))
    s = s.withColumn("run", F.row_number().over(W.partitionBy("sequence_id", "track_id", "island").orderBy("frame_id")))
    return s.where("ok")


def loiter(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    out = loiter_runs(states, cfg).where(F.col("run") == cfg.loiter.frames)
    return _events(out.withColumn("primary_track_id", F.col("track_id")).withColumn("confidence", F.lit(1.0)), "LOITER")


def convoy_pairs(states: DataFrame, cfg: Config = DEFAULT, frame: tuple[str, ...] = FRAME) -> DataFrame:
    c = cfg.convoy
    v = states.where("event_role = 'vehicle'")
    pairs = within(v, v, c.max_distance, ("track_id", "heading_deg", "class_name"), frame).where("a_track_id < b_track_id and a_class_name = b_class_name")
    pairs = pairs.withColumn("heading_diff", G.heading_difference(F.col("a_heading_deg"), F.col("b_heading_deg")))
    return pairs.where(F.col("distance").between(c.min_distance, c.max_distance) & (F.col("heading_diff") <= c.heading))


def convoy_runs(states: DataFrame, frames: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Qualifying pairs with their position in a run of processed frames, empty frames included."""
    p = convoy_pairs(states, cfg).join(frames.select("sequence_id", "frame_id", "ordinal").hint("merge"), ["sequence_id", "frame_id"])
    pair = W.partitionBy("sequence_id", "a_track_id", "b_track_id").orderBy("ordinal")
    p = p.withColumn("island", F.col("ordinal") - F.row_number().over(pair))
    return p.withColumn("run", F.row_number().over(W.partitionBy("sequence_id", "a_track_id", "b_track_id", "island").orderBy("ordinal")))


def convoy(states: DataFrame, frames: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    out = convoy_runs(states, frames, cfg).where(F.col("run") == cfg.convoy.frames)
    out = out.withColumns({"primary_track_id": F.col("a_track_id"), "secondary_track_id": F.col("b_track_id"), "confidence": F.lit(1.0)})
    return _events(out, "CONVOY")


def crowd_form(stats: DataFrame, frames: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Density reaches the limit and has more than doubled within the window; fires in every frame while it holds."""
    c = cfg.crowd
    out = zones.surges(stats, frames, c.window, c.density).withColumns({"primary_track_id": F.lit(-1), "density": F.col("current"), "confidence": F.lit(1.0)})
    return _events(out, "CROWD_FORM")


def jaywalking(states: DataFrame, stats: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A person in a zone that is mostly vehicles; fires in every frame."""
    c = cfg.jaywalking
    busy = stats.where(F.col("vehicle_ratio") > c.vehicle_ratio).select("sequence_id", "frame_id", "zone_id", "vehicle_ratio")
    out = states.where(F.col("class_name").isin(*c.classes)).join(busy.hint("merge"), ["sequence_id", "frame_id", "zone_id"])
    return _events(out.withColumns({"primary_track_id": F.col("track_id"), "confidence": F.col("vehicle_ratio")}), "JAYWALKING")


def all_events(states: DataFrame, cfg: Config = DEFAULT, frames: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    from .motion import frames as frames_of

    frames = frames_of(states) if frames is None else frames
    stats = zones.frame_stats(states, cfg) if stats is None else stats
    parts = [near_miss(states, cfg), loiter(states, cfg), convoy(states, frames, cfg), crowd_form(stats, frames, cfg), jaywalking(states, stats, cfg)]
    return reduce(DataFrame.unionByName, parts)


def metadata_json(df: DataFrame) -> DataFrame:
    """Event rows with ``metadata_json``: the keys of the event's type, sorted."""
    kinds = {
        "NEAR_MISS": {"distance": "distance"}, "LOITER": {"zone": "zone_id"}, "CONVOY": {"distance": "distance", "heading_diff": "heading_diff"},
        "CROWD_FORM": {"density": "density", "zone": "zone_id"}, "JAYWALKING": {"vehicle_ratio": "vehicle_ratio", "zone": "zone_id"},
    }
    out = F.lit(None).cast("string")
    for kind, keys in kinds.items():
        out = F.when(F.col("event_type") == kind, F.to_json(F.struct(*(F.col(c).alias(k) for k, c in sorted(keys.items()))))).otherwise(out)
    return df.withColumn("metadata_json", out)


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("event_key", event_key(*(F.col(c) for c in ("sequence_id", "frame_id", "event_type", "primary_track_id", "secondary_track_id"))))
