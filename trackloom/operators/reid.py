"""Re-identification of track fragments and coexistence of tracks, as interval joins and ranked windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G


def snapshots(history: DataFrame) -> DataFrame:
    """Per track: first and last frame and centroid, trajectory, heading at entry and exit, class.

    history: (sequence_id, track_id, frame_id, class_name, heading_deg, cx, cy).  Rows
    without a centroid are dropped from the trajectory; headings come from the first and the
    last two points and fall back to the stored heading of a single one; the class is the
    last one, as the object node keeps it.
    """
    h = history.groupBy("sequence_id", "track_id").agg(
        F.min("frame_id").alias("first_seen_frame"), F.max("frame_id").alias("last_seen_frame"), F.max_by("class_name", "frame_id").alias("class"),
        F.max_by("heading_deg", "frame_id").alias("stored"),
        F.sort_array(F.collect_list(F.when(F.col("cx").isNotNull() & F.col("cy").isNotNull(), F.struct("frame_id", "cx", "cy")))).alias("points"),
    )
    n = F.size("points")
    point = lambda at: F.get("points", at)
    turn = lambda a, b: F.when(n >= 2, G.heading(b["cx"] - a["cx"], b["cy"] - a["cy"])).otherwise(F.coalesce("stored", F.lit(0.0)))
    first, last = point(F.lit(0)), point(n - 1)
    return h.select(
        "sequence_id", "track_id", "first_seen_frame", "last_seen_frame", "class", first["cx"].alias("first_cx"), first["cy"].alias("first_cy"),
        last["cx"].alias("last_cx"), last["cy"].alias("last_cy"), turn(first, point(F.lit(1))).alias("heading_at_entry"), turn(point(n - 2), last).alias("heading_at_exit"),
        F.transform("points", lambda p: F.struct(p["cx"].alias("cx"), p["cy"].alias("cy"))).alias("trajectory"),
    )


def _sides(snaps: DataFrame, bucket_a, bucket_b, columns: list[str]) -> DataFrame:
    """Pairs of one sequence that share a bucket of frames; each side is sent to the buckets its expression names."""
    a = snaps.select("sequence_id", F.explode(bucket_a).alias("bucket"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = snaps.select("sequence_id", F.explode(bucket_b).alias("bucket"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return a.join(b.hint("merge"), ["sequence_id", "bucket"])


def _bucket(frame, width: int):
    return F.floor(F.col(frame) / width).cast("long")


def compare(snaps: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Same-class pairs where one track starts less than ``gap_frames`` after the other ended, with the conditions.

    Buckets of ``gap_frames`` frames: the later track starts in the bucket where the earlier one
    ends or in the next, so a pair meets in exactly one.  Pairs further apart can only fail.
    """
    r = cfg.reid
    columns = [c for c in snaps.columns if c not in ("sequence_id", "trajectory")]
    end = _bucket("last_seen_frame", r.gap_frames)
    p = _sides(snaps, F.array(end, end + 1), F.array(_bucket("first_seen_frame", r.gap_frames)), columns)
    p = p.where("a_class = b_class and a_last_seen_frame < b_first_seen_frame").where(F.col("b_first_seen_frame") - F.col("a_last_seen_frame") < r.gap_frames)
    p = p.withColumns({
        "distance": G.distance(F.col("a_last_cx"), F.col("a_last_cy"), F.col("b_first_cx"), F.col("b_first_cy")),
        "gap": F.col("b_first_seen_frame") - F.col("a_last_seen_frame"),
        "heading_diff": G.heading_difference(F.col("a_heading_at_exit"), F.col("b_heading_at_entry")),
    })
    return p.select(
        "sequence_id", F.col("a_track_id").alias("track_a"), F.col("b_track_id").alias("track_b"), F.col("a_first_seen_frame").alias("a_first"), F.col("b_first_seen_frame").alias("b_first"),
        "distance", "gap", "heading_diff", (F.col("distance") < r.spatial).alias("spatial_ok"), (F.col("gap") < r.gap_frames).alias("temporal_ok"), (F.col("heading_diff") < r.heading).alias("heading_ok"),
    )


def score(pairs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    r = cfg.reid
    conf = r.weight_spatial * G.inverse_score(F.col("distance"), r.spatial) + r.weight_temporal * G.inverse_score(F.col("gap"), r.gap_frames) + r.weight_heading * G.inverse_score(F.col("heading_diff"), r.heading) + r.weight_class
    ok = F.col("spatial_ok") & F.col("temporal_ok") & F.col("heading_ok")
    return pairs.withColumn("confidence", F.when(ok, F.round(conf, 9)).otherwise(0.0))


def candidates(scored: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return scored.where(F.col("confidence") >= cfg.reid.confidence)


def accept(cands: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Best partner of each track if it is clearly best; each partner goes to the earliest claimant."""
    a = W.partitionBy("sequence_id", "track_a").orderBy(F.col("confidence").desc(), "b_first", "track_b")
    best = cands.withColumns({"rank": F.row_number().over(a), "next": F.lead("confidence").over(a)}).where(F.col("rank") == 1)
    best = best.where(F.col("next").isNull() | (F.round(F.col("confidence") - F.col("next"), 9) > cfg.reid.ambiguity))
    b = W.partitionBy("sequence_id", "track_b").orderBy("a_first", "track_a")
    return best.withColumn("claim", F.row_number().over(b)).where(F.col("claim") == 1).drop("rank", "next", "claim")


def ambiguous(cands: DataFrame, accepted: DataFrame) -> DataFrame:
    return cands.join(accepted.select("sequence_id", "track_a", "track_b").hint("merge"), ["sequence_id", "track_a", "track_b"], "left_anti")


def same_entity(accepted: DataFrame) -> DataFrame:
    return accepted.select("sequence_id", "track_a", "track_b", "confidence", F.lit("spatial_temporal_reid").alias("method"), F.col("b_first").alias("resolved_at_frame"))


def canonical(accepted: DataFrame) -> DataFrame:
    """canonical_id = the smaller id of a pair, last write wins, not transitive."""
    low = F.least("track_a", "track_b")
    as_a = accepted.select("sequence_id", F.col("track_a").alias("track_id"), low.alias("ca"))
    as_b = accepted.select("sequence_id", F.col("track_b").alias("track_id"), low.alias("cb"))
    return as_a.join(as_b, ["sequence_id", "track_id"], "full").select("sequence_id", "track_id", F.coalesce("ca", "cb").alias("canonical_id"))


def coexists(snaps: DataFrame, cfg: Config = DEFAULT, width: int = 60) -> DataFrame:
    """Tracks whose lifespans overlap, earlier one first; distance along both trajectories by position, not by frame.

    An interval join over buckets of ``width`` frames: a track is sent to every bucket it lives in,
    and a pair counts in the bucket where its overlap starts.  Only ids and frames take part;
    the trajectories are fetched for the pairs that remain.
    """
    lives = F.sequence(_bucket("first_seen_frame", width), _bucket("last_seen_frame", width))
    p = _sides(snaps, lives, lives, ["track_id", "first_seen_frame", "last_seen_frame"]).where(
        "(a_first_seen_frame < b_first_seen_frame or (a_first_seen_frame = b_first_seen_frame and a_track_id < b_track_id)) and b_first_seen_frame <= a_last_seen_frame"
    )
    p = p.where(F.col("bucket") == F.floor(F.col("b_first_seen_frame") / width))  # the overlap starts where the later one starts
    for s in "ab":
        points = snaps.select("sequence_id", F.col("track_id").alias(f"{s}_track_id"), F.col("trajectory").alias(f"{s}_trajectory"))
        p = p.join(points.hint("merge"), ["sequence_id", f"{s}_track_id"])
    n = F.least(F.size("a_trajectory"), F.size("b_trajectory"))
    steps = F.zip_with(F.slice("a_trajectory", F.lit(1), n), F.slice("b_trajectory", F.lit(1), n), lambda x, y: G.distance(x["cx"], x["cy"], y["cx"], y["cy"]))
    least = F.when(n > 0, F.array_min(steps)).otherwise(cfg.reid.coexist_default)
    start, end = F.greatest("a_first_seen_frame", "b_first_seen_frame"), F.least("a_last_seen_frame", "b_last_seen_frame")
    return p.select(
        "sequence_id", F.col("a_track_id").alias("track_a"), F.col("b_track_id").alias("track_b"), start.alias("overlap_start"), end.alias("overlap_end"),
        (end - start + 1).alias("overlap_frames"), least.alias("min_distance_ever"),
    )


def resolve(snaps: DataFrame, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    cands = candidates(score(compare(snaps, cfg), cfg), cfg)
    acc = accept(cands, cfg)
    return {"same_entity_as": same_entity(acc), "canonical": canonical(acc), "ambiguous": ambiguous(cands, acc), "coexists_with": coexists(snaps, cfg)}


def snapshot_fields(tracks: DataFrame) -> DataFrame:
    """Snapshots from looser rows: centroids fall back to the trajectory's ends, headings to ``heading_deg``, the class to ``class_name``.

    Columns that are absent count as null.  A row in which a field and its fallback are both
    missing raises an error that names the field.
    """
    have = set(tracks.columns)
    col = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    points = F.col("trajectory") if "trajectory" in have else F.lit(None).cast("array<struct<cx:double,cy:double>>")
    ends = {"first": F.get(points, F.lit(0)), "last": F.get(points, F.size(points) - 1)}

    def need(name, value):
        return F.coalesce(value, F.raise_error(F.lit(f"track lacks {name} and its fallback")).cast("double" if name != "class" else "string")).alias(name)

    return tracks.select(
        "sequence_id", "track_id", "first_seen_frame", "last_seen_frame", need("class", F.coalesce(col("class", "string"), col("class_name", "string"))),
        *(need(f"{side}_{c}", F.coalesce(col(f"{side}_{c}", "double"), ends[side][c])) for side in ends for c in ("cx", "cy")),
        *(need(h, F.coalesce(col(h, "double"), col("heading_deg", "double"))) for h in ("heading_at_entry", "heading_at_exit")),
        F.coalesce(points, F.array().cast("array<struct<cx:double,cy:double>>")).alias("trajectory"),
    )


def run_counts(snaps: DataFrame, accepted: DataFrame, coexisting: DataFrame) -> DataFrame:
    """Per sequence: objects, and statements that a run writes (one per coexistence, three per accepted identity)."""
    n = lambda df, name, times=1: df.groupBy("sequence_id").agg((F.count(F.lit(1)) * times).alias(name))
    out = n(snaps, "object_count").join(n(accepted, "by_identity", 3), "sequence_id", "left").join(n(coexisting, "by_coexistence"), "sequence_id", "left")
    total = F.coalesce("by_identity", F.lit(0)) + F.coalesce("by_coexistence", F.lit(0))
    return out.select("sequence_id", "object_count", total.alias("statement_count"), F.lit(True).alias("post_processed"))


def statements(resolved: dict[str, DataFrame]) -> DataFrame:
    """(edge, sequence_id, track_a, track_b): coexistence first, then identity, as one table."""
    part = lambda name, edge: resolved[name].select(F.lit(edge).alias("edge"), "sequence_id", "track_a", "track_b")
    return part("coexists_with", "COEXISTS_WITH").unionByName(part("same_entity_as", "SAME_ENTITY_AS"))
