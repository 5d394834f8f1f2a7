"""Operators that are documented for the domain but not part of the base rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import CLASS_GROUPS, DEFAULT, Config
from ..functions import geometry as G
from ..sources.shared import write_once
from .neighbours import BOX, overlapping, within


def annotations(rows: DataFrame) -> DataFrame:
    """Ground-truth rows (frame, target, left, top, width, height, score, category, truncation, occlusion) as boxes.

    Rows of categories 0 and 11 and rows with score 0 are dropped; frames count from 0.
    """
    names = ("pedestrian", "people", "bicycle", "car", "van", "truck", "tricycle", "awning-tricycle", "bus", "motor")
    r = rows.where("category between 1 and 10 and score <> 0")
    groups = F.when(F.col("class_name").isin(*CLASS_GROUPS["MotorVehicle"]), "MotorVehicle").otherwise("VulnerableRoadUser")
    more = ["sequence_id"] if "sequence_id" in rows.columns else []
    return r.select(
        *more, (F.col("frame") - 1).alias("frame_id"), F.col("target").alias("track_id"), F.element_at(F.array(*map(F.lit, names)), F.col("category").cast("int")).alias("class_name"),
        F.col("left").cast("double").alias("x1"), F.col("top").cast("double").alias("y1"), (F.col("left") + F.col("width")).cast("double").alias("x2"), (F.col("top") + F.col("height")).cast("double").alias("y2"),
        "truncation", "occlusion", (~((F.col("truncation") == 1) & (F.col("occlusion") == 2))).alias("is_reliable"),
    ).withColumn("class_group", groups)


def transfer_occlusion(detections: DataFrame, truth: DataFrame, iou: float = 0.5, cell: float = 0.05) -> DataFrame:
    """Detections (image_id, pos, box) with the occlusion of the first annotation (by its pos) that overlaps enough, else 0.

    ``cell`` is the width of the grid over which overlapping boxes meet.
    """
    t = truth.select("image_id", F.col("pos").alias("t_pos"), F.col("occlusion").alias("t_occlusion"), *BOX).withColumn("pos", F.lit(0))
    d = detections.select("image_id", "pos", *BOX).withColumns({"t_pos": F.lit(0), "t_occlusion": F.lit(0)})
    pairs = overlapping(d, t, cell, ("pos", "t_pos", "t_occlusion"), ("image_id",))
    enough = G.iou(tuple(F.col(f"a_{c}") for c in BOX), tuple(F.col(f"b_{c}") for c in BOX)) > iou
    first = pairs.where(enough).groupBy("image_id", F.col("a_pos").alias("pos")).agg(F.min_by("b_t_occlusion", "b_t_pos").alias("found"))
    out = detections.drop("occlusion").join(first, ["image_id", "pos"], "left")
    return out.withColumn("occlusion", F.coalesce("found", F.lit(0))).drop("found")


def pixel_stats(frames: DataFrame) -> DataFrame:
    """(sequence_id, frame_id, brightness, difference) of grey frames (``gray``: array of 0 to 255): mean, and mean change since the frame before."""
    before = F.lag("gray").over(W.partitionBy("sequence_id").orderBy("frame_id"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    f = frames.withColumn("before", before)
    change = F.when(F.size("before") == F.size("gray"), mean(F.zip_with("gray", "before", lambda x, y: F.abs(x - y))))
    return f.select("sequence_id", "frame_id", mean(F.col("gray")).alias("brightness"), change.alias("difference"))


def quality_flags(frames: DataFrame) -> DataFrame:
    """(sequence_id, frame_id, brightness, difference) with flags: dark below 20, bright above 240, static below 2."""
    return frames.withColumns({"is_dark": F.col("brightness") < 20, "is_bright": F.col("brightness") > 240, "is_static": F.coalesce(F.col("difference") < 2, F.lit(False))})


def track_gaps(states: DataFrame, at_least: int) -> DataFrame:
    gap = F.col("frame_id") - F.lag("frame_id").over(W.partitionBy("sequence_id", "track_id").orderBy("frame_id"))
    return states.select("sequence_id", "track_id", "frame_id", gap.alias("gap")).where(F.col("gap") > at_least)


def select_sequences(states: DataFrame, min_frames: int = 200, min_objects: float = 5, min_pixels: float = 1280 * 720) -> DataFrame:
    """Sequences that are long, large and crowded enough; the size is that of the smallest frame."""
    s = states.groupBy("sequence_id").agg(F.countDistinct("frame_id").alias("n_frames"), F.count(F.lit(1)).alias("n"), F.min(F.col("frame_width") * F.col("frame_height")).alias("pixels"))
    s = s.where(F.col("pixels") >= min_pixels).select("sequence_id", "n_frames", (F.col("n") / F.col("n_frames")).alias("objects_per_frame"))
    return s.where((F.col("n_frames") >= min_frames) & (F.col("objects_per_frame") >= min_objects))


def scene_type(vehicles, pedestrians):
    """From the vehicles and pedestrians in a frame, on average."""
    dense = (vehicles > 10) & (pedestrians > 5)
    return F.when(dense, "urban_dense").when(vehicles > 5, "urban").when(vehicles > 2, "suburban").otherwise("rural")


def time_of_day(stats: DataFrame, first: int = 10) -> DataFrame:
    """(sequence_id, time_of_day): what most of the first frames say by their brightness; of equal counts the first in the alphabet."""
    early = stats.withColumn("place", F.row_number().over(W.partitionBy("sequence_id").orderBy("frame_id"))).where(F.col("place") <= first)
    b = F.col("brightness")
    votes = early.groupBy("sequence_id", F.when(b < 60, "nighttime").when(b < 120, "dusk_dawn").otherwise("daytime").alias("time_of_day")).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("sequence_id").agg(F.min_by("time_of_day", F.struct((-F.col("n")).alias("n"), "time_of_day")).alias("time_of_day"))


def scene_profile(states: DataFrame, first: int = 30) -> DataFrame:
    """Densities of the first frames and an altitude estimate from the median height of person boxes."""
    s = states.where(F.col("frame_id") < first)
    height = F.median(F.when(F.col("event_role") == "pedestrian", F.col("y2") - F.col("y1")))
    out = s.groupBy("sequence_id").agg(
        (F.count_if(F.col("event_role") == "vehicle") / F.countDistinct("frame_id")).alias("vehicles"), (F.count_if(F.col("event_role") == "pedestrian") / F.countDistinct("frame_id")).alias("pedestrians"), height.alias("h")
    )
    return out.select("sequence_id", "vehicles", "pedestrians", F.when(F.col("h") > 0, 1500 * 1.7 / F.col("h")).alias("altitude_estimate"), scene_type(F.col("vehicles"), F.col("pedestrians")).alias("scene_type"))


def _ordered_pairs(states: DataFrame) -> DataFrame:
    keys = ["sequence_id", "frame_id", "zone_id"]
    side = lambda s: states.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in ("cx", "cy", "speed", "heading_deg")), F.col("track_id").alias(s))
    p = side("a").join(side("b").hint("merge"), keys).where("a <> b")
    return p.withColumns({"distance": G.distance(F.col("a_cx"), F.col("a_cy"), F.col("b_cx"), F.col("b_cy")), "bearing": G.heading(F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy"))})


def approaching(states: DataFrame, angle: float = 45.0, moving: float = 0.001) -> DataFrame:
    """A moving object of a zone heads for another one and their distance shrinks."""
    p = _ordered_pairs(states)
    before = F.lag("distance").over(W.partitionBy("sequence_id", "a", "b").orderBy("frame_id"))
    p = p.withColumns({"before": before, "off": G.heading_difference(F.col("a_heading_deg"), F.col("bearing"))})
    return p.where((F.col("a_speed") > moving) & (F.round("off", 9) < angle) & (F.round("distance", 9) < F.round("before", 9)))


def following_hits(states: DataFrame, angle: float = 30.0, most: float = 0.12) -> DataFrame:
    """Frames in which one vehicle of a zone is close behind another (a behind b) with the same heading; close ones meet over a grid."""
    v = states.where("event_role = 'vehicle'")
    p = within(v, v, most, ("track_id", "heading_deg", "zone_id")).where("a_track_id <> b_track_id and a_zone_id = b_zone_id")
    p = p.withColumn("bearing", G.heading(F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy")))
    p = p.where((F.col("distance") <= most) & (G.heading_difference(F.col("a_heading_deg"), F.col("b_heading_deg")) < angle) & (G.heading_difference(F.col("a_heading_deg"), F.col("bearing")) < angle))
    return p.select("sequence_id", "frame_id", F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), "distance")


def following(states: DataFrame, frames: DataFrame, at_least: int = 30, angle: float = 30.0, most: float = 0.12) -> DataFrame:
    """One vehicle behind another with the same heading for a run of processed frames."""
    p = following_hits(states, angle, most).join(frames.select("sequence_id", "frame_id", "ordinal").hint("merge"), ["sequence_id", "frame_id"])
    p = p.withColumn("island", F.col("ordinal") - F.row_number().over(W.partitionBy("sequence_id", "a", "b").orderBy("ordinal")))
    runs = p.groupBy("sequence_id", "a", "b", "island").agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.count(F.lit(1)).alias("n_frames"), F.avg("distance").alias("avg_trail_distance"))
    return runs.where(F.col("n_frames") >= at_least).drop("island")


def lifecycle(hits: DataFrame, keys: list[str], frames: DataFrame, min_frames: int, grace: int) -> DataFrame:
    """Intervals in which a condition holds: hits no more than ``grace`` frames apart, at least ``min_frames`` of them.

    An interval is active if the sequence ends within its grace.
    """
    order = W.partitionBy(*keys).orderBy("frame_id")
    h = hits.select(*keys, "frame_id").distinct()
    fresh = F.when(F.col("frame_id") - F.lag("frame_id").over(order) <= grace, 0).otherwise(1)
    h = h.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    runs = h.groupBy(*keys, "island").agg(F.min("frame_id").alias("valid_from"), F.max("frame_id").alias("valid_to"), F.count(F.lit(1)).alias("n_frames")).where(F.col("n_frames") >= min_frames)
    end = frames.groupBy("sequence_id").agg(F.max("frame_id").alias("end"))
    return runs.join(end, "sequence_id").select(*keys, "valid_from", "valid_to", "n_frames", (F.col("valid_to") + grace >= F.col("end")).alias("is_active"))


#: Relationship -> (frames until it is active, frames of interruption that it survives)
CONDITIONS = {"IN_ZONE": (1, 5), "NEAR": (1, 3), "CONVOY_WITH": (45, 10), "FOLLOWING": (30, 8), "LOITERING_IN": (90, 15), "APPROACHING": (3, 2)}


def condition_states(hits: DataFrame, keys: list[str], frames: DataFrame, kind: str, conditions: dict = CONDITIONS) -> DataFrame:
    """The lifecycle of an ongoing condition: one row for each of its intervals, with the state at the end of the sequence.

    hits: (keys with sequence_id, frame_id), the frames at which the condition holds.  An interruption of at most ``grace`` frames
    does not end an interval.  A candidate has held for fewer frames than it takes; active holds
    in the last frame, interrupted ended within its grace, closed before.  Only the states but
    candidate belong into the graph; ``valid_to`` is set for closed intervals.
    """
    least, grace = conditions[kind]
    order = W.partitionBy(*keys).orderBy("frame_id")
    h = hits.select(*keys, "frame_id").distinct()
    h = h.withColumn("fresh", F.when(F.col("frame_id") - F.lag("frame_id").over(order) - 1 <= grace, 0).otherwise(1))
    h = h.withColumn("island", F.sum("fresh").over(order))
    runs = h.groupBy(*keys, "island").agg(F.min("frame_id").alias("valid_from"), F.max("frame_id").alias("last"), F.count(F.lit(1)).alias("n_frames"))
    runs = runs.join(frames.groupBy("sequence_id").agg(F.max("frame_id").alias("end")), "sequence_id")
    missed = F.col("end") - F.col("last")
    state = F.when(F.col("n_frames") < least, "candidate").when(missed == 0, "active").when(missed <= grace, "interrupted").otherwise("closed")
    runs = runs.withColumn("state", state)
    valid_to = F.when(F.col("state") == "closed", F.col("last"))
    return runs.select(F.lit(kind).alias("kind"), *keys, "valid_from", valid_to.alias("valid_to"), "n_frames", "state", F.col("state").isin("active", "interrupted").alias("is_active"))


def close(intervals: DataFrame, frames: DataFrame, objects: DataFrame | None = None, track: str = "track_id") -> DataFrame:
    """Intervals at the end of their sequences: none is active any more.

    ``valid_to`` of an open one becomes the last frame of its track, if ``objects`` tell when that
    was lost, else that of the sequence.
    """
    out = intervals.join(frames.groupBy("sequence_id").agg(F.max("frame_id").alias("end")), "sequence_id")
    stop = F.col("end")
    if objects is not None:
        seen = objects.select("sequence_id", F.col("track_id").alias(track), F.col("last_seen_frame").alias("seen"))
        out, stop = out.join(seen, ["sequence_id", track], "left"), F.least("seen", "end")
    state = F.when(F.col("state") == "candidate", "candidate").otherwise("closed")
    valid_to = F.when(F.col("state") == "candidate", F.lit(None)).otherwise(F.coalesce("valid_to", stop))
    return out.withColumns({"valid_to": valid_to, "state": state, "is_active": F.lit(False)}).select(*intervals.columns)


def track_status(objects: DataFrame, frames: DataFrame) -> DataFrame:
    """(sequence_id, track_id, status, lost_at): lost if the track was not seen in the sequence's last frame, and the frame it was first missed in."""
    following = frames.select("sequence_id", F.col("previous").alias("last_seen_frame"), F.col("frame_id").alias("lost_at"))
    out = objects.drop("status").join(following, ["sequence_id", "last_seen_frame"], "left")
    return out.select("sequence_id", "track_id", F.when(F.col("lost_at").isNull(), "active").otherwise("lost").alias("status"), "lost_at")


VULNERABLE, VEHICLE = "VulnerableRoadUser", "MotorVehicle"
SAME_PAIR_GAP = 30


def merged_near_misses(hits: DataFrame, gap: int = SAME_PAIR_GAP, critical: float = 0.03) -> DataFrame:
    """NEAR_MISS as documented: hits of a pair at most ``gap`` frames apart are one relationship.

    hits: rows of ``events.near_miss_hits``.  It carries the closest approach, its frame (the first of
    equals) and speeds, the severity, and the frames that it spans.
    """
    pair = ["sequence_id", "a_track_id", "b_track_id"]
    order = W.partitionBy(*pair).orderBy("frame_id")
    h = hits.withColumn("fresh", F.when(F.col("frame_id") - F.lag("frame_id").over(order) <= gap, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order))
    closest = F.min(F.struct("distance", "frame_id", F.col("a_speed").alias("speed_a"), F.col("b_speed").alias("speed_b")))
    runs = h.groupBy(*pair, "island").agg(closest.alias("c"), F.min("frame_id").alias("valid_from"), F.max("frame_id").alias("valid_to"))
    return runs.select(*pair, "c.*", F.when(F.col("c.distance") < critical, "critical").otherwise("warning").alias("severity"), "valid_from", "valid_to")


def strict_convoys(states: DataFrame, frames: DataFrame, cfg: Config = DEFAULT, variance: float = 0.005) -> DataFrame:
    """CONVOY_WITH as documented: both vehicles move linearly, and their distance hardly varies over the run."""
    from .events import convoy_pairs

    linear = states.where((F.col("movement_pattern") == "linear") & F.col("class_name").isin(*CLASS_GROUPS["MotorVehicle"]))
    p = convoy_pairs(linear, cfg).where(F.col("heading_diff") < cfg.convoy.heading).join(frames.select("sequence_id", "frame_id", "ordinal").hint("merge"), ["sequence_id", "frame_id"])
    pair = ["sequence_id", "a_track_id", "b_track_id"]
    p = p.withColumn("island", F.col("ordinal") - F.row_number().over(W.partitionBy(*pair).orderBy("ordinal")))
    runs = p.groupBy(*pair, "island").agg(F.min("frame_id").alias("valid_from"), F.max("frame_id").alias("valid_to"), F.count(F.lit(1)).alias("n_frames"), F.avg("distance").alias("avg_distance"), F.var_pop("distance").alias("variance"))
    return runs.where((F.col("n_frames") >= cfg.convoy.frames) & (F.col("variance") < variance)).drop("island", "variance")


def strict_jaywalking(states: DataFrame, stats: DataFrame, cfg: Config = DEFAULT, pedestrians: float = 0.20) -> DataFrame:
    """JAYWALKING_IN as documented: the zone is mostly vehicles and hardly any pedestrians."""
    busy = stats.where((F.col("vehicle_ratio") > cfg.jaywalking.vehicle_ratio) & (F.col("pedestrian_ratio") < pedestrians)).select("sequence_id", "frame_id", "zone_id", "vehicle_ratio", "pedestrian_ratio")
    walkers = states.where(F.col("class_name").isin("pedestrian", "people")).select("sequence_id", "frame_id", "zone_id", "track_id")
    return walkers.join(busy.hint("merge"), ["sequence_id", "frame_id", "zone_id"])


def event_classes(events: DataFrame) -> DataFrame:
    """CLASSIFIED_AS: (event_key, name) from each event to its node in the taxonomy of events."""
    from .events import keyed

    return keyed(events).select("sequence_id", "event_key", F.col("event_type").alias("name")).distinct()


def overlaps_zones(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """OVERLAPS_WITH: (sequence_id, track_id, frame_id, zone_id) for the zones that a box reaches into besides its own."""
    grid = cfg.motion.grid
    cell = lambda c: F.least(F.floor(F.col(c) * grid).cast("int"), F.lit(grid - 1))
    rows = states.withColumn("r", F.explode(F.sequence(cell("y1"), cell("y2")))).withColumn("c", F.explode(F.sequence(cell("x1"), cell("x2"))))
    other = F.concat(F.lit("cell_"), F.col("r").cast("string"), F.lit("_"), F.col("c").cast("string"))
    return rows.where((F.col("r") >= 0) & (F.col("c") >= 0) & (other != F.col("zone_id"))).select("sequence_id", "track_id", "frame_id", other.alias("zone_id"))


def graph_violations(g) -> DataFrame:
    """(rule, n): how many rows of the graph's tables break each rule on structure (S), completeness (P) and cardinality (C).

    A table that is absent breaks nothing.  Sequence scope (S2) counts edges whose ends are not both
    objects of the edge's sequence; class rules (S5) look at every class an end ever had.  Ends and classes
    serve several rules, so they are written once: the driver plans them once.
    """
    pairs = [n for n in ("edge_near", "edge_near_miss", "edge_convoy_with") if n in g]
    ends = lambda n: g[n].select("sequence_id", "a_track_id", "b_track_id")
    objects = g["node_object"].select("sequence_id", "track_id")
    every = write_once(reduce(DataFrame.unionByName, map(ends, pairs)))
    known = lambda df, side: df.join(objects.withColumnRenamed("track_id", f"{side}_track_id").hint("merge"), ["sequence_id", f"{side}_track_id"], "left_anti")
    group = write_once(g["edge_belongs_to_class"].groupBy("sequence_id", "track_id").agg(F.collect_set("class_group").alias("groups")))

    def not_of(df, side, wanted):
        k = group.withColumnRenamed("track_id", side)
        return df.join(k.hint("merge"), ["sequence_id", side], "left").where(~F.coalesce(F.array_contains("groups", wanted), F.lit(False))).drop("groups")

    nm, cv = ends("edge_near_miss"), ends("edge_convoy_with")
    s5 = {
        "S5_near_miss": not_of(nm, "a_track_id", VULNERABLE).unionByName(not_of(nm, "b_track_id", VEHICLE)).distinct(),
        "S5_convoy": not_of(cv, "a_track_id", VEHICLE).unionByName(not_of(cv, "b_track_id", VEHICLE)).distinct(),
        "S5_loitering": not_of(g["edge_loitering_in"], "track_id", VULNERABLE), "S5_jaywalking": not_of(g["edge_jaywalking_in"], "track_id", VULNERABLE),
    }
    lives = g["node_object"].select("sequence_id", "track_id", "first_seen_frame", "last_seen_frame")
    lacks = lambda df, *columns: df.where(reduce(lambda x, y: x | y, [F.col(c).isNull() if c in df.columns else F.lit(True) for c in columns]))
    semantic = [g[n].select("frame_id") for n in ("edge_near_miss", "edge_convoy_with", "edge_loitering_in", "edge_jaywalking_in")]
    pair = W.partitionBy("sequence_id", "primary_track_id", "secondary_track_id").orderBy("frame_id")
    misses = g["node_event"].where("event_type = 'NEAR_MISS'").withColumn("gap", F.col("frame_id") - F.lag("frame_id").over(pair))
    more_than_one = lambda df, *keys: df.groupBy(*keys).count().where("count > 1")
    rules = {
        "S1": every.where("a_track_id = b_track_id"), "S2": known(every, "a").unionByName(known(every, "b")).distinct(),
        "S3": g["edge_appeared_in"].join(lives.hint("merge"), ["sequence_id", "track_id"]).where("frame_id < first_seen_frame or frame_id > last_seen_frame"),
        "S4": g["edge_precedes"].where("from_frame >= to_frame"), **s5,
        "P1": lacks(g["edge_appeared_in"], "cx", "cy"), "P2": lacks(g["edge_near"], "distance", "frame_id"),
        "P3": lacks(reduce(DataFrame.unionByName, semantic), "frame_id"), "P4": lacks(g["node_event"], "event_type", "frame_id", "sequence_id", "confidence"),
        "P5": g["edge_involves"].where("role is null or role not in ('primary', 'secondary')"),
        "C1": more_than_one(g["edge_in_zone"], "sequence_id", "track_id", "frame_id"), "C2": misses.where(F.col("gap") <= SAME_PAIR_GAP),
    }
    if "canonical" in g:
        c = g["canonical"].where("canonical_id <> track_id")
        rules["C3"] = more_than_one(c, "sequence_id", "canonical_id")
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def violations(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(rule, n): how many states break each plausibility rule."""
    rules = {
        "centroid_range": (F.col("cx") < 0) | (F.col("cx") > 1) | (F.col("cy") < 0) | (F.col("cy") > 1),
        "negative_speed": F.col("speed") < 0, "heading_range": (F.col("heading_deg") < 0) | (F.col("heading_deg") >= 360), "fast": F.col("speed") > 0.5,
    }
    one = states.agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
    parts = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))).alias("r")).select("r.*")
    twice = states.groupBy("sequence_id", "track_id", "frame_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_state").alias("rule"), "n")
    return reduce(DataFrame.unionByName, [parts, twice])


def crowd_members(events: DataFrame, states: DataFrame) -> DataFrame:
    """(event_key, track_id): persons in the zone of a crowd at its frame."""
    from .events import keyed

    crowd = keyed(events.where("event_type = 'CROWD_FORM'")).select("sequence_id", "frame_id", "zone_id", "event_key")
    people = states.where("event_role = 'pedestrian'").select("sequence_id", "frame_id", "zone_id", "track_id")
    return crowd.join(people.hint("merge"), ["sequence_id", "frame_id", "zone_id"]).select("sequence_id", "event_key", "track_id").distinct()


def triggered_by(events: DataFrame, cause: str, effect: str, within: int) -> DataFrame:
    """Each effect with the latest cause in the same zone at most ``within`` frames before it."""
    zone = W.partitionBy("sequence_id", "zone_id").orderBy("frame_id").rangeBetween(-within, -1)
    e = events.where(F.col("event_type").isin(cause, effect))
    e = e.withColumn("cause_frame", F.max(F.when(F.col("event_type") == cause, F.col("frame_id"))).over(zone))
    return e.where((F.col("event_type") == effect) & F.col("cause_frame").isNotNull()).select("sequence_id", "zone_id", "cause_frame", F.col("frame_id").alias("effect_frame"), "primary_track_id")


def overlaps(states: DataFrame, least: float = 0.0, cell: float = 0.05) -> DataFrame:
    """Pairs of a frame and zone whose boxes overlap more than ``least``."""
    p = overlapping(states, states, cell, ("track_id",), ("sequence_id", "frame_id", "zone_id")).where("a_track_id < b_track_id")
    iou = G.iou(tuple(F.col(f"a_{c}") for c in BOX), tuple(F.col(f"b_{c}") for c in BOX))
    return p.select("sequence_id", "frame_id", F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), iou.alias("iou")).where(F.col("iou") > least)
