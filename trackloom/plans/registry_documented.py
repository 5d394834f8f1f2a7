"""Queries and oracles of the operators that are documented for the domain but not part of the base rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E, graph, lifecycle as L, motion, reid, zones
from ..sources import sequences as S
from ..sources.adapter import CONFIG
from . import registry_matching  # noqa: F401  (its tables of truths and predictions)
from .oracles import CTES, sql
from .registry import ORACLES, r6, register, states, tables
from .registry import _accepted as accepted

GRAY = "[(frame_id * 37 + n * 3) % 256, (frame_id * 11) % 256, n % 256, (frame_id // 7 * 90) % 256]"
CTES["pixels"] = (f"SELECT sequence_id, frame_id, {GRAY} AS gray FROM (SELECT sequence_id, frame_id, count(*) AS n FROM states GROUP BY ALL)", ("states",))
CTES["light"] = (
    """SELECT sequence_id, frame_id, list_avg(gray) AS brightness, list_avg(list_transform(gray, lambda x, i: abs(x - before[i]))) AS difference
       FROM (SELECT *, lag(gray) OVER (PARTITION BY sequence_id ORDER BY frame_id) AS before FROM pixels)""",
    ("pixels",),
)


def light(spark, sf):
    """Brightness and change of small made-up grey frames."""
    f, n = states(spark, sf).groupBy("sequence_id", "frame_id").agg(F.count(F.lit(1)).alias("n")), F.col("n")
    k = F.col("frame_id")
    gray = F.array((k * 37 + n * 3) % 256, ((k * 11) % 256).cast("long"), n % 256, (F.floor(k / 7) * 90) % 256)
    return L.pixel_stats(f.select("sequence_id", "frame_id", gray.alias("gray")))


@register("z4_quality_flags", sql("""SELECT sequence_id, frame_id, round(brightness, 6) AS brightness, round(difference, 6) AS difference, brightness < 20 AS is_dark, brightness > 240 AS is_bright, coalesce(difference < 2, false) AS is_static FROM light""", "light"))
def _(spark, sf):
    return L.quality_flags(light(spark, sf)).select("sequence_id", "frame_id", *r6("brightness", "difference"), "is_dark", "is_bright", "is_static")


@register("z6_time_of_day", sql("""
SELECT sequence_id, arg_min(kind, (-n, kind)) AS time_of_day FROM (SELECT sequence_id, CASE WHEN brightness < 60 THEN 'nighttime' WHEN brightness < 120 THEN 'dusk_dawn' ELSE 'daytime' END AS kind, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY frame_id) AS place FROM light) WHERE place <= 10 GROUP BY ALL) GROUP BY sequence_id""", "light"))
def _(spark, sf):
    return L.time_of_day(light(spark, sf))


@register("z6_scene_type", sql("""
SELECT sequence_id, CASE WHEN v > 10 AND p > 5 THEN 'urban_dense' WHEN v > 5 THEN 'urban' WHEN v > 2 THEN 'suburban' ELSE 'rural' END AS scene_type FROM (
  SELECT sequence_id, count(*) FILTER (WHERE event_role = 'vehicle') / count(DISTINCT frame_id) AS v, count(*) FILTER (WHERE event_role = 'pedestrian') / count(DISTINCT frame_id) AS p
  FROM states WHERE frame_id < 30 AND (track_id % 50 < 6 OR sequence_id <> 'seq_1') AND (track_id % 50 < 9 OR sequence_id <> 'seq_2') GROUP BY sequence_id)""", "states"))
def _(spark, sf):
    """Some sequences are thinned out, so that they differ."""
    few = states(spark, sf).where("(track_id % 50 < 6 or sequence_id <> 'seq_1') and (track_id % 50 < 9 or sequence_id <> 'seq_2')")
    return L.scene_profile(few).select("sequence_id", "scene_type")




@register("z5_sequence_selection", sql("""
SELECT sequence_id, count(DISTINCT frame_id) AS n_frames, round(count(*) / count(DISTINCT frame_id), 6) AS objects_per_frame FROM states WHERE (track_id // 50) % 2 = 0
GROUP BY ALL HAVING count(DISTINCT frame_id) >= 50 AND count(*) / count(DISTINCT frame_id) >= 5""", "states"))
def _(spark, sf):
    """Every second sequence is too small."""
    small = F.expr("track_id div 50 % 2 = 1")
    s = states(spark, sf).withColumns({"frame_width": F.when(small, 640.0).otherwise(1360.0), "frame_height": F.when(small, 480.0).otherwise(765.0)})
    return L.select_sequences(s, min_frames=50, min_objects=5).select("sequence_id", "n_frames", *r6("objects_per_frame"))


# ------------------------------------------------------------------ ground truth


@register("z1_annotations", sql("""
SELECT sequence_id, frame_id, track_id, ['pedestrian', 'people', 'bicycle', 'car', 'van', 'truck', 'tricycle', 'awning-tricycle', 'bus', 'motor'][c] AS class_name,
  CASE WHEN c IN (4, 5, 6, 9) THEN 'MotorVehicle' ELSE 'VulnerableRoadUser' END AS class_group, x AS x1, x + 16.0 AS x2, o AS occlusion, NOT (t = 1 AND o = 2) AS is_reliable FROM (
  SELECT sequence_id, frame_id, track_id, track_id % 12 AS c, CAST(round_even(x1 * 1000, 0) AS INTEGER)::DOUBLE AS x, frame_id % 3 AS o, track_id % 2 AS t FROM states WHERE (track_id + frame_id) % 13 <> 0) WHERE c BETWEEN 1 AND 10""", "states"))
def _(spark, sf):
    """Lines of ground-truth files made from the states; some carry score 0, some are no such lines."""
    s = states(spark, sf)
    score = F.when((F.col("track_id") + F.col("frame_id")) % 13 == 0, 0).otherwise(1)
    numbers = (F.col("frame_id") + 1, F.col("track_id"), F.bround(F.col("x1") * 1000, 0).cast("int"), F.lit(7), F.lit(16), F.lit(33), score, F.col("track_id") % 12, F.col("track_id") % 2, F.col("frame_id") % 3)
    lines = s.select("sequence_id", F.concat_ws(",", *(n.cast("string") for n in numbers)).alias("value"))
    other = lines.limit(3).select("sequence_id", F.lit("1,2,three,4").alias("value")).unionByName(lines.limit(2).select("sequence_id", F.lit("").alias("value")))
    a = L.annotations(S.annotation_rows(lines.unionByName(other)))
    return a.select("sequence_id", "frame_id", F.col("track_id").cast("long").alias("track_id"), "class_name", "class_group", "x1", "x2", "occlusion", "is_reliable")


BOTH = "greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1))"
AREA = "greatest(0, {0}.x2 - {0}.x1) * greatest(0, {0}.y2 - {0}.y1)"


@register("z2_occlusion", sql(f"""
SELECT p.image_id, p.track_id AS pos, coalesce(arg_min(t.track_id % 3, t.track_id) FILTER (WHERE ({BOTH}) / ({AREA.format('p')} + {AREA.format('t')} - {BOTH}) > 0.5), 0) AS occlusion
FROM preds p JOIN truths t USING (image_id) GROUP BY ALL""", "preds", "truths"))
def _(spark, sf):
    from .registry import truth_and_predictions

    t, p = truth_and_predictions(spark, sf)
    boxes = lambda df: df.select(F.concat_ws(":", "sequence_id", "frame_id").alias("image_id"), F.col("track_id").alias("pos"), "x1", "y1", "x2", "y2", (F.col("track_id") % 3).alias("occlusion"))
    return L.transfer_occlusion(boxes(p), boxes(t)).select("image_id", "pos", "occlusion")


@register("z3_reprojection", sql("""SELECT sequence_id, track_id, frame_id, round(greatest(0, least(1360, x1 * 1280 / (1280::DOUBLE / 1360))) / 1360, 6) AS x1,
  round(greatest(0, least(765, (y2 * 1280 - 280) / (1280::DOUBLE / 1360))) / 765, 6) AS y2 FROM states""", "states"))
def _(spark, sf):
    """Boxes in letterbox pixels, mapped back and clamped before they are normalised."""
    s = states(spark, sf).select("sequence_id", "track_id", "frame_id", "class_name", *((F.col(c) * 1280).alias(c) for c in ("x1", "y1", "x2", "y2")), F.lit(1360.0).alias("frame_width"), F.lit(765.0).alias("frame_height"))
    return motion.enrich(s, CONFIG, reproject=True).select("sequence_id", "track_id", "frame_id", *r6("x1", "y2"))


# ------------------------------------------------------------------ lifecycles

LEAST, GRACE = L.CONDITIONS["NEAR"]
ISLES = """SELECT sequence_id, {keys}, valid_from, CASE WHEN state = 'closed' THEN last END AS valid_to, n_frames, state, state IN ('active', 'interrupted') AS is_active FROM (
  SELECT *, CASE WHEN n_frames < {least} THEN 'candidate' WHEN e = last THEN 'active' WHEN e - last <= {grace} THEN 'interrupted' ELSE 'closed' END AS state FROM (
    SELECT sequence_id, {keys}, min(frame_id) AS valid_from, max(frame_id) AS last, count(*) AS n_frames FROM (
      SELECT *, sum(CASE WHEN frame_id - before - 1 <= {grace} THEN 0 ELSE 1 END) OVER (PARTITION BY sequence_id, {keys} ORDER BY frame_id) AS isle FROM (
        SELECT *, lag(frame_id) OVER (PARTITION BY sequence_id, {keys} ORDER BY frame_id) AS before FROM {hits})) GROUP BY sequence_id, {keys}, isle)
  JOIN (SELECT sequence_id, max(frame_id) AS e FROM frames GROUP BY ALL) USING (sequence_id))"""
CTES["near_hits"] = (
    """SELECT * FROM (SELECT a.sequence_id, a.frame_id, a.track_id AS a_track_id, b.track_id AS b_track_id, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d
         FROM states a JOIN states b ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id AND a.zone_id = b.zone_id AND a.track_id < b.track_id) WHERE d < 0.08""",
    ("states",),
)
CTES["near_isles"] = (ISLES.format(keys="a_track_id, b_track_id", hits="near_hits", least=LEAST, grace=GRACE), ("near_hits", "frames"))
CTES["still"] = ("SELECT sequence_id, track_id, zone_id, frame_id FROM loiter_flags WHERE ok", ("loiter_flags",))
CTES["still_isles"] = (ISLES.format(keys="track_id, zone_id", hits="still", least=4, grace=2), ("still", "frames"))


def near_states(s):
    return L.condition_states(graph.near_pairs(s, CONFIG), ["sequence_id", "a_track_id", "b_track_id"], motion.frames(s), "NEAR")


@register("z10_near_states", sql("SELECT 'NEAR' AS kind, * FROM near_isles", "near_isles"))
def _(spark, sf):
    return near_states(states(spark, sf))


@register("z10_loitering_states", sql("SELECT 'LOITERING_IN' AS kind, * FROM still_isles", "still_isles"))
def _(spark, sf):
    """Frames until active and of grace that suit 60 frames."""
    s = states(spark, sf)
    hits = E.loiter_runs(s, CONFIG).select("sequence_id", "track_id", "zone_id", "frame_id")
    return L.condition_states(hits, ["sequence_id", "track_id", "zone_id"], motion.frames(s), "LOITERING_IN", {"LOITERING_IN": (4, 2)})


@register("z11_sequence_end", sql("""
SELECT 'NEAR' AS kind, n.sequence_id, a_track_id, b_track_id, valid_from, CASE WHEN state <> 'candidate' THEN coalesce(valid_to, least(o.last_seen_frame, e)) END AS valid_to, n_frames,
  CASE WHEN state = 'candidate' THEN state ELSE 'closed' END AS state, false AS is_active FROM near_isles n JOIN (SELECT sequence_id, max(frame_id) AS e FROM frames GROUP BY ALL) USING (sequence_id)
LEFT JOIN objects o ON o.sequence_id = n.sequence_id AND o.track_id = a_track_id""", "near_isles", "frames", "objects"))
def _(spark, sf):
    s = states(spark, sf)
    return L.close(near_states(s), motion.frames(s), graph.object_nodes(s), "a_track_id")


@register("z11_track_status", sql("""
SELECT o.sequence_id, o.track_id, CASE WHEN f.frame_id IS NULL THEN 'active' ELSE 'lost' END AS status, f.frame_id AS lost_at FROM objects o
LEFT JOIN frames f ON f.sequence_id = o.sequence_id AND f.previous = o.last_seen_frame""", "objects", "frames"))
def _(spark, sf):
    s = states(spark, sf)
    return L.track_status(graph.object_nodes(s), motion.frames(s))


# ------------------------------------------------------------------ more edges, rules


@register("z9_event_classes", sql("SELECT DISTINCT sequence_id, event_key, event_type AS name FROM keyed", "keyed"))
def _(spark, sf):
    return L.event_classes(E.all_events(states(spark, sf), CONFIG))


@register("z9_zone_overlaps", sql("""
SELECT sequence_id, track_id, frame_id, 'cell_' || r || '_' || c AS zone_id FROM states,
  LATERAL (SELECT unnest(range(CAST(least(floor(y1 * 4), 3) AS INTEGER), CAST(least(floor(y2 * 4), 3) AS INTEGER) + 1)) AS r), LATERAL (SELECT unnest(range(CAST(least(floor(x1 * 4), 3) AS INTEGER), CAST(least(floor(x2 * 4), 3) AS INTEGER) + 1)) AS c)
WHERE r >= 0 AND c >= 0 AND 'cell_' || r || '_' || c <> zone_id""", "states"))
def _(spark, sf):
    return L.overlaps_zones(states(spark, sf), CONFIG)


@register("z9_overlapping_boxes", sql("""
SELECT sequence_id, frame_id, a, b, round(i / (0.04::DOUBLE * 0.04::DOUBLE * 2 - i), 6) AS iou FROM (SELECT a.sequence_id, a.frame_id, a.track_id AS a, b.track_id AS b,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i FROM states a JOIN states b
  ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id AND a.zone_id = b.zone_id AND a.track_id < b.track_id) WHERE i / (0.04::DOUBLE * 0.04::DOUBLE * 2 - i) > 0.1""", "states"))
def _(spark, sf):
    return L.overlaps(states(spark, sf), 0.1).select("sequence_id", "frame_id", "a", "b", *r6("iou"))


CTES["dirty"] = ("SELECT sequence_id, track_id, first_seen_frame + 1 AS first_seen_frame, last_seen_frame - 2 AS last_seen_frame FROM objects WHERE track_id % 10 <> 4", ("objects",))
CTES["ends_"] = (
    """SELECT sequence_id, a, b FROM near_ UNION ALL SELECT 'seq_0', 7, 7
       UNION ALL SELECT DISTINCT sequence_id, primary_track_id, secondary_track_id FROM events_ WHERE event_type IN ('NEAR_MISS', 'CONVOY')
       UNION ALL SELECT DISTINCT sequence_id, secondary_track_id, primary_track_id FROM events_ WHERE event_type = 'CONVOY'""",
    ("near_", "events_"),
)
CTES["kinds"] = ("SELECT sequence_id, track_id, list(DISTINCT class_group) AS groups FROM states JOIN classes ON class_name = name GROUP BY ALL", ("states", "classes"))


@register("z12_graph_rules", sql("""
SELECT 'S1' AS rule, count(*) AS n FROM ends_ WHERE a = b
UNION ALL SELECT 'S2', count(*) FROM (SELECT DISTINCT sequence_id, a, b FROM ends_ e WHERE NOT EXISTS (FROM dirty d WHERE d.sequence_id = e.sequence_id AND d.track_id = e.a) OR NOT EXISTS (FROM dirty d WHERE d.sequence_id = e.sequence_id AND d.track_id = e.b))
UNION ALL SELECT 'S3', count(*) FROM states s JOIN dirty d USING (sequence_id, track_id) WHERE s.frame_id < first_seen_frame OR s.frame_id > d.last_seen_frame
UNION ALL SELECT 'S4', count(*) FROM frames WHERE frame_id % 20 = 0 AND previous IS NOT NULL
UNION ALL SELECT 'S5_' || kind, count(*) FILTER (WHERE NOT ok) FROM (
  SELECT 'near_miss' AS kind, list_contains(p.groups, 'VulnerableRoadUser') AND list_contains(s.groups, 'MotorVehicle') AS ok FROM (SELECT DISTINCT sequence_id, primary_track_id, secondary_track_id FROM events_ WHERE event_type = 'NEAR_MISS') e
    JOIN kinds p ON p.sequence_id = e.sequence_id AND p.track_id = primary_track_id JOIN kinds s ON s.sequence_id = e.sequence_id AND s.track_id = secondary_track_id
  UNION ALL SELECT 'convoy', list_contains(p.groups, 'MotorVehicle') AND list_contains(s.groups, 'MotorVehicle') FROM (SELECT DISTINCT sequence_id, primary_track_id, secondary_track_id FROM events_ WHERE event_type = 'CONVOY') e
    JOIN kinds p ON p.sequence_id = e.sequence_id AND p.track_id = primary_track_id JOIN kinds s ON s.sequence_id = e.sequence_id AND s.track_id = secondary_track_id
  UNION ALL SELECT 'loitering', list_contains(p.groups, 'VulnerableRoadUser') FROM (SELECT DISTINCT sequence_id, primary_track_id, zone_id FROM events_ WHERE event_type = 'LOITER') e JOIN kinds p ON p.sequence_id = e.sequence_id AND p.track_id = primary_track_id
  UNION ALL SELECT 'jaywalking', list_contains(p.groups, 'VulnerableRoadUser') FROM (SELECT DISTINCT sequence_id, primary_track_id, zone_id FROM events_ WHERE event_type = 'JAYWALKING') e JOIN kinds p ON p.sequence_id = e.sequence_id AND p.track_id = primary_track_id) GROUP BY kind
UNION ALL SELECT 'P1', count(*) FROM states WHERE track_id % 7 = 0 UNION ALL SELECT 'P2', count(*) FROM near_ WHERE a % 5 = 0
UNION ALL SELECT 'P3', count(*) FROM (SELECT DISTINCT sequence_id, primary_track_id, zone_id FROM events_ WHERE event_type = 'LOITER' AND primary_track_id % 4 = 0)
UNION ALL SELECT 'P4', count(*) FROM (SELECT DISTINCT event_key, zone_id FROM keyed WHERE event_type = 'CROWD_FORM')
UNION ALL SELECT 'P5', count(*) FROM (""" + ORACLES["edge_involves"] + """) WHERE track_id % 4 = 0
UNION ALL SELECT 'C1', count(*) FROM states WHERE track_id % 9 = 0
UNION ALL SELECT 'C2', count(*) FROM (SELECT frame_id - lag(frame_id) OVER (PARTITION BY sequence_id, primary_track_id, secondary_track_id ORDER BY frame_id) AS gap FROM events_ WHERE event_type = 'NEAR_MISS') WHERE gap <= 30
UNION ALL SELECT 'C3', count(*) FROM (SELECT sequence_id, c FROM (SELECT sequence_id, coalesce(a.t, b.t) AS t, coalesce(a.c, b.c) AS c FROM (SELECT sequence_id, track_a AS t, least(track_a, track_b) AS c FROM accepted) a
  FULL JOIN (SELECT sequence_id, track_b AS t, least(track_a, track_b) AS c FROM accepted) b USING (sequence_id, t)) WHERE c <> t GROUP BY ALL HAVING count(*) > 1)""", "ends_", "dirty", "kinds", "frames", "accepted", "states", "keyed"))
def _(spark, sf):
    """The graph with a fault for every rule: a loop, objects left out or of too short a life, frames turned round, distances, centroids, frames and confidences lost, roles made up, zones doubled."""
    g = tables(spark, sf)
    objects = g["node_object"].where("track_id % 10 <> 4").withColumns({"first_seen_frame": F.col("first_seen_frame") + 1, "last_seen_frame": F.col("last_seen_frame") - 2})
    near = g["edge_near"].withColumn("distance", F.when(F.col("a_track_id") % 5 != 0, F.col("distance")))
    loop = spark.createDataFrame([("seq_0", 7, 7, 0, 0.01, False)], "sequence_id string, a_track_id long, b_track_id long, frame_id int, distance double, both_moving boolean")
    turn = F.col("to_frame") % 20 == 0
    precedes = g["edge_precedes"].withColumns({"from_frame": F.when(turn, F.col("to_frame")).otherwise(F.col("from_frame")), "to_frame": F.when(turn, F.col("from_frame")).otherwise(F.col("to_frame"))})
    zones = g["edge_in_zone"]
    twice = zones.where("track_id % 9 = 0").withColumn("zone_id", F.lit("cell_9_9"))
    lost = lambda t, c, when: t.withColumn(c, F.when(~when, F.col(c)))
    dirty = g.changed(
        edge_appeared_in=lost(g["edge_appeared_in"], "cx", F.col("track_id") % 7 == 0), edge_loitering_in=lost(g["edge_loitering_in"], "frame_id", F.col("track_id") % 4 == 0),
        node_event=lost(g["node_event"], "confidence", F.col("event_type") == "CROWD_FORM"), edge_involves=g["edge_involves"].withColumn("role", F.when(F.col("track_id") % 4 == 0, "witness").otherwise(F.col("role"))),
        node_object=objects, edge_near=near.unionByName(loop.select(near.columns)), edge_precedes=precedes, edge_in_zone=zones.unionByName(twice),
    )
    return L.graph_violations(dirty | {"canonical": reid.canonical(accepted(spark, sf))})


# ------------------------------------------------------------------ stricter rules


@register("z13_merged_near_misses", sql("""
SELECT sequence_id, a AS a_track_id, b AS b_track_id, round(min(distance), 6) AS distance, arg_min(frame_id, (distance, frame_id)) AS frame_id, CASE WHEN min(distance) < 0.03 THEN 'critical' ELSE 'warning' END AS severity,
  min(frame_id) AS valid_from, max(frame_id) AS valid_to FROM (SELECT *, sum(CASE WHEN frame_id - before <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY sequence_id, a, b ORDER BY frame_id) AS isle
  FROM (SELECT *, lag(frame_id) OVER (PARTITION BY sequence_id, a, b ORDER BY frame_id) AS before FROM hits)) GROUP BY sequence_id, a, b, isle""", "hits"))
def _(spark, sf):
    """With a gap that suits 60 frames."""
    return L.merged_near_misses(E.near_miss_hits(states(spark, sf), CONFIG), 6).select("sequence_id", "a_track_id", "b_track_id", *r6("distance"), "frame_id", "severity", "valid_from", "valid_to")


CTES["smooth"] = ("SELECT * REPLACE (CASE WHEN frame_id % 11 <> 0 THEN 'linear' ELSE movement_pattern END AS movement_pattern) FROM states", ("states",))
CTES["smooth_pairs"] = (
    """SELECT * FROM (SELECT a.sequence_id, a.frame_id, a.track_id AS a, b.track_id AS b, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS distance,
         least(abs(a.heading_deg - b.heading_deg) % 360, 360 - abs(a.heading_deg - b.heading_deg) % 360) AS heading_diff FROM smooth a JOIN smooth b
         ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id AND a.track_id < b.track_id AND a.class_name = b.class_name
         WHERE a.event_role = 'vehicle' AND a.movement_pattern = 'linear' AND b.movement_pattern = 'linear') WHERE distance >= 0.03 AND distance <= 0.12 AND heading_diff < 20""",
    ("smooth",),
)


@register("z13_strict_convoys", sql("""
SELECT sequence_id, a AS a_track_id, b AS b_track_id, min(frame_id) AS valid_from, max(frame_id) AS valid_to, count(*) AS n_frames, round(avg(distance), 6) AS avg_distance FROM (
  SELECT c.*, f.ordinal - row_number() OVER (PARTITION BY c.sequence_id, a, b ORDER BY f.ordinal) AS island FROM smooth_pairs c JOIN frames f ON c.sequence_id = f.sequence_id AND c.frame_id = f.frame_id)
GROUP BY sequence_id, a, b, island HAVING count(*) >= 3 AND var_pop(distance) < 0.0001""", "smooth_pairs", "frames"))
def _(spark, sf):
    """Most states are taken as linear, and the variance is tighter, so that both rules bite on these tracks."""
    s = states(spark, sf)
    smooth = s.withColumn("movement_pattern", F.when(F.col("frame_id") % 11 != 0, "linear").otherwise(F.col("movement_pattern")))
    return L.strict_convoys(smooth, motion.frames(s), CONFIG, 0.0001).select("sequence_id", "a_track_id", "b_track_id", "valid_from", "valid_to", "n_frames", *r6("avg_distance"))


@register("z13_strict_jaywalking", sql("""SELECT s.sequence_id, s.frame_id, s.zone_id, s.track_id, round(z.vehicle_ratio, 6) AS vehicle_ratio, round(z.pedestrian_ratio, 6) AS pedestrian_ratio FROM states s JOIN zstats z
  ON s.sequence_id = z.sequence_id AND s.frame_id = z.frame_id AND s.zone_id = z.zone_id WHERE s.class_name IN ('pedestrian', 'people') AND z.vehicle_ratio > 0.6 AND z.pedestrian_ratio < 0.35""", "states", "zstats"))
def _(spark, sf):
    s = states(spark, sf)
    return L.strict_jaywalking(s, zones.frame_stats(s, CONFIG), CONFIG, 0.35).select("sequence_id", "frame_id", "zone_id", "track_id", *r6("vehicle_ratio", "pedestrian_ratio"))
