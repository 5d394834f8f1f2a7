"""Registered parity queries and their DuckDB oracles.  Tables come from ``sources.adapter``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import geometry as G, text as T
from ..operators import evaluation as V, events as E, graph, lifecycle as L, messages as M, motion, reid, tracking, zones
from ..operators.neighbours import BOX, overlapping
from ..sources.adapter import CONFIG, tracks
from ..streaming import events as stream
from . import digest, traversals as Q
from .oracles import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.enrich(tracks(spark, sf_dir), CONFIG)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return graph.build(states(spark, sf_dir), CONFIG)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of three fragments of each track: so tracks end before others start."""
    s = states(spark, sf_dir)
    return reid.snapshots(s.select("sequence_id", F.expr("track_id * 10 + frame_id div 20").alias("track_id"), "frame_id", "class_name", "heading_deg", "cx", "cy"))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir)
    return s.groupBy("sequence_id", "frame_id", "zone_id").agg(F.count(F.lit(1)).alias("density")).orderBy(F.col("density").desc(), "sequence_id", "frame_id", "zone_id")


# ------------------------------------------------------------------ sources, motion


@register("q3_zone_density_all_frames", sql("SELECT sequence_id, frame_id, zone_id, count(*) AS density FROM states GROUP BY ALL", "states"))
def _(spark, sf):
    return flagship(spark, sf)


@register("t8_is_new", sql("SELECT sequence_id, track_id, frame_id, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) = 1 AS is_new FROM states", "states"))
def _(spark, sf):
    return motion.is_new(states(spark, sf))


@register("t9_lost_tracks", sql("""
SELECT g.sequence_id, g.track_id, g.frame_id AS last_frame, n.frame_id AS lost_at FROM (
  SELECT s.sequence_id, s.track_id, s.frame_id, f.ordinal, lead(f.ordinal) OVER (PARTITION BY s.sequence_id, s.track_id ORDER BY f.ordinal) AS nxt
  FROM states s JOIN frames f ON s.sequence_id = f.sequence_id AND s.frame_id = f.frame_id) g
JOIN frames n ON n.sequence_id = g.sequence_id AND n.ordinal = g.ordinal + 1 WHERE nxt IS NULL OR nxt > g.ordinal + 1""", "states", "frames"))
def _(spark, sf):
    s = states(spark, sf)
    return motion.lost(s, motion.frames(s))


@register("object_states", sql("""SELECT sequence_id, track_id, frame_id, class_name, round(cx, 6) AS cx, round(cy, 6) AS cy, round(speed, 6) AS speed, round(heading_deg, 6) AS heading_deg,
  movement_pattern, zone_id, event_role FROM states""", "states"))
def _(spark, sf):
    return states(spark, sf).select("sequence_id", "track_id", "frame_id", "class_name", *r6("cx", "cy", "speed", "heading_deg"), "movement_pattern", "zone_id", "event_role")


@register("m8_trajectory", sql("""SELECT sequence_id, track_id, frame_id, count(*) OVER w AS n_points, round(first_value(cx) OVER w, 6) AS oldest_cx, round(sum(cy) OVER w, 6) AS sum_cy
  FROM states WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY frame_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""", "states"))
def _(spark, sf):
    s = states(spark, sf)
    total = F.aggregate("trajectory", F.lit(0.0), lambda a, p: a + p[1])
    return s.select("sequence_id", "track_id", "frame_id", F.size("trajectory").cast("long").alias("n_points"), F.round(F.col("trajectory")[0][0], 6).alias("oldest_cx"), F.round(total, 6).alias("sum_cy"))


# ------------------------------------------------------------------ scalars


@register("m10_heading_diff", sql("SELECT sequence_id, track_id, frame_id, round(least(abs(heading_deg - 350) % 360, 360 - abs(heading_deg - 350) % 360), 6) AS diff FROM states", "states"))
def _(spark, sf):
    return states(spark, sf).select("sequence_id", "track_id", "frame_id", F.round(G.heading_difference(F.col("heading_deg"), F.lit(350.0)), 6).alias("diff"))


_IOU = """greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"""


@register("m14_bbox_iou", sql(f"""SELECT sequence_id, frame_id, a_track, b_track, round(i / (0.04::DOUBLE * 0.04::DOUBLE * 2 - i), 6) AS iou FROM (
  SELECT a.sequence_id, a.frame_id, a.track_id AS a_track, b.track_id AS b_track, {_IOU} AS i FROM states a JOIN states b
  ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id AND a.zone_id = b.zone_id AND a.track_id < b.track_id) WHERE i > 0""", "states"))
def _(spark, sf):
    s = states(spark, sf)
    p = overlapping(s, s, 0.05, ("track_id",), ("sequence_id", "frame_id", "zone_id")).where("a_track_id < b_track_id")
    iou = G.iou(tuple(F.col(f"a_{c}") for c in BOX), tuple(F.col(f"b_{c}") for c in BOX))
    return p.select("sequence_id", "frame_id", F.col("a_track_id").alias("a_track"), F.col("b_track_id").alias("b_track"), F.round(iou, 6).alias("iou")).where("iou > 0")


@register("m15_letterbox", """SELECT p_partkey, CAST(round_even(w * s, 0) AS INTEGER) AS new_width, CAST(round_even(h * s, 0) AS INTEGER) AS new_height, round(s, 6) AS scale,
  CAST(floor((1280 - round_even(h * s, 0)) / 2) AS INTEGER) AS pad_top FROM (SELECT *, least(1280.0::DOUBLE / w, 1280.0::DOUBLE / h) AS s FROM (
  SELECT p_partkey, 640 + p_size * 16 AS w, 480 + p_size * 9 AS h FROM part))""")
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (640 + F.col("p_size") * 16).alias("w"), (480 + F.col("p_size") * 9).alias("h"))
    lb = G.letterbox(F.col("w"), F.col("h"))
    return p.select("p_partkey", lb["new_width"].alias("new_width"), lb["new_height"].alias("new_height"), F.round(lb["scale"], 6).alias("scale"), lb["pad_top"].alias("pad_top"))


@register("m16_unletterbox", sql("""SELECT sequence_id, track_id, frame_id, round(greatest(0, least(1360, (x1 * 1280 - 0) / (1280::DOUBLE / 1360))), 6) AS x,
  round(greatest(0, least(765, (y1 * 1280 - 280) / (1280::DOUBLE / 1360))), 6) AS y FROM states""", "states"))
def _(spark, sf):
    lb = G.letterbox(F.lit(1360), F.lit(765))
    s = states(spark, sf)
    x = G.unletterbox(F.col("x1") * 1280, lb["pad_left"], lb["scale"], F.lit(1360))
    y = G.unletterbox(F.col("y1") * 1280, lb["pad_top"], lb["scale"], F.lit(765))
    return s.select("sequence_id", "track_id", "frame_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@register("m19_event_key", sql("SELECT event_key FROM keyed", "keyed"))
def _(spark, sf):
    return E.keyed(E.all_events(states(spark, sf), CONFIG)).select("event_key")


@register("m24_extract_json", """SELECT event_id, CAST(json_extract_string(regexp_extract('Thought: ' || props || ' done', '(\\{[^{}]*\\})', 1), '$.k') AS BIGINT) AS k FROM events""")
def _(spark, sf):
    text = F.concat(F.lit("Thought: "), "props", F.lit(" done"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.get_json_object(T.first_json(text), "$.k").cast("long").alias("k"))


@register("m23_strip_fences", """SELECT conv_id, turn, trim(text) AS clean FROM conversations""")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return c.select("conv_id", "turn", T.strip_fences(F.concat(F.lit("```json\n"), F.trim("text"), F.lit("\n```"))).alias("clean"))


# ------------------------------------------------------------------ zones, base graph

_Z = "sequence_id, frame_id, zone_id, pedestrian_count, vehicle_count, density, round(pedestrian_ratio, 6) AS pedestrian_ratio, round(vehicle_ratio, 6) AS vehicle_ratio"


def _zcols():
    return ["sequence_id", "frame_id", "zone_id", "pedestrian_count", "vehicle_count", "density", *r6("pedestrian_ratio", "vehicle_ratio")]


@register("a1_zone_frame_stats", sql(f"SELECT {_Z} FROM zstats", "zstats"))
def _(spark, sf):
    return zones.frame_stats(states(spark, sf), CONFIG).select(*_zcols())


@register("a2_zone_latest", sql(f"SELECT {_Z} FROM zlatest", "zlatest"))
def _(spark, sf):
    return zones.latest(zones.frame_stats(states(spark, sf), CONFIG)).select(*_zcols())


@register("a3_zone_nodes", sql("""SELECT sequence_id, zone_id, density AS last_density, round(vehicle_ratio, 6) AS vehicle_ratio, round(pedestrian_ratio, 6) AS pedestrian_ratio, u AS updated_at_frame
  FROM zlatest JOIN (SELECT sequence_id, max(frame_id) AS u FROM states GROUP BY ALL) USING (sequence_id)""", "zlatest", "states"))
def _(spark, sf):
    s = states(spark, sf)
    return zones.nodes(zones.frame_stats(s, CONFIG), s).select("sequence_id", "zone_id", "last_density", *r6("vehicle_ratio", "pedestrian_ratio"), "updated_at_frame")


@register("node_scene", sql("SELECT sequence_id, 50.0::DOUBLE AS altitude_m, 'clear' AS weather, 'urban' AS scene_type, 'daytime' AS time_of_day, count(*) AS total_frames FROM frames GROUP BY sequence_id", "frames"))
def _(spark, sf):
    return graph.scene_nodes(states(spark, sf), CONFIG)


@register("a4_object_nodes", sql("""SELECT sequence_id, track_id, first_seen_frame, last_seen_frame, class, round(cx, 6) AS cx, round(cy, 6) AS cy, round(speed, 6) AS speed, round(heading, 6) AS heading,
  movement_pattern, 0 AS occlusion, 'active' AS status FROM objects""", "objects"))
def _(spark, sf):
    return graph.object_nodes(states(spark, sf)).select("sequence_id", "track_id", "first_seen_frame", "last_seen_frame", "class", *r6("cx", "cy", "speed", "heading"), "movement_pattern", "occlusion", "status")


@register("edge_in_zone", sql("SELECT sequence_id, track_id, zone_id, frame_id, 1 AS density_contribution FROM states", "states"))
def _(spark, sf):
    return graph.in_zone(states(spark, sf))


@register("edge_appeared_in", sql("SELECT sequence_id, track_id, frame_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(x1, 6) AS x1, round(y2, 6) AS y2 FROM states", "states"))
def _(spark, sf):
    return graph.appeared_in(states(spark, sf)).select("sequence_id", "track_id", "frame_id", *r6("cx", "cy", "x1", "y2"))


@register("edge_precedes", sql("SELECT sequence_id, previous AS from_frame, frame_id AS to_frame FROM frames WHERE previous IS NOT NULL", "frames"))
def _(spark, sf):
    return graph.precedes(motion.frames(states(spark, sf)))


@register("edge_near", sql("SELECT sequence_id, a AS a_track_id, b AS b_track_id, frame_id, round_even(d, 6) AS distance, both_moving FROM near_", "near_"))
def _(spark, sf):
    return graph.near(states(spark, sf), CONFIG)


@register("edge_near_any_zone", sql("""SELECT sequence_id, frame_id, a AS a_track_id, b AS b_track_id, round_even(d, 6) AS distance FROM (
  SELECT a.sequence_id, a.frame_id, a.track_id AS a, b.track_id AS b, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d
  FROM states a JOIN states b ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id AND a.track_id < b.track_id) WHERE d < 0.08""", "states"))
def _(spark, sf):
    return graph.near_pairs(states(spark, sf), CONFIG.merge({"graph": {"same_zone_only": False}})).drop("both_moving")


@register("edge_detected_in", sql("SELECT DISTINCT sequence_id, track_id FROM states", "states"))
def _(spark, sf):
    return graph.detected_in(states(spark, sf))


@register("edge_belongs_to_class", sql("SELECT DISTINCT sequence_id, track_id, name, class_group FROM states JOIN classes ON class_name = name", "states", "classes"))
def _(spark, sf):
    return graph.belongs_to_class(states(spark, sf), graph.class_nodes(spark))


@register("node_object_class", sql("SELECT * FROM classes", "classes"))
def _(spark, sf):
    return graph.class_nodes(spark)


# ------------------------------------------------------------------ events

_EV = "event_type, sequence_id, frame_id, primary_track_id, secondary_track_id, round(confidence, 6) AS confidence, zone_id, round(distance, 6) AS distance, round(heading_diff, 6) AS heading_diff, density, round(vehicle_ratio, 6) AS vehicle_ratio"


def _event(df: DataFrame) -> DataFrame:
    return df.select("event_type", "sequence_id", "frame_id", "primary_track_id", "secondary_track_id", *r6("confidence"), "zone_id", *r6("distance", "heading_diff"), "density", *r6("vehicle_ratio"))


def _kind(kind: str) -> str:
    return sql(f"SELECT {_EV} FROM events_ WHERE event_type = '{kind}'", "events_")


@register("e1_near_miss", _kind("NEAR_MISS"))
def _(spark, sf):
    return _event(E.near_miss(states(spark, sf), CONFIG))


@register("e2_loiter", _kind("LOITER"))
def _(spark, sf):
    return _event(E.loiter(states(spark, sf), CONFIG))


@register("e3_convoy", _kind("CONVOY"))
def _(spark, sf):
    s = states(spark, sf)
    return _event(E.convoy(s, motion.frames(s), CONFIG))


@register("e4_crowd_form", _kind("CROWD_FORM"))
def _(spark, sf):
    s = states(spark, sf)
    return _event(E.crowd_form(zones.frame_stats(s, CONFIG), motion.frames(s), CONFIG))


@register("e5_jaywalking", _kind("JAYWALKING"))
def _(spark, sf):
    s = states(spark, sf)
    return _event(E.jaywalking(s, zones.frame_stats(s, CONFIG), CONFIG))


@register("e6_all_events", sql(f"SELECT {_EV} FROM events_", "events_"))
def _(spark, sf):
    return _event(E.all_events(states(spark, sf), CONFIG))


@register("e7_event_nodes", sql("SELECT DISTINCT event_key, event_type, frame_id, sequence_id, round(confidence, 6) AS confidence, primary_track_id, secondary_track_id, zone_id FROM keyed", "keyed"))
def _(spark, sf):
    return tables(spark, sf)["node_event"].select("event_key", "event_type", "frame_id", "sequence_id", *r6("confidence"), "primary_track_id", "secondary_track_id", "zone_id")


@register("edge_involves", sql("""SELECT DISTINCT k.sequence_id, k.event_key, o.track_id, k.role FROM (
  SELECT sequence_id, event_key, primary_track_id AS t, 'primary' AS role FROM keyed UNION ALL SELECT sequence_id, event_key, secondary_track_id, 'secondary' FROM keyed) k
  JOIN objects o ON o.sequence_id = k.sequence_id AND o.track_id = k.t""", "keyed", "objects"))
def _(spark, sf):
    return tables(spark, sf)["edge_involves"]


@register("edge_occurred_in", sql("SELECT DISTINCT sequence_id, frame_id, event_key FROM keyed", "keyed"))
def _(spark, sf):
    return tables(spark, sf)["edge_occurred_in"]


@register("e8_near_miss_edge", sql("""SELECT DISTINCT ON (sequence_id, primary_track_id, secondary_track_id) sequence_id, primary_track_id AS a_track_id, secondary_track_id AS b_track_id, frame_id, round(distance, 6) AS distance
  FROM events_ WHERE event_type = 'NEAR_MISS' ORDER BY sequence_id, primary_track_id, secondary_track_id, frame_id DESC""", "events_"))
def _(spark, sf):
    return tables(spark, sf)["edge_near_miss"].select("sequence_id", "a_track_id", "b_track_id", "frame_id", *r6("distance"))


@register("e8_convoy_edge", sql("""SELECT sequence_id, a AS a_track_id, b AS b_track_id, frame_id, avg_distance FROM (
  SELECT DISTINCT ON (sequence_id, primary_track_id, secondary_track_id) sequence_id, primary_track_id AS p, secondary_track_id AS s, frame_id, round(distance, 6) AS avg_distance FROM events_ WHERE event_type = 'CONVOY'
  ORDER BY sequence_id, primary_track_id, secondary_track_id, frame_id DESC), LATERAL (SELECT p AS a, s AS b UNION ALL SELECT s, p)""", "events_"))
def _(spark, sf):
    return tables(spark, sf)["edge_convoy_with"].select("sequence_id", "a_track_id", "b_track_id", "frame_id", *r6("avg_distance"))


@register("e8_loitering_edge", sql("SELECT sequence_id, primary_track_id AS track_id, zone_id, max(frame_id) AS frame_id FROM events_ WHERE event_type = 'LOITER' GROUP BY ALL", "events_"))
def _(spark, sf):
    return tables(spark, sf)["edge_loitering_in"]


@register("e8_jaywalking_edge", sql("""SELECT DISTINCT ON (sequence_id, primary_track_id, zone_id) sequence_id, primary_track_id AS track_id, zone_id, frame_id, round(vehicle_ratio, 6) AS vehicle_ratio
  FROM events_ WHERE event_type = 'JAYWALKING' ORDER BY sequence_id, primary_track_id, zone_id, frame_id DESC""", "events_"))
def _(spark, sf):
    return tables(spark, sf)["edge_jaywalking_in"].select("sequence_id", "track_id", "zone_id", "frame_id", *r6("vehicle_ratio"))


# ------------------------------------------------------------------ re-identification


@register("a5_snapshots", sql("""SELECT sequence_id, track_id, f0 AS first_seen_frame, f1 AS last_seen_frame, class, round(fx, 6) AS first_cx, round(ly, 6) AS last_cy,
  round(h_in, 6) AS heading_at_entry, round(h_out, 6) AS heading_at_exit, CAST(n AS INTEGER) AS n_points FROM snaps2""", "snaps2"))
def _(spark, sf):
    return fragments(spark, sf).select("sequence_id", "track_id", "first_seen_frame", "last_seen_frame", "class", *r6("first_cx", "last_cy", "heading_at_entry", "heading_at_exit"), F.size("trajectory").alias("n_points"))


@register("r1_compare", sql("SELECT sequence_id, track_a, track_b, round(d, 6) AS distance, gap, round(hd, 6) AS heading_diff, spatial_ok, temporal_ok, heading_ok FROM compared", "compared"))
def _(spark, sf):
    return reid.compare(fragments(spark, sf), CONFIG).select("sequence_id", "track_a", "track_b", *r6("distance"), "gap", *r6("heading_diff"), "spatial_ok", "temporal_ok", "heading_ok")


def _scored(spark, sf):
    return reid.score(reid.compare(fragments(spark, sf), CONFIG), CONFIG)


@register("r2_score", sql("SELECT sequence_id, track_a, track_b, round(confidence, 6) AS confidence FROM cands", "cands"))
def _(spark, sf):
    return reid.candidates(_scored(spark, sf), CONFIG).select("sequence_id", "track_a", "track_b", *r6("confidence"))


def _accepted(spark, sf):
    return reid.accept(reid.candidates(_scored(spark, sf), CONFIG), CONFIG)


@register("r3_accept", sql("SELECT sequence_id, track_a, track_b, round(confidence, 6) AS confidence, 'spatial_temporal_reid' AS method, b_first AS resolved_at_frame FROM accepted", "accepted"))
def _(spark, sf):
    return reid.same_entity(_accepted(spark, sf)).select("sequence_id", "track_a", "track_b", *r6("confidence"), "method", "resolved_at_frame")


@register("r5_canonical", sql("""SELECT sequence_id, coalesce(a.t, b.t) AS track_id, coalesce(a.c, b.c) AS canonical_id FROM
  (SELECT sequence_id, track_a AS t, least(track_a, track_b) AS c FROM accepted) a FULL JOIN (SELECT sequence_id, track_b AS t, least(track_a, track_b) AS c FROM accepted) b USING (sequence_id, t)""", "accepted"))
def _(spark, sf):
    return reid.canonical(_accepted(spark, sf))


@register("r6_ambiguous", sql("SELECT sequence_id, track_a, track_b, round(confidence, 6) AS confidence FROM cands ANTI JOIN accepted USING (sequence_id, track_a, track_b)", "cands", "accepted"))
def _(spark, sf):
    return reid.ambiguous(reid.candidates(_scored(spark, sf), CONFIG), _accepted(spark, sf)).select("sequence_id", "track_a", "track_b", *r6("confidence"))


@register("r7_coexists", sql("""SELECT sequence_id, track_a, track_b, overlap_start, overlap_end, overlap_end - overlap_start + 1 AS overlap_frames, round(min(sqrt((ax - bx) * (ax - bx) + (ay - yb) * (ay - yb))), 6) AS min_distance_ever FROM (
  SELECT a.sequence_id, a.track_id AS track_a, b.track_id AS track_b, greatest(a.f0, b.f0) AS overlap_start, least(a.f1, b.f1) AS overlap_end,
    unnest(a.xs[1:least(a.n, b.n)]) AS ax, unnest(a.ys[1:least(a.n, b.n)]) AS ay, unnest(b.xs[1:least(a.n, b.n)]) AS bx, unnest(b.ys[1:least(a.n, b.n)]) AS yb
  FROM snaps a JOIN snaps b ON a.sequence_id = b.sequence_id AND (a.f0 < b.f0 OR (a.f0 = b.f0 AND a.track_id < b.track_id)) AND b.f0 <= a.f1) GROUP BY ALL""", "snaps"))
def _(spark, sf):
    return reid.coexists(fragments(spark, sf), CONFIG).select("sequence_id", "track_a", "track_b", "overlap_start", "overlap_end", "overlap_frames", *r6("min_distance_ever"))


# ------------------------------------------------------------------ traversals


@register("q1_trajectory", sql("SELECT frame_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM states WHERE sequence_id = 'seq_0' AND track_id = 7", "states"))
def _(spark, sf):
    return Q.trajectory(tables(spark, sf), "seq_0", 7).select("frame_id", *r6("cx", "cy"))


@register("q2_events_of_object", sql("""SELECT DISTINCT k.sequence_id, o.track_id, k.role, k.event_type, k.frame_id FROM (
  SELECT *, primary_track_id AS t, 'primary' AS role FROM keyed UNION ALL SELECT *, secondary_track_id, 'secondary' FROM keyed) k JOIN objects o ON o.sequence_id = k.sequence_id AND o.track_id = k.t""", "keyed", "objects"))
def _(spark, sf):
    return Q.events_of(tables(spark, sf), None).drop("metadata_json").distinct()


@register("q3_zone_density", sql("SELECT sequence_id, zone_id, count(*) AS density FROM states WHERE frame_id = 10 GROUP BY ALL", "states"))
def _(spark, sf):
    return Q.zone_density(tables(spark, sf), 10)


@register("q4_near_misses_in_condition", sql("""SELECT DISTINCT ON (sequence_id, primary_track_id, secondary_track_id) sequence_id, primary_track_id AS a_track_id, secondary_track_id AS b_track_id, frame_id, round(distance, 6) AS distance,
  CASE WHEN distance < 0.03 THEN 'critical' ELSE 'warning' END AS severity FROM events_ WHERE event_type = 'NEAR_MISS' ORDER BY sequence_id, primary_track_id, secondary_track_id, frame_id DESC""", "events_"))
def _(spark, sf):
    return Q.near_misses_in(tables(spark, sf), weather="clear").select("sequence_id", "a_track_id", "b_track_id", "frame_id", *r6("distance"), "severity")


@register("q5_cross_zone", sql("""SELECT a.sequence_id, a.track_id, left_from, arrived_at, o.class FROM (SELECT sequence_id, track_id, min(frame_id) AS left_from FROM states WHERE zone_id = 'cell_1_0' GROUP BY ALL) a
  JOIN (SELECT sequence_id, track_id, min(frame_id) AS arrived_at FROM states WHERE zone_id = 'cell_1_1' GROUP BY ALL) b USING (sequence_id, track_id) JOIN objects o USING (sequence_id, track_id) WHERE left_from < arrived_at""", "states", "objects"))
def _(spark, sf):
    return Q.moved_between(tables(spark, sf), "cell_1_0", "cell_1_1")


@register("q6_group_proximity", sql("""SELECT n.sequence_id, x, y, round_even(d, 6) AS distance, ca.name AS x_class, cb.name AS y_class FROM (SELECT sequence_id, a AS x, b AS y, d FROM near_ UNION ALL SELECT sequence_id, b, a, d FROM near_) n
  JOIN (SELECT DISTINCT sequence_id, track_id, name, class_group FROM states JOIN classes ON class_name = name) ca ON ca.sequence_id = n.sequence_id AND ca.track_id = x AND ca.class_group = 'VulnerableRoadUser'
  JOIN (SELECT DISTINCT sequence_id, track_id, name, class_group FROM states JOIN classes ON class_name = name) cb ON cb.sequence_id = n.sequence_id AND cb.track_id = y AND cb.class_group = 'MotorVehicle'""", "near_", "classes"))
def _(spark, sf):
    return Q.group_proximity(tables(spark, sf))


@register("q7_convoys", sql("""SELECT e.sequence_id, a_track_id, b_track_id, duration_frames, avg_distance FROM (SELECT DISTINCT ON (sequence_id, primary_track_id, secondary_track_id) sequence_id, primary_track_id AS a_track_id, secondary_track_id AS b_track_id,
  round(distance, 6) AS avg_distance FROM events_ WHERE event_type = 'CONVOY' ORDER BY sequence_id, primary_track_id, secondary_track_id, frame_id DESC) e
  JOIN (SELECT sequence_id, a, b, max(run) AS duration_frames FROM convoy_runs GROUP BY ALL) r ON r.sequence_id = e.sequence_id AND r.a = a_track_id AND r.b = b_track_id""", "events_", "convoy_runs"))
def _(spark, sf):
    s = states(spark, sf)
    runs = E.convoy_runs(s, motion.frames(s), CONFIG).groupBy("sequence_id", "a_track_id", "b_track_id").agg(F.max("run").cast("long").alias("duration_frames"))
    return Q.convoys(graph.build(s, CONFIG), runs).select("sequence_id", "a_track_id", "b_track_id", "duration_frames", *r6("avg_distance"))


@register("q8_lifespan", sql("""SELECT p.track_id, p.frame_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM parts p SEMI JOIN (
  WITH e AS (SELECT track_a AS x, track_b AS y FROM accepted WHERE sequence_id = 'seq_0' UNION ALL SELECT track_b, track_a FROM accepted WHERE sequence_id = 'seq_0')
  SELECT 20 AS t UNION SELECT y FROM e WHERE x = 20 UNION SELECT b.y FROM e a JOIN e b ON a.y = b.x WHERE a.x = 20 UNION SELECT c.y FROM e a JOIN e b ON a.y = b.x JOIN e c ON b.y = c.x WHERE a.x = 20) r ON r.t = p.track_id
  WHERE p.sequence_id = 'seq_0'""", "parts", "accepted"))
def _(spark, sf):
    s = states(spark, sf).withColumn("track_id", F.expr("track_id * 10 + frame_id div 20"))
    return Q.lifespan(reid.same_entity(_accepted(spark, sf)), graph.appeared_in(s), "seq_0", 20).select("track_id", "frame_id", *r6("cx", "cy"))


@register("q9_loiter_hotspots", sql("""SELECT zone_id, count(*) AS loiter_events, round(avg(d), 6) AS avg_duration FROM (SELECT DISTINCT sequence_id, primary_track_id AS track_id, zone_id FROM events_ WHERE event_type = 'LOITER')
  LEFT JOIN (SELECT sequence_id, track_id, zone_id, max(run) AS d FROM loiter_runs WHERE ok GROUP BY ALL) USING (sequence_id, track_id, zone_id) GROUP BY zone_id ORDER BY loiter_events DESC, zone_id LIMIT 10""", "events_", "loiter_runs"))
def _(spark, sf):
    s = states(spark, sf)
    runs = E.loiter_runs(s, CONFIG).groupBy("sequence_id", "track_id", "zone_id").agg(F.max("run").alias("duration_frames"))
    return Q.loitering_hotspots(graph.build(s, CONFIG), runs).select("zone_id", "loiter_events", *r6("avg_duration"))


@register("q10_crowd_then_loiter", sql("""SELECT sequence_id, max(c.frame_id) AS crowd_frame, l.frame_id AS loiter_frame, l.frame_id - max(c.frame_id) AS frames_between
  FROM (SELECT DISTINCT sequence_id, frame_id FROM events_ WHERE event_type = 'LOITER') l JOIN events_ c USING (sequence_id)
  WHERE c.event_type = 'CROWD_FORM' AND c.frame_id < l.frame_id AND c.frame_id >= l.frame_id - 30 GROUP BY sequence_id, l.frame_id""", "events_"))
def _(spark, sf):
    return Q.crowd_then_loiter(tables(spark, sf))


@register("q12_persons_by_zone", sql("""SELECT s.sequence_id, s.zone_id, count(*) AS person_count, count(DISTINCT s.track_id) AS distinct_persons FROM states s JOIN objects o USING (sequence_id, track_id)
  WHERE o.class IN ('person','pedestrian','people') GROUP BY ALL""", "states", "objects"))
def _(spark, sf):
    return Q.persons_by_zone(tables(spark, sf))


@register("q13_stationary_vehicles", sql("""SELECT sequence_id, track_id, class_name, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS n_frames FROM (
  SELECT *, sum(CASE WHEN movement_pattern = 'stationary' THEN 0 ELSE 1 END) OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) AS island FROM states WHERE event_role = 'vehicle') WHERE movement_pattern = 'stationary'
  GROUP BY sequence_id, track_id, class_name, island HAVING count(*) > 10""", "states"))
def _(spark, sf):
    return motion.stationary_runs(states(spark, sf).where("event_role = 'vehicle'"), 10)


@register("q15_class_inventory", sql("SELECT DISTINCT class FROM objects", "objects"))
def _(spark, sf):
    return Q.class_inventory(tables(spark, sf))


@register("q16_class_counts", sql("SELECT sequence_id, class, count(*) AS n FROM objects GROUP BY ALL", "objects"))
def _(spark, sf):
    return Q.class_counts(tables(spark, sf))


@register("s14_frame_boxes", sql("SELECT track_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM states WHERE sequence_id = 'seq_0' AND frame_id = 5", "states"))
def _(spark, sf):
    return Q.frame_boxes(tables(spark, sf), "seq_0", 5).select("track_id", *r6("x1", "y1", "x2", "y2"))


@register("s15_track_frames", sql("SELECT DISTINCT frame_id FROM states WHERE sequence_id = 'seq_0' AND track_id = 3 ORDER BY frame_id LIMIT 5", "states"))
def _(spark, sf):
    return Q.track_frames(tables(spark, sf), "seq_0", 3)


@register("j16_identity_paths", sql("""SELECT a, b, min(hops) AS hops FROM (WITH RECURSIVE e AS (SELECT track_a AS x, track_b AS y FROM accepted UNION SELECT track_b, track_a FROM accepted),
  p AS (SELECT x AS a, y AS b, 1 AS hops FROM e UNION SELECT p.a, e.y, hops + 1 FROM p JOIN e ON p.b = e.x WHERE hops < 3) SELECT * FROM p) GROUP BY ALL""", "accepted"))
def _(spark, sf):
    return Q.paths(_accepted(spark, sf).select("track_a", "track_b"), "track_a", "track_b", 1, 3)


@register("a15_digest", sql("""SELECT 'speed' AS column_name, count(*) AS n_rows, round(min(speed), 4) AS min_value, round(max(speed), 4) AS max_value, round(avg(speed), 4) AS avg_value FROM states
  UNION ALL SELECT 'frame_id', count(*), min(frame_id), max(frame_id), round(avg(frame_id), 4) FROM states""", "states"))
def _(spark, sf):
    return digest.numeric(states(spark, sf).select("speed", "frame_id"))


# ------------------------------------------------------------------ messages


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    extra = F.when(F.col("conv_id") % 4 == 0, " Truck near the car").when(F.col("conv_id") % 4 == 1, " PEDESTRIAN ahead").otherwise("")
    return c.select(
        F.concat_ws(":", "conv_id", "turn").alias("message_id"), F.concat(F.lit("seq_"), (F.col("conv_id") % 3).cast("string")).alias("sequence_id"),
        F.col("role").alias("sender"), F.concat(F.coalesce("text", F.lit("")), extra).alias("text"), F.col("turn").alias("timestamp"),
    )


@register("x1_entities", sql("SELECT message_id, sequence_id, entity FROM found", "found"))
def _(spark, sf):
    return M.entities(messages(spark, sf))


@register("x2_messages", sql("SELECT message_id, sequence_id, sender, text, timestamp FROM messages", "messages"))
def _(spark, sf):
    return M.normalise(messages(spark, sf))


@register("x3_mentions", sql("SELECT DISTINCT f.sequence_id, message_id, track_id FROM found f JOIN objects o ON o.sequence_id = f.sequence_id AND lower(o.class) = entity", "found", "objects"))
def _(spark, sf):
    return M.mentions(M.entities(messages(spark, sf)), graph.object_nodes(states(spark, sf)))


@register("q11_messages_by_sender", sql("SELECT message_id, text FROM messages WHERE sender = 'user'", "messages"))
def _(spark, sf):
    return Q.messages_by(M.normalise(messages(spark, sf)), "user")


@register("q17_messages_by_sequence", sql("SELECT message_id, sender FROM messages WHERE sequence_id = 'seq_1'", "messages"))
def _(spark, sf):
    return M.normalise(messages(spark, sf)).where("sequence_id = 'seq_1'").select("message_id", "sender")


# ------------------------------------------------------------------ evaluation


def truth_and_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth boxes of the states; predictions are those boxes shifted by integer steps of the frame and track, some missing."""
    s = states(spark, sf_dir).withColumn("pos", F.col("track_id"))
    k = (F.col("track_id") * 7 + F.col("frame_id") * 3) % 5
    p = s.where((F.col("track_id") + F.col("frame_id")) % 11 != 0)
    p = p.withColumns({"x1": F.col("x1") + k / 400, "x2": F.col("x2") + k / 400, "confidence": ((F.col("track_id") * 13 + F.col("frame_id") * 29) % 101) / 100})
    return s, p


def _boxes(df: DataFrame, *more: str) -> DataFrame:
    ids = {"car": 1, "truck": 2, "people": 3}
    cls = F.coalesce(*[F.when(F.col("class_name") == n, F.lit(i)) for n, i in ids.items()], F.lit(0)).alias("class_id")
    return df.select(F.concat_ws(":", "sequence_id", "frame_id").alias("image_id"), cls, "pos", "x1", "y1", "x2", "y2", *more)


@register("a9_ap")
def _(spark, sf):
    t, p = truth_and_predictions(spark, sf)
    return V.average_precision(_boxes(p, "confidence"), _boxes(t)).select("class_id", "threshold", *r6("ap"))


@register("a10_map")
def _(spark, sf):
    t, p = truth_and_predictions(spark, sf)
    return V.mean_average_precision(V.average_precision(_boxes(p, "confidence"), _boxes(t))).select(*r6("map_50", "map_50_95"))


@register("a11_mota")
def _(spark, sf):
    t, p = truth_and_predictions(spark, sf)
    return V.tracking_metrics(p, t).select("matches", "misses", "false_positives", "id_switches", *r6("mota", "motp", "switch_rate"))


def _event_truth(spark, sf):
    ev = E.all_events(states(spark, sf), CONFIG).where("event_type in ('NEAR_MISS', 'JAYWALKING')")
    pos = F.row_number().over(W.partitionBy("event_type", "sequence_id", "primary_track_id", "secondary_track_id").orderBy("frame_id")).cast("long")
    ev = ev.withColumn("pos", pos)
    return ev.withColumn("frame_id", F.col("frame_id") + F.when(F.col("primary_track_id") % 3 == 0, 2).otherwise(0)), ev


@register("a12_event_prf")
def _(spark, sf):
    p, t = _event_truth(spark, sf)
    return V.event_metrics(p, t, 1).select("tp", "fp", "fn", *r6("precision", "recall", "f1"))


@register("a12_prf_from_counts", """SELECT l_returnflag, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (
  SELECT l_returnflag, count(*) FILTER (WHERE l_quantity < 10) AS tp, count(*) FILTER (WHERE l_quantity >= 10 AND l_quantity < 20) AS fp, count(*) FILTER (WHERE l_quantity >= 40) AS fn FROM lineitem GROUP BY ALL))""")
def _(spark, sf):
    q = F.col("l_quantity")
    c = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").agg(F.count_if(q < 10).alias("tp"), F.count_if((q >= 10) & (q < 20)).alias("fp"), F.count_if(q >= 40).alias("fn"))
    return V.prf(c).select("l_returnflag", "tp", "fp", "fn", *r6("precision", "recall", "f1"))


@register("a13_query_eval", """SELECT round(avg((conv_id % 2)::DOUBLE), 6) AS first_attempt_validity, round(avg(CASE WHEN turn % 5 > 0 THEN 1.0 ELSE 0 END), 6) AS final_validity,
  round(avg(CASE WHEN turn % 3 > 0 THEN 1.0 ELSE 0 END), 6) AS semantic_correctness, round(avg(CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0 END), 6) AS retry_rate, count(*) AS cases FROM conversations""")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    cases = c.select((F.col("conv_id") % 2 == 1).alias("first_valid"), (F.col("turn") % 5 > 0).alias("final_valid"), (F.col("turn") % 3 > 0).alias("results_equal"), (F.col("turn") % 2 == 0).alias("retried"))
    return V.query_metrics(cases).select(*r6("first_attempt_validity", "final_validity", "semantic_correctness", "retry_rate"), "cases")


# ------------------------------------------------------------------ tracker, streaming, documented-only operators


@register("t6_track")
def _(spark, sf):
    t = tracks(spark, sf).select("sequence_id", "frame_id", F.col("track_id").alias("pos"), "class_name", "x1", "y1", "x2", "y2", F.lit(0.9).alias("confidence"))
    return tracking.track(t, CONFIG)


@register("stream_zone_stats", sql(f"SELECT {_Z} FROM zstats", "zstats"))
def _(spark, sf):
    return stream.replay_zone_stats(states(spark, sf), CONFIG).select(*_zcols())


@register("stream_loiter", _kind("LOITER"))
def _(spark, sf):
    return _event(stream.replay_loiter(states(spark, sf), CONFIG))


@register("stream_upserts", sql("SELECT sequence_id, a AS a_track_id, b AS b_track_id, frame_id, round_even(d, 6) AS distance, both_moving FROM near_", "near_"))
def _(spark, sf):
    return stream.replay_upserts(states(spark, sf), CONFIG)


@register("z4_track_gaps", sql("""SELECT sequence_id, track_id, frame_id, gap FROM (SELECT sequence_id, track_id, frame_id, frame_id - lag(frame_id) OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) AS gap FROM states) WHERE gap > 3""", "states"))
def _(spark, sf):
    return L.track_gaps(states(spark, sf), 3)


@register("z7_approaching", sql("""SELECT sequence_id, frame_id, a, b, round(d, 6) AS distance FROM (
  SELECT *, lag(d) OVER (PARTITION BY sequence_id, a, b ORDER BY frame_id) AS before FROM (
  SELECT a.sequence_id, a.frame_id, a.track_id AS a, b.track_id AS b, a.speed, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d,
    least(abs(a.heading_deg - bearing) % 360, 360 - abs(a.heading_deg - bearing) % 360) AS off FROM (
    SELECT * FROM states) a JOIN states b ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id AND a.zone_id = b.zone_id AND a.track_id <> b.track_id,
    LATERAL (SELECT CASE WHEN b.cx - a.cx = 0 AND b.cy - a.cy = 0 THEN 0.0 ELSE (degrees(atan2(b.cy - a.cy, b.cx - a.cx)) + 360) % 360 END AS bearing))) WHERE speed > 0.001 AND round(off, 9) < 45 AND round(d, 9) < round(before, 9)""", "states"))
def _(spark, sf):
    return L.approaching(states(spark, sf)).select("sequence_id", "frame_id", "a", "b", *r6("distance"))


@register("z10_lifecycle", sql("""SELECT sequence_id, a, b, min(frame_id) AS valid_from, max(frame_id) AS valid_to, count(*) AS n_frames, max(frame_id) + 2 >= e AS is_active FROM (
  SELECT *, sum(CASE WHEN frame_id - p <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY sequence_id, a, b ORDER BY frame_id) AS isle FROM (
  SELECT *, lag(frame_id) OVER (PARTITION BY sequence_id, a, b ORDER BY frame_id) AS p FROM (SELECT DISTINCT sequence_id, a, b, frame_id FROM hits)))
  JOIN (SELECT sequence_id, max(frame_id) AS e FROM states GROUP BY ALL) USING (sequence_id) GROUP BY sequence_id, a, b, isle, e HAVING count(*) >= 2""", "hits", "states"))
def _(spark, sf):
    s = states(spark, sf)
    hits = E.near_miss_hits(s, CONFIG).select("sequence_id", F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), "frame_id")
    return L.lifecycle(hits, ["sequence_id", "a", "b"], motion.frames(s), min_frames=2, grace=2)


@register("z12_violations", sql("""SELECT 'centroid_range' AS rule, count(*) AS n FROM states WHERE cx < 0 OR cx > 1 OR cy < 0 OR cy > 1 UNION ALL SELECT 'negative_speed', count(*) FROM states WHERE speed < 0
  UNION ALL SELECT 'heading_range', count(*) FROM states WHERE heading_deg < 0 OR heading_deg >= 360 UNION ALL SELECT 'fast', count(*) FROM states WHERE speed > 0.5
  UNION ALL SELECT 'duplicate_state', count(*) FROM (SELECT 1 FROM states GROUP BY sequence_id, track_id, frame_id HAVING count(*) > 1)""", "states"))
def _(spark, sf):
    return L.violations(states(spark, sf))


@register("z13_severity", sql("""SELECT CASE WHEN distance < 0.03 THEN 'critical' ELSE 'warning' END AS severity, count(*) AS n FROM events_ WHERE event_type = 'NEAR_MISS' GROUP BY ALL""", "events_"))
def _(spark, sf):
    return E.near_miss(states(spark, sf), CONFIG).groupBy(Q.severity(F.col("distance")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@register("z8_following", sql("""SELECT sequence_id, a, b, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS n_frames FROM (
  SELECT p.*, f.ordinal - row_number() OVER (PARTITION BY p.sequence_id, a, b ORDER BY f.ordinal) AS isle FROM (
    SELECT a.sequence_id, a.frame_id, a.track_id AS a, b.track_id AS b, a.heading_deg AS ha, b.heading_deg AS hb, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d,
      CASE WHEN b.cx - a.cx = 0 AND b.cy - a.cy = 0 THEN 0.0 ELSE (degrees(atan2(b.cy - a.cy, b.cx - a.cx)) + 360) % 360 END AS bearing
    FROM states a JOIN states b ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id AND a.zone_id = b.zone_id AND a.track_id <> b.track_id AND a.event_role = 'vehicle' AND b.event_role = 'vehicle') p
  JOIN frames f ON f.sequence_id = p.sequence_id AND f.frame_id = p.frame_id
  WHERE d <= 0.12 AND least(abs(ha - hb) % 360, 360 - abs(ha - hb) % 360) < 30 AND least(abs(ha - bearing) % 360, 360 - abs(ha - bearing) % 360) < 30) GROUP BY sequence_id, a, b, isle HAVING count(*) >= 2""", "states", "frames"))
def _(spark, sf):
    s = states(spark, sf)
    return L.following(s, motion.frames(s), at_least=2).drop("avg_trail_distance")


@register("z9_crowd_members", sql("""SELECT DISTINCT k.sequence_id, k.event_key, s.track_id FROM keyed k JOIN states s ON s.sequence_id = k.sequence_id AND s.frame_id = k.frame_id AND s.zone_id = k.zone_id
  WHERE k.event_type = 'CROWD_FORM' AND s.event_role = 'pedestrian'""", "keyed", "states"))
def _(spark, sf):
    s = states(spark, sf)
    return L.crowd_members(E.all_events(s, CONFIG), s)


@register("z9_triggered_by", sql("""SELECT l.sequence_id, l.zone_id, max(c.frame_id) AS cause_frame, l.frame_id AS effect_frame, l.primary_track_id FROM events_ l JOIN events_ c
  ON c.sequence_id = l.sequence_id AND c.zone_id = l.zone_id AND c.event_type = 'CROWD_FORM' AND c.frame_id < l.frame_id AND c.frame_id >= l.frame_id - 30
  WHERE l.event_type = 'LOITER' GROUP BY l.sequence_id, l.zone_id, l.frame_id, l.primary_track_id""", "events_"))
def _(spark, sf):
    return L.triggered_by(E.all_events(states(spark, sf), CONFIG), "CROWD_FORM", "LOITER", 30)


@register("z6_scene_profile", sql("""SELECT sequence_id, round(count(*) FILTER (WHERE event_role = 'vehicle') / count(DISTINCT frame_id), 6) AS vehicles, round(count(*) FILTER (WHERE event_role = 'pedestrian') / count(DISTINCT frame_id), 6) AS pedestrians,
  round(1500 * 1.7::DOUBLE / median(CASE WHEN event_role = 'pedestrian' THEN y2 - y1 END), 4) AS altitude_estimate FROM states WHERE frame_id < 30 GROUP BY sequence_id""", "states"))
def _(spark, sf):
    return L.scene_profile(states(spark, sf)).select("sequence_id", *r6("vehicles", "pedestrians"), F.round("altitude_estimate", 4).alias("altitude_estimate"))


@register("x4_clip_frames", sql("SELECT event_key, round(greatest(0, frame_id / 30 - 1.5::DOUBLE), 6) AS clip_start, unnest(range(greatest(0, frame_id - 2), frame_id + 3)) AS frame FROM keyed WHERE event_type = 'NEAR_MISS'", "keyed"))
def _(spark, sf):
    ev = E.keyed(E.near_miss(states(spark, sf), CONFIG))
    return ev.select("event_key", F.round(G.clip_start(F.col("frame_id")), 6).alias("clip_start"), F.explode(G.clip_frames(F.col("frame_id").cast("long"), 2)).alias("frame"))


@register("a14_same_rows", sql("SELECT true AS equal", "tracks"))
def _(spark, sf):
    s = states(spark, sf).select("sequence_id", "track_id", "frame_id")
    return spark.range(1).select(F.lit(V.same_rows(s, s.repartition(3))).alias("equal"))


@register("t5_center_boxes", sql("SELECT sequence_id, track_id, frame_id, round((x1 + x2) / 2, 6) AS xc, round((y1 + y2) / 2, 6) AS yc, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h FROM states", "states"))
def _(spark, sf):
    s = states(spark, sf)
    out = s.select("sequence_id", "track_id", "frame_id", *G.xyxy_to_xywh(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))
    return out.select("sequence_id", "track_id", "frame_id", *r6("xc", "yc", "w", "h"))
