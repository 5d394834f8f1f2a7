"""Objects that stand apart keep their track unless they are gone for long; walks over graphs with cycles; lifecycles of conditions; the audit of all tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E, graph, lifecycle as L, motion, tracking
from ..sources.adapter import CONFIG, tracks
from .oracles import CTES, sql
from . import traversals as Q
from .registry import ORACLES, register, states, tables
from .registry_documented import ISLES


@register("t6_steady_tracks", sql("""
SELECT sequence_id, frame_id, pos, min(frame_id) OVER (PARTITION BY sequence_id, pos, run) AS first_frame, CAST(1 AS BIGINT) AS sources FROM (
  SELECT *, sum(CASE WHEN frame_id - before > 31 THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id, pos ORDER BY frame_id) AS run FROM (
    SELECT sequence_id, frame_id, track_id AS pos, lag(frame_id) OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) AS before
    FROM tracks WHERE track_id % 50 % 2 = 0))""", "tracks"))
def _(spark, sf):
    t = tracks(spark, sf).where("track_id % 50 % 2 = 0")
    t = t.select("sequence_id", "frame_id", F.col("track_id").alias("pos"), "class_name", "x1", "y1", "x2", "y2", F.lit(0.9).alias("confidence"))
    found = tracking.active(tracking.track(t, CONFIG))
    own = found.groupBy("sequence_id", "track_id").agg(F.min("frame_id").alias("first_frame"), F.countDistinct("pos").alias("sources"))
    return found.join(own, ["sequence_id", "track_id"]).select("sequence_id", "frame_id", "pos", "first_frame", "sources")


_BOTH = "e AS (SELECT a AS x, b AS y FROM near_ UNION SELECT b, a FROM near_)"
_WALKS = "SELECT a, b, CAST(min(hops) AS INTEGER) AS hops FROM (WITH RECURSIVE {e}, p AS ({start} UNION SELECT p.a, e.y, hops + 1 FROM p JOIN e ON p.b = e.x WHERE hops < {high}) SELECT * FROM p) WHERE hops >= {low} GROUP BY ALL"


def _near(spark, sf):
    return graph.near(states(spark, sf), CONFIG)


for _low, _high in ((0, 2), (1, 10), (2, 4)):
    _start = "SELECT x AS a, x AS b, 0 AS hops FROM e"

    def _walk(spark, sf, low=_low, high=_high):
        return Q.paths(_near(spark, sf), "a_track_id", "b_track_id", low, high)

    register(f"j16_paths_{_low}_{_high}", sql(_WALKS.format(e=_BOTH, start=_start, low=_low, high=_high), "near_"))(_walk)


@register("j16_paths_unbounded", sql(f"SELECT a, b FROM (WITH RECURSIVE {_BOTH}, p AS (SELECT x AS a, y AS b FROM e UNION SELECT p.a, e.y FROM p JOIN e ON p.b = e.x) SELECT * FROM p)", "near_"))
def _(spark, sf):
    return Q.paths(_near(spark, sf), "a_track_id", "b_track_id", 1, None).select("a", "b")


#: Frames until a condition is active and frames of grace, to suit 60 frames.
SHORT = {"IN_ZONE": (1, 5), "CONVOY_WITH": (3, 4), "FOLLOWING": (2, 3), "APPROACHING": (2, 2)}
_BEHIND = """SELECT sequence_id, frame_id, a, b FROM (
  SELECT a.sequence_id, a.frame_id, a.track_id AS a, b.track_id AS b, a.heading_deg AS ha, b.heading_deg AS hb, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d,
    CASE WHEN b.cx - a.cx = 0 AND b.cy - a.cy = 0 THEN 0.0 ELSE (degrees(atan2(b.cy - a.cy, b.cx - a.cx)) + 360) % 360 END AS bearing
  FROM states a JOIN states b ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id AND a.zone_id = b.zone_id AND a.track_id <> b.track_id AND a.event_role = 'vehicle' AND b.event_role = 'vehicle')
  WHERE d <= 0.12 AND least(abs(ha - hb) % 360, 360 - abs(ha - hb) % 360) < 30 AND least(abs(ha - bearing) % 360, 360 - abs(ha - bearing) % 360) < 30"""
CTES["zone_hits"] = ("SELECT sequence_id, track_id, zone_id, frame_id FROM states", ("states",))
CTES["behind_hits"] = (_BEHIND, ("states",))
# the oracle of z7_approaching without its common tables
CTES["closing_hits"] = ("""SELECT sequence_id, frame_id, a, b FROM (
  SELECT *, lag(d) OVER (PARTITION BY sequence_id, a, b ORDER BY frame_id) AS before FROM (
  SELECT a.sequence_id, a.frame_id, a.track_id AS a, b.track_id AS b, a.speed, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d,
    least(abs(a.heading_deg - bearing) % 360, 360 - abs(a.heading_deg - bearing) % 360) AS off FROM states a
    JOIN states b ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id AND a.zone_id = b.zone_id AND a.track_id <> b.track_id,
    LATERAL (SELECT CASE WHEN b.cx - a.cx = 0 AND b.cy - a.cy = 0 THEN 0.0 ELSE (degrees(atan2(b.cy - a.cy, b.cx - a.cx)) + 360) % 360 END AS bearing)))
  WHERE speed > 0.001 AND round(off, 9) < 45 AND round(d, 9) < round(before, 9)""", ("states",))
_PAIR = ["sequence_id", "a", "b"]
_HITS = {
    "IN_ZONE": ("zone_hits", ["sequence_id", "track_id", "zone_id"], lambda s: s),
    "CONVOY_WITH": ("convoy_pairs", _PAIR, lambda s: E.convoy_pairs(s, CONFIG).withColumnsRenamed({"a_track_id": "a", "b_track_id": "b"})),
    "FOLLOWING": ("behind_hits", _PAIR, L.following_hits),
    "APPROACHING": ("closing_hits", _PAIR, L.approaching),
}
for _kind, (_table, _keys, _make) in _HITS.items():
    _least, _grace = SHORT[_kind]
    CTES[f"isles_{_table}"] = (ISLES.format(keys=", ".join(_keys[1:]), hits=_table, least=_least, grace=_grace), (_table, "frames"))

    def _states_of(spark, sf, kind=_kind, keys=_keys, make=_make):
        s = states(spark, sf)
        return L.condition_states(make(s).select(*keys, "frame_id"), keys, motion.frames(s), kind, SHORT)

    register(f"z10_{_kind.lower()}_states", sql(f"SELECT '{_kind}' AS kind, * FROM isles_{_table}", f"isles_{_table}"))(_states_of)


#: Each table of the graph with the oracle of its rows.
_ROWS = {
    "node_scene": "node_scene", "node_object": "a4_object_nodes", "node_zone": "a3_zone_nodes", "node_event": "e7_event_nodes", "node_object_class": "node_object_class",
    "edge_near_miss": "e8_near_miss_edge", "edge_convoy_with": "e8_convoy_edge", "edge_loitering_in": "e8_loitering_edge", "edge_jaywalking_in": "e8_jaywalking_edge",
    **{n: n for n in ("edge_in_zone", "edge_appeared_in", "edge_detected_in", "edge_belongs_to_class", "edge_precedes", "edge_near", "edge_occurred_in", "edge_involves")},
}
_AUDIT = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM ({ORACLES[q]})" for t, q in _ROWS.items())
_AUDIT += " UNION ALL SELECT * FROM (" + sql("SELECT 'node_frame' AS table_name, count(*) AS n FROM frames", "frames") + ")"
_AUDIT += " UNION ALL SELECT * FROM (" + sql("SELECT 'node_event:' || event_type AS table_name, count(*) AS n FROM (SELECT DISTINCT event_type, event_key, zone_id FROM keyed) GROUP BY event_type", "keyed") + ")"


@register("q14_audit", _AUDIT)
def _(spark, sf):
    """Row counts of all eighteen tables, and of each kind of event."""
    g = tables(spark, sf)
    kinds = g["node_event"].groupBy(F.concat(F.lit("node_event:"), "event_type").alias("table_name")).agg(F.count(F.lit(1)).alias("n"))
    return Q.audit(g).unionByName(kinds)
