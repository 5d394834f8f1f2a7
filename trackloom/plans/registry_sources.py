"""Queries and oracles of sources, detections, scalar rules, answers and writers."""

from __future__ import annotations

import struct
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G, text as T
from ..operators import events as E, evaluation as V, graph, messages as M, motion, reid, tracking
from ..sources import sequences as S, sinks
from ..sources.adapter import CONFIG
from ..sources.shared import folder
from ..streaming import events as stream
from . import digest, traversals as Q
from .oracles import CTES, sql
from .registry import fragments, messages, r6, register, states, tables


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ frames and their metadata


def frame_files(spark: SparkSession, sf: str) -> DataFrame:
    """Paths as a frame folder would hold them, one for each processed frame."""
    f = motion.frames(states(spark, sf))
    name = F.lpad((F.col("frame_id") + 1).cast("string"), 7, "0")
    return f.select("sequence_id", F.concat(F.lit("/data/"), "sequence_id", F.lit("/img1/"), name, F.lit(".jpg")).alias("path"))




@register("s3_frame_skip", sql("SELECT sequence_id, frame_id FROM frames WHERE (ordinal - 1) % 3 = 0", "frames"))
def _(spark, sf):
    return S.numbered(frame_files(spark, sf), 3).select("sequence_id", "frame_id")


@register("s4_frame_ids", sql("SELECT sequence_id, frame_id FROM frames", "frames"))
def _(spark, sf):
    return S.numbered(frame_files(spark, sf)).select("sequence_id", "frame_id")


@register("s5_video_frames", sql("""
SELECT 'cam' || (sequence_id[5:]) AS sequence_id, frame_id, CASE WHEN frame_id % 2 = 0 THEN 25 ELSE 30 END AS frame_rate, 3 AS frame_skip FROM frames WHERE frame_id % 3 = 0""", "frames"))
def _(spark, sf):
    f = motion.frames(states(spark, sf))
    path = F.concat(F.lit("/video/cam"), F.substring_index("sequence_id", "_", -1), F.lit(".mp4"))
    index = f.select(path.alias("path"), F.col("frame_id").alias("frame_idx"), F.when(F.col("frame_id") % 2 == 0, 25.0).otherwise(0.0).alias("fps"))
    return S.video_frames(index, 3).select("sequence_id", "frame_id", "frame_rate", "frame_skip")


@register("s6_seqinfo", sql("SELECT sequence_id, count(*) AS total_frames, 25 AS frame_rate, 1360 AS frame_width, 765 AS frame_height FROM frames GROUP BY sequence_id", "frames"))
def _(spark, sf):
    n = motion.frames(states(spark, sf)).groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("[Other]\nseqLength=7\n[Sequence]\nname=x\nseqLength = "), F.col("n").cast("string"), F.lit("\nframeRate=25\nimWidth=1360\nimHeight=765\nimExt=.jpg"))
    return S.seqinfo_rows(n.select("sequence_id", F.posexplode(F.split(text, "\n")).alias("n", "value")))


@register("s7_inferred_metadata", sql("SELECT sequence_id, count(*) AS total_frames, 30 AS frame_rate, 640 + min(frame_id) AS frame_width, 480 AS frame_height FROM frames GROUP BY sequence_id", "frames"))
def _(spark, sf):
    files = S.numbered(frame_files(spark, sf))
    head, tail = F.unhex(F.lit("FFD8FFE000044A46FFC0001108")), F.unhex(F.lit("03012200021101031101"))  # a header up to its sizes, and behind them
    size = F.unhex(F.concat(F.lit("01E0"), F.lpad(F.hex((F.col("frame_id") + 640).cast("long")), 4, "0")))
    return S.infer(S.with_size(files.select("sequence_id", "path", F.concat(head, size, tail).alias("content"))))


SCENE = """SELECT 'seq_' || n_nationkey AS sequence_id, 10 + n_nationkey AS total_frames, NULL::INTEGER AS rate, '/data/' || CASE n_nationkey % 4
  WHEN 0 THEN 'VisDrone2019-MOT-train' WHEN 1 THEN 'val' WHEN 2 THEN 'my-DET-test-dev' ELSE 'trainers' END || '/sequences/s' || n_nationkey AS path,
  n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 20.5 + n_nationkey END AS altitude FROM nation"""


@register("s9_scenes", f"""
SELECT sequence_id, total_frames, 30 AS frame_rate, CASE WHEN n_nationkey < 20 THEN coalesce(altitude, 50.0) ELSE 50.0 END::DOUBLE AS altitude_m,
  CASE WHEN n_nationkey < 20 AND altitude IS NOT NULL THEN 'lookup' ELSE 'estimated' END AS altitude_source, CASE WHEN n_nationkey < 20 THEN 'foggy' ELSE 'clear' END AS weather,
  CASE n_nationkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'unknown' END AS split, n_nationkey % 2 = 0 AS annotation_available FROM ({SCENE})""")
def _(spark, sf):
    k = F.col("n_nationkey")
    part = F.element_at(F.array(*map(F.lit, ("VisDrone2019-MOT-train", "val", "my-DET-test-dev", "trainers"))), (k % 4 + 1).cast("int"))
    s = table(spark, sf, "nation").select(
        F.concat(F.lit("seq_"), k.cast("string")).alias("sequence_id"), (k + 10).alias("total_frames"), F.lit(None).cast("int").alias("frame_rate"), F.lit(1360).alias("frame_width"), F.lit(765).alias("frame_height"),
        F.concat(F.lit("/data/"), part, F.lit("/sequences/s"), k.cast("string")).alias("path"), (k % 2 == 0).alias("annotated"), k.alias("k"),
    )
    lookup = s.where("k < 20").select("sequence_id", F.when(F.col("k") % 3 == 0, F.col("k") + 20.5).alias("altitude_m"), F.lit("foggy").alias("weather"), F.lit(None).alias("scene_type"), F.lit(None).alias("time_of_day"))
    return S.scenes(s.drop("k"), lookup).select("sequence_id", "total_frames", "frame_rate", "altitude_m", "altitude_source", "weather", "split", "annotation_available")


@register("m18_altitude", f"SELECT sequence_id, coalesce(altitude, 50.0)::DOUBLE AS altitude_m, CASE WHEN altitude IS NULL THEN 'estimated' ELSE 'lookup' END AS altitude_source FROM ({SCENE})")
def _(spark, sf):
    k = F.col("n_nationkey")
    s = table(spark, sf, "nation").select(
        F.concat(F.lit("seq_"), k.cast("string")).alias("sequence_id"), F.lit(1).alias("total_frames"), F.lit(30).alias("frame_rate"), F.lit(1).alias("frame_width"), F.lit(1).alias("frame_height"), F.lit("x").alias("path"),
        F.lit(False).alias("annotated"), k.alias("k"),
    )
    lookup = s.select("sequence_id", F.when(F.col("k") % 3 == 0, F.col("k") + 20.5).alias("altitude_m"), *(F.lit(None).alias(c) for c in ("weather", "scene_type", "time_of_day")))
    return S.scenes(s.drop("k"), lookup).select("sequence_id", "altitude_m", "altitude_source")




@register("m17_split", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' WHEN 5 THEN 'val' ELSE 'unknown' END AS split FROM pages""")
def _(spark, sf):
    paths = ("data/VisDrone2019-MOT-Train", "a/b/VAL", "x/test/sequences", "plain/training", "train/a/b/c/d", "val/train")
    path = F.concat(F.element_at(F.array(*map(F.lit, paths)), (F.col("page_id") % 6 + 1).cast("int")), F.lit("/s"), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", T.split_name(path).alias("split"))


# ------------------------------------------------------------------ detections


class Stub:
    """A model without weights: boxes that follow from the frame's bytes."""

    def __call__(self, content: bytes):
        (k,) = struct.unpack(">i", content)
        return [[k, k, k + 10.0, k + 20.0], [0.0, 0.0, 5.0, 5.0], [1.0, 1.0, 2.0, 2.0]], [0.9, (k % 10) / 10], [k % 5, 3, 4]


NAMES = {0: "pedestrian", 1: "people", 2: "bicycle", 3: "car"}


@register("t1_t2_detections", sql("""
SELECT sequence_id, frame_id, pos, class_id, ['pedestrian', 'people', 'bicycle', 'car', '4'][class_id + 1] AS class_name, confidence, x1, y2, 0 AS occlusion FROM (
  SELECT sequence_id, frame_id, 0 AS pos, frame_id % 5 AS class_id, 0.9::DOUBLE AS confidence, frame_id::DOUBLE AS x1, frame_id + 20.0::DOUBLE AS y2 FROM frames
  UNION ALL SELECT sequence_id, frame_id, 1, 3, (frame_id % 10)::DOUBLE / 10, 0.0, 5.0 FROM frames) WHERE confidence >= 0.35::DOUBLE""", "frames"))
def _(spark, sf):
    f = motion.frames(states(spark, sf)).select("sequence_id", "frame_id", F.unhex(F.lpad(F.hex(F.col("frame_id").cast("long")), 8, "0")).alias("content"))
    found = tracking.format_detections(tracking.infer(f, Stub), NAMES, CONFIG.inference.confidence)
    return found.select("sequence_id", "frame_id", "pos", "class_id", "class_name", "confidence", "x1", "y2", "occlusion")


AREA = "greatest(0, {0}.x2 - {0}.x1) * greatest(0, {0}.y2 - {0}.y1)"
BOTH = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
CTES["shaken"] = (
    """SELECT sequence_id || ':' || frame_id AS image_id, class_name, track_id * 2 + d AS pos, x1 + d * (track_id % 7) / 200::DOUBLE AS x1, y1, x2 + d * (track_id % 7) / 200::DOUBLE AS x2, y2,
         ((track_id * 13 + frame_id * 29 + d * 31) % 101) / 100::DOUBLE AS confidence FROM states, (SELECT unnest([0, 1]) AS d)""",
    ("states",),
)
CTES["nms"] = (
    f"""SELECT a.image_id || a.class_name AS g, a.image_id, a.class_name, a.pos, row_number() OVER (PARTITION BY a.image_id, a.class_name ORDER BY a.confidence DESC, a.pos) AS k,
          (SELECT list(b.pos) FROM shaken b WHERE b.image_id = a.image_id AND b.class_name = a.class_name AND b.pos <> a.pos AND ({BOTH}) / ({AREA.format('a')} + {AREA.format('b')} - {BOTH}) > 0.45) AS close
        FROM shaken a""",
    ("shaken",),
)
CTES["nms_done"] = (
    """SELECT DISTINCT g, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM nms
       UNION ALL SELECT n.g, n.k, CASE WHEN list_has_any(d.kept, coalesce(n.close, [])) THEN d.kept ELSE list_append(d.kept, n.pos) END FROM nms_done d JOIN nms n ON n.g = d.g AND n.k = d.k + 1""",
    ("nms",),
)


@register("t4_suppression", sql("SELECT image_id, class_name, pos FROM nms n JOIN nms_done d USING (g, k) WHERE list_contains(kept, pos)", "nms", "nms_done"))
def _(spark, sf):
    s = states(spark, sf).withColumn("d", F.explode(F.array(F.lit(0), F.lit(1))))
    shift = F.col("d") * (F.col("track_id") % 7) / 200.0
    shaken = s.select(
        F.concat_ws(":", "sequence_id", "frame_id").alias("image_id"), "class_name", (F.col("track_id") * 2 + F.col("d")).alias("pos"), (F.col("x1") + shift).alias("x1"), "y1", (F.col("x2") + shift).alias("x2"), "y2",
        (((F.col("track_id") * 13 + F.col("frame_id") * 29 + F.col("d") * 31) % 101) / 100.0).alias("confidence"),
    )
    return tracking.suppress(shaken, CONFIG).select("image_id", "class_name", "pos")


@register("x5_overlay_boxes", sql("""
SELECT track_id, CAST(greatest(0, least(1359, round_even(x1 * 1360 / (1280::DOUBLE / 1360), 0))) AS INTEGER) AS px1,
  CAST(greatest(0, least(764, round_even((y1 * 765 - 280) / (1280::DOUBLE / 1360), 0))) AS INTEGER) AS py1, CAST(greatest(0, least(1359, round_even(x2 * 1360 / (1280::DOUBLE / 1360), 0))) AS INTEGER) AS px2,
  CAST(greatest(0, least(764, round_even((y2 * 765 - 280) / (1280::DOUBLE / 1360), 0))) AS INTEGER) AS py2, class_name || ' #' || track_id AS label FROM states WHERE sequence_id = 'seq_0' AND frame_id = 5""", "states"))
def _(spark, sf):
    s = states(spark, sf).where("sequence_id = 'seq_0' and frame_id = 5")
    return G.overlay_boxes(s, 1360, 765)


# ------------------------------------------------------------------ scalar rules over text

QUERY_TEXTS = (
    "", "MATCH (o:Object) RETURN o.class", "  match (o) return o.x  ", "```cypher\nMATCH (a)-[r]->(b) RETURN r\n```", "```\nMATCH (a) SET a.x = 1 RETURN a\n```", "MATCH (o) WHERE o.dataset = 'a' RETURN o",
    "MATCH (o) RETURN o GROUP BY o", "MATCH (o {IS_Active: true}) RETURN o", "MATCH (o) WHERE o.this_is_active RETURN o", "SHOW x RETURN y", "MATCH (o)\nRETURN\no", "MATCH (o) RETURN o;", "MATCH (o RETURN o", "MATCH (o)] RETURN [o",
    "MATCH (o) RETURN count(o) HAVING 1", "OPTIONAL MATCH (o) RETURN {a: [o, (1)]}", "CALL dbms.x() RETURN 1", "UNWIND [1, 2] AS x RETURN x", "WITH 1 AS x RETURN ([)]",
)
_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in QUERY_TEXTS)
_CLEAN = "CASE WHEN starts_with(t0, '```') THEN trim(regexp_replace(regexp_replace(t0, '^```[A-Za-z]*\\n?', ''), '```$', ''), e' \\t\\r\\n') ELSE t0 END"


@register("p11_query_rules", f"""
SELECT p_partkey, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(u, 'CREATE|MERGE|DELETE|DETACH|SET|REMOVE|DROP|LOAD CSV|CALL DBMS') THEN 'write' WHEN regexp_matches(u, 'GROUP BY|HAVING ') THEN 'sql_only'
    WHEN regexp_matches(u, '\\bIS_ACTIVE\\b') THEN 'not_stored' WHEN NOT regexp_matches(u, '^(MATCH|OPTIONAL MATCH|WITH|UNWIND|CALL)') THEN 'no_read_clause' WHEN NOT contains(u, 'RETURN ') THEN 'no_return'
    WHEN contains(t, ';') THEN 'semicolon' WHEN b <> '' THEN 'unbalanced' END AS problem FROM (
  SELECT *, upper(t) AS u, list_reduce([regexp_replace(t, '[^()\\[\\]{{}}]', '', 'g')] || list_transform(range(12), lambda i: ''), lambda x, y: replace(replace(replace(x, '()', ''), '[]', ''), '{{}}', '')) AS b FROM (
    SELECT p_partkey, {_CLEAN} AS t FROM (SELECT p_partkey, trim([{_LIST}][1 + p_partkey % {len(QUERY_TEXTS)}], e' \\t\\r\\n') AS t0 FROM part)))""")
def _(spark, sf):
    text = F.element_at(F.array(*map(F.lit, QUERY_TEXTS)), (F.col("p_partkey") % len(QUERY_TEXTS) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.query_problem(text).alias("problem"))


CTES["asked"] = (
    """SELECT conv_id, turn, [['person', 'dog'], ['car'], ['PEOPLE'], ['person', 'pedestrian', 'people'], []][1 + turn % 5] AS classes,
         coalesce(text, '') || [' how many people', ' how many cars', ' a woman', ' movement', ''][1 + conv_id % 5] AS question FROM conversations""",
    (),
)


@register("q18_alias", sql("""
SELECT conv_id, turn, array_to_string(CASE WHEN regexp_matches(lower(question), '\\b(person|people|pedestrian|pedestrians|man|men|woman|women)\\b') AND list_has_any(l, ['person', 'pedestrian', 'people'])
  THEN classes || list_filter(['person', 'pedestrian', 'people'], lambda a: NOT list_contains(l, a)) ELSE classes END, ',') AS classes FROM (SELECT *, list_transform(classes, lambda c: lower(c)) AS l FROM asked)""", "asked"))
def _(spark, sf):
    c = table(spark, sf, "conversations")
    lists = F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in (["person", "dog"], ["car"], ["PEOPLE"], ["person", "pedestrian", "people"], [])))
    more = F.array(*map(F.lit, (" how many people", " how many cars", " a woman", " movement", "")))
    question = F.concat(F.coalesce("text", F.lit("")), F.element_at(more, (F.col("conv_id") % 5 + 1).cast("int")))
    classes = F.element_at(lists, (F.col("turn") % 5 + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat_ws(",", T.alias_classes(question, classes)).alias("classes"))




@register("q19_fallback", sql("""
SELECT 'inventory' AS kind, class, NULL::BIGINT AS n FROM (SELECT DISTINCT class FROM objects) UNION ALL SELECT 'counts', class, count(*) FROM objects GROUP BY class
UNION ALL SELECT 'direct', name, count(*) FROM (SELECT DISTINCT sequence_id, track_id, name FROM states JOIN classes ON class_name = name) GROUP BY name""", "objects", "states", "classes"))
def _(spark, sf):
    """Questions over class edges: answered by them where there are any, else by the objects; a question on speed gets nothing."""
    g = tables(spark, sf)
    none = g.changed(edge_belongs_to_class=g["edge_belongs_to_class"].where("false"))
    asked = (
        (none, "which types of objects are there", "MATCH (o)-[:BELONGS_TO_CLASS]->(c) RETURN c.name"), (none, "how many of each category", "MATCH (o)-[:BELONGS_TO_CLASS]->(c) RETURN c.name, COUNT(o)"),
        (none, "what speed", "MATCH (o)-[:BELONGS_TO_CLASS]->(c) RETURN c.name"), (none, "which types", "MATCH (o) RETURN o.class"), (g, "which classes", "MATCH (o)-[:BELONGS_TO_CLASS]->(c) RETURN c.name"),
    )
    parts = [Q.class_answer(tables_, question, query) for tables_, question, query in asked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("m20_event_metadata", sql("""
SELECT event_key, event_type, CASE event_type WHEN 'NEAR_MISS' THEN 'distance' WHEN 'LOITER' THEN 'zone' WHEN 'CONVOY' THEN 'distance,heading_diff' WHEN 'CROWD_FORM' THEN 'density,zone' ELSE 'vehicle_ratio,zone' END AS keys,
  round(CASE event_type WHEN 'CROWD_FORM' THEN density WHEN 'JAYWALKING' THEN vehicle_ratio ELSE distance END, 6) AS value, CASE WHEN event_type IN ('LOITER', 'CROWD_FORM', 'JAYWALKING') THEN zone_id END AS zone FROM keyed""", "keyed"))
def _(spark, sf):
    e = E.metadata_json(E.keyed(E.all_events(states(spark, sf), CONFIG)))
    get = lambda k: F.get_json_object("metadata_json", f"$.{k}")
    value = F.coalesce(get("density"), get("vehicle_ratio"), get("distance")).cast("double")
    return e.select("event_key", "event_type", F.concat_ws(",", F.json_object_keys("metadata_json")).alias("keys"), F.round(value, 6).alias("value"), get("zone").alias("zone"))


# ------------------------------------------------------------------ orders, sets, comparisons


@register("o4_null_order", sql("""SELECT event_type, sequence_id, frame_id, primary_track_id, zone_id, row_number() OVER (PARTITION BY sequence_id ORDER BY secondary_track_id ASC NULLS LAST, event_type, frame_id, primary_track_id, zone_id NULLS LAST) AS up,
  row_number() OVER (PARTITION BY sequence_id ORDER BY secondary_track_id DESC NULLS FIRST, event_type, frame_id, primary_track_id, zone_id NULLS LAST) AS down FROM events_""", "events_"))
def _(spark, sf):
    e = E.all_events(states(spark, sf), CONFIG)
    rest = ("event_type", "frame_id", "primary_track_id", F.col("zone_id").asc_nulls_last())
    for name, order in (("up", Q.ascending("secondary_track_id")), ("down", Q.descending("secondary_track_id"))):
        e = Q.ranked(e, ["sequence_id"], (order, *rest)).withColumnRenamed("rank", name)
    return e.select("event_type", "sequence_id", "frame_id", "primary_track_id", "zone_id", "up", "down")


@register("o6_shown_rows", sql("SELECT sequence_id, track_id, class FROM objects ORDER BY sequence_id, track_id LIMIT 10", "objects"))
def _(spark, sf):
    o = tables(spark, sf)["node_object"].select("sequence_id", "track_id", "class")
    return o.orderBy("sequence_id", "track_id").limit(10)


@register("u2_statements", sql("""
SELECT 'COEXISTS_WITH' AS edge, sequence_id, count(*) AS n FROM (SELECT a.sequence_id FROM snaps a JOIN snaps b ON a.sequence_id = b.sequence_id AND (a.f0 < b.f0 OR (a.f0 = b.f0 AND a.track_id < b.track_id)) AND b.f0 <= a.f1) GROUP BY ALL
UNION ALL SELECT 'SAME_ENTITY_AS', sequence_id, count(*) FROM accepted GROUP BY ALL""", "snaps", "accepted"))
def _(spark, sf):
    both = reid.statements(reid.resolve(fragments(spark, sf), CONFIG))
    return both.groupBy("edge", "sequence_id").agg(F.count(F.lit(1)).alias("n"))


@register("u4_union", sql("SELECT class FROM objects WHERE sequence_id = 'seq_0' UNION SELECT name FROM classes", "objects", "classes"))
def _(spark, sf):
    g = tables(spark, sf)
    return Q.union_of(Q.in_sequence(g["node_object"], "seq_0").select("class"), g["node_object_class"].select(F.col("name").alias("class")))


CTES["few"] = ("SELECT sequence_id, track_id, frame_id FROM states", ("states",))
_CASES = {
    "reordered": ("SELECT * FROM few", "SELECT * FROM few ORDER BY frame_id DESC"), "one_row_twice": ("SELECT * FROM few", "SELECT * FROM few UNION ALL (SELECT * FROM few ORDER BY ALL LIMIT 1)"),
    "all_twice": ("SELECT * FROM few UNION ALL SELECT * FROM few", "SELECT few.* FROM few, range(2)"), "other_value": ("SELECT * FROM few", "SELECT sequence_id, track_id, frame_id + 1 FROM few"),
    "both_empty": ("SELECT * FROM few WHERE false", "SELECT * FROM few WHERE frame_id < 0"),
}


def _less(a: str, b: str) -> str:
    return f"(SELECT count(*) FROM (({a}) EXCEPT ALL ({b})))"


@register("a14_same_rows", sql("SELECT *, missing + extra = 0 AS equal FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, {_less(a, b)} AS missing, {_less(b, a)} AS extra" for k, (a, b) in _CASES.items()) + ")", "few"))
def _(spark, sf):
    few = states(spark, sf).select("sequence_id", "track_id", "frame_id")
    one = few.orderBy(*few.columns).limit(1)
    cases = {
        "reordered": (few, few.orderBy(F.col("frame_id").desc())), "one_row_twice": (few, few.unionAll(one)), "all_twice": (few.unionAll(few), few.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).select(few.columns)),
        "other_value": (few, few.withColumn("frame_id", F.col("frame_id") + 1)), "both_empty": (few.where("false"), few.where("frame_id < 0")),
    }
    parts = [V.difference(a, b).select(F.lit(k).alias("name"), "missing", "extra", "equal") for k, (a, b) in cases.items()]
    return reduce(DataFrame.unionByName, parts)


CTES["scored_at"] = (
    """SELECT pos, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (
         SELECT pos, count(*) FILTER (WHERE l_quantity >= pos // 2 * 5 AND l_returnflag = 'R') AS tp, count(*) FILTER (WHERE l_quantity >= pos // 2 * 5 AND l_returnflag <> 'R') AS fp,
           count(*) FILTER (WHERE l_quantity < pos // 2 * 5 AND l_returnflag = 'R') AS fn FROM lineitem, range(1, 20) AS c(pos) GROUP BY pos)""",
    (),
)


@register("o5_calibrate", sql("""SELECT pos, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM scored_at
  ORDER BY CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END DESC, p DESC, r DESC, pos LIMIT 1""", "scored_at"))
def _(spark, sf):
    at = F.floor(F.col("pos") / 2) * 5  # two candidates of each threshold: a tie
    hit, above = F.col("l_returnflag") == "R", F.col("l_quantity") >= at
    c = table(spark, sf, "lineitem").select("l_quantity", "l_returnflag", F.explode(F.sequence(F.lit(1), F.lit(19))).alias("pos"))
    counts = c.groupBy("pos").agg(F.count_if(above & hit).alias("tp"), F.count_if(above & ~hit).alias("fp"), F.count_if(~above & hit).alias("fn"))
    return V.calibrate(V.prf(counts)).select("pos", "tp", *r6("precision", "recall", "f1"))


# ------------------------------------------------------------------ identities, messages, writers


@register("r8_field_fallbacks", sql("""
SELECT sequence_id, track_id, class, round(fx, 6) AS first_cx, round(ly, 6) AS last_cy, round(CASE WHEN track_id % 2 = 0 THEN stored ELSE h_in END, 6) AS heading_at_entry FROM snaps2""", "snaps2"))
def _(spark, sf):
    """Snapshots whose fields are partly absent: even tracks lack headings, all lack centroids and name their class differently."""
    s = fragments(spark, sf)
    stored = states(spark, sf).groupBy("sequence_id", F.expr("track_id * 10 + frame_id div 20").alias("track_id")).agg(F.max_by("heading_deg", "frame_id").alias("heading_deg"))
    even = F.col("track_id") % 2 == 0
    loose = s.join(stored, ["sequence_id", "track_id"]).withColumns({h: F.when(~even, F.col(h)) for h in ("heading_at_entry", "heading_at_exit")})
    loose = loose.withColumnRenamed("class", "class_name").drop("first_cx", "first_cy", "last_cx", "last_cy")
    return reid.snapshot_fields(loose).select("sequence_id", "track_id", "class", *r6("first_cx", "last_cy", "heading_at_entry"))


@register("r9_run_counts", sql("""
SELECT sequence_id, object_count, coalesce(c, 0) + 3 * coalesce(i, 0) AS statement_count, true AS post_processed FROM (SELECT sequence_id, count(*) AS object_count FROM snaps GROUP BY ALL)
LEFT JOIN (SELECT a.sequence_id, count(*) AS c FROM snaps a JOIN snaps b ON a.sequence_id = b.sequence_id AND (a.f0 < b.f0 OR (a.f0 = b.f0 AND a.track_id < b.track_id)) AND b.f0 <= a.f1 GROUP BY ALL) USING (sequence_id)
LEFT JOIN (SELECT sequence_id, count(*) AS i FROM accepted GROUP BY ALL) USING (sequence_id)""", "snaps", "accepted"))
def _(spark, sf):
    s = fragments(spark, sf)
    r = reid.resolve(s, CONFIG)
    return reid.run_counts(s, r["same_entity_as"], r["coexists_with"])


@register("m11_speed_fallback", sql("SELECT sequence_id, track_id, frame_id, round(CASE track_id % 3 WHEN 0 THEN speed WHEN 1 THEN cx ELSE 0 END, 6) AS speed FROM states", "states"))
def _(spark, sf):
    k = F.col("track_id") % 3
    s = states(spark, sf).withColumns({"speed_px_per_frame": F.when(k == 0, F.col("speed")), "speed": F.when(k == 1, F.col("cx"))})
    return s.select("sequence_id", "track_id", "frame_id", F.round(G.speed_of(s), 6).alias("speed"))


@register("x2_last_message_wins", "SELECT 'm' || conv_id AS message_id, arg_max(coalesce(role, 'Unknown'), turn) AS sender, arg_max(coalesce(text, ''), turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("message_id"), F.lit("seq_0").alias("sequence_id"), F.col("role").alias("sender"), "text", F.lit(5).alias("timestamp"), "turn")
    return M.normalise(c, arrival="turn").select("message_id", "sender", "text")


@register("a16_run_summary", sql("""SELECT sequence_id, frame_count, object_count, state_count, coalesce(n, 0) AS event_count FROM (
  SELECT sequence_id, count(DISTINCT frame_id) AS frame_count, count(DISTINCT track_id) AS object_count, count(*) AS state_count FROM states GROUP BY ALL) LEFT JOIN (SELECT sequence_id, count(*) AS n FROM events_ GROUP BY ALL) USING (sequence_id)""", "states", "events_"))
def _(spark, sf):
    s = states(spark, sf)
    return sinks.run_summary(s, E.all_events(s, CONFIG))


@register("k5_audit_log", sql("SELECT sequence_id, track_a, track_b, round(confidence, 6) AS confidence FROM cands ANTI JOIN accepted USING (sequence_id, track_a, track_b)", "cands", "accepted"))
def _(spark, sf):
    """Ambiguous identities as they come back from the log, written in two batches."""
    log = f"{folder(spark)}/audit-{uuid.uuid4().hex}"
    rows = reid.resolve(fragments(spark, sf), CONFIG)["ambiguous"].select("sequence_id", "track_a", "track_b", *r6("confidence"))
    for k in (0, 1):
        sinks.audit(rows.where(F.col("track_a") % 2 == k), log)
    return spark.read.schema("sequence_id string, track_a long, track_b long, confidence double").json(log)


@register("k3_dead_letters", sql("SELECT sequence_id, track_id, class FROM objects", "objects"))
def _(spark, sf):
    """A batch whose write fails is kept and written again by the replay."""
    top = f"{folder(spark)}/letters-{uuid.uuid4().hex}"
    rows = graph.object_nodes(states(spark, sf)).select("sequence_id", "track_id", "class")

    def fails(df: DataFrame) -> None:
        raise OSError("the store is away")

    try:
        sinks.write_or_keep(rows, fails, f"{top}/kept")
    except OSError:
        sinks.replay(spark, f"{top}/kept", rows.schema, lambda df: df.write.parquet(f"{top}/store"))
    return spark.read.parquet(f"{top}/store")


@register("k1_graph_written_twice", sql("SELECT 'node_object' AS name, count(*) AS n FROM objects UNION ALL SELECT 'edge_near', count(*) FROM near_ UNION ALL SELECT 'node_event', count(*) FROM (SELECT DISTINCT event_key, zone_id FROM keyed)", "objects", "near_", "keyed"))
def _(spark, sf):
    """Row counts of tables after their sequences were ingested twice."""
    top, g = f"{folder(spark)}/graph-{uuid.uuid4().hex}", tables(spark, sf)
    kept = {n: g[n] for n in ("node_object", "edge_near", "node_event")}
    for _ in range(2):
        graph.write(kept, top)
    parts = [spark.read.parquet(f"{top}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in kept]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("s16_event_payload", sql("SELECT event_type, sequence_id, frame_id, primary_track_id, secondary_track_id FROM events_ WHERE event_type = 'NEAR_MISS'", "events_"))
def _(spark, sf):
    """Evaluation payloads, one for each sequence, written as JSON lines and read back."""
    ev = E.near_miss(states(spark, sf), CONFIG).select("event_type", "sequence_id", "frame_id", "primary_track_id", "secondary_track_id")
    path = f"{folder(spark)}/payload-{uuid.uuid4().hex}"
    rows = F.collect_list(F.struct(*ev.columns))
    ev.groupBy("sequence_id").agg(rows.alias("predictions"), F.slice(rows, 1, 1).alias("ground_truths")).drop("sequence_id").write.json(path)
    fields = "event_type string, sequence_id string, frame_id int, primary_track_id long, secondary_track_id long"
    return S.evaluation(spark, path, fields, lines=True)[0].drop("pos")


@register("s8_manifest", "SELECT CAST(c_nationkey AS BIGINT) AS nation, 'cust_' || c_custkey AS sequence_id FROM customer")
def _(spark, sf):
    """A manifest for each nation, lists and objects by turns."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.collect_list(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string"))).alias("ids"))
    text = F.when(F.col("nation") % 2 == 0, F.to_json("ids")).otherwise(F.to_json(F.struct(F.col("ids").alias("sequence_ids"))))
    return S.manifest_rows(c.select("nation", text.alias("value")))


@register("s11_messages", sql("SELECT message_id, sender, text, timestamp, 'seq_0' AS sequence_id FROM messages", "messages"))
def _(spark, sf):
    """Message lists of bounded size, one a line."""
    path = f"{folder(spark)}/messages-{uuid.uuid4().hex}"
    one = messages(spark, sf).select("message_id", F.coalesce("sender", F.lit("Unknown")).alias("sender"), "text", F.col("timestamp").cast("long").alias("timestamp"))
    size = max(1, one.count() // 500)
    lists = one.groupBy(F.pmod(F.xxhash64("message_id", "timestamp", "text"), F.lit(size)).alias("list")).agg(F.to_json(F.collect_list(F.struct(*one.columns))).alias("value"))
    lists.select("value").write.text(path)
    return S.messages(spark, path, "seq_0", lines=True)


# ------------------------------------------------------------------ digests, windows


def _values(column: str) -> str:
    d = f"(SELECT DISTINCT CAST({column} AS VARCHAR) AS v FROM states WHERE {column} IS NOT NULL)"
    more = "CASE WHEN count(*) > 10 THEN ', +' || (count(*) - 10) || ' more' ELSE '' END"
    return f"SELECT '{column}' AS column_name, count(*) AS n_values, (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT v FROM {d} ORDER BY v LIMIT 10)) || {more} AS shown FROM {d}"


@register("a15_digest_values", sql(" UNION ALL ".join(map(_values, ("class_name", "zone_id", "track_id", "event_role"))), "states"))
def _(spark, sf):
    return digest.values(states(spark, sf), ["class_name", "zone_id", "track_id", "event_role"])


@register("stream_sliding_windows", sql("""
SELECT sequence_id, zone_id, s AS first_frame, count(*) AS n_states FROM (SELECT sequence_id, zone_id, unnest([frame_id // 5 * 5, frame_id // 5 * 5 - 5]) AS s FROM states) GROUP BY ALL""", "states"))
def _(spark, sf):
    return stream.replay_windows(states(spark, sf))
