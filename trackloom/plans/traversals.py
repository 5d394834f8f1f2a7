"""The canonical graph questions as DataFrame plans over node and edge tables.

``g`` is the dictionary of tables that ``operators.graph.build`` makes.  Orders that the
caller sees are explicit: ascending puts nulls last, descending puts them first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import taxonomy_fallback
from ..sources.shared import write_once

CRITICAL = 0.03


def in_sequence(df: DataFrame, sequence_id: str | None) -> DataFrame:
    return df if sequence_id is None else df.where(F.col("sequence_id") == sequence_id)


def trajectory(g, sequence_id: str, track_id: int) -> DataFrame:
    e = in_sequence(g["edge_appeared_in"], sequence_id).where(F.col("track_id") == track_id)
    return e.select("frame_id", "cx", "cy").orderBy("frame_id")


def events_of(g, sequence_id: str | None, track_id: int | None = None) -> DataFrame:
    inv = in_sequence(g["edge_involves"], sequence_id)
    inv = inv if track_id is None else inv.where(F.col("track_id") == track_id)
    ev = g["node_event"].select("sequence_id", "event_key", "event_type", "frame_id", "metadata_json")
    return inv.join(ev.hint("merge"), ["sequence_id", "event_key"]).select("sequence_id", "track_id", "role", "event_type", "frame_id", "metadata_json").orderBy("frame_id")


def zone_density(g, frame_id: int, sequence_id: str | None = None) -> DataFrame:
    e = in_sequence(g["edge_in_zone"], sequence_id).where(F.col("frame_id") == frame_id)
    return e.groupBy("sequence_id", "zone_id").agg(F.count(F.lit(1)).alias("density")).orderBy(F.col("density").desc_nulls_first(), "sequence_id", "zone_id")


def severity(distance):
    return F.when(distance < CRITICAL, "critical").otherwise("warning")


def near_misses_in(g, **scene) -> DataFrame:
    """Near misses of objects detected in scenes with the given properties."""
    sc = g["node_scene"]
    for k, v in scene.items():
        sc = sc.where(F.col(k) == v)
    det = g["edge_detected_in"].join(sc.select("sequence_id").hint("merge"), "sequence_id", "left_semi")
    nm = g["edge_near_miss"].join(det.withColumnRenamed("track_id", "a_track_id").hint("merge"), ["sequence_id", "a_track_id"], "left_semi")
    return nm.select("sequence_id", "a_track_id", "b_track_id", "frame_id", "distance", severity(F.col("distance")).alias("severity")).orderBy(F.col("severity").desc_nulls_first(), "sequence_id", "frame_id")


def moved_between(g, zone_a: str, zone_b: str, sequence_id: str | None = None) -> DataFrame:
    """Objects first seen in one zone before they were first seen in the other."""
    entry = in_sequence(g["edge_in_zone"], sequence_id).groupBy("sequence_id", "track_id", "zone_id").agg(F.min("frame_id").alias("entry"))
    a = entry.where(F.col("zone_id") == zone_a).select("sequence_id", "track_id", F.col("entry").alias("left_from"))
    b = entry.where(F.col("zone_id") == zone_b).select("sequence_id", "track_id", F.col("entry").alias("arrived_at"))
    both = a.join(b.hint("merge"), ["sequence_id", "track_id"]).where("left_from < arrived_at")
    return both.join(g["node_object"].select("sequence_id", "track_id", "class").hint("merge"), ["sequence_id", "track_id"])


def group_proximity(g, group_a: str = "VulnerableRoadUser", group_b: str = "MotorVehicle", sequence_id: str | None = None) -> DataFrame:
    """Objects of one class group near those of another; NEAR runs from the lower to the higher id, so both directions count."""
    near = in_sequence(g["edge_near"], sequence_id)
    both = near.select("sequence_id", F.col("a_track_id").alias("x"), F.col("b_track_id").alias("y"), "distance").unionByName(
        near.select("sequence_id", F.col("b_track_id").alias("x"), F.col("a_track_id").alias("y"), "distance")
    )
    cls = g["edge_belongs_to_class"]
    of = lambda grp, c: cls.where(F.col("class_group") == grp).select("sequence_id", F.col("track_id").alias(c), F.col("name").alias(f"{c}_class"))
    return both.join(of(group_a, "x").hint("merge"), ["sequence_id", "x"]).join(of(group_b, "y").hint("merge"), ["sequence_id", "y"])


def convoys(g, durations: DataFrame, sequence_id: str | None = None) -> DataFrame:
    """Each convoy once, with the longest run of its pair."""
    c = in_sequence(g["edge_convoy_with"], sequence_id).where("a_track_id < b_track_id")
    return c.join(durations.hint("merge"), ["sequence_id", "a_track_id", "b_track_id"]).select("sequence_id", "a_track_id", "b_track_id", "duration_frames", "avg_distance")


def lifespan(same_entity: DataFrame, appeared: DataFrame, sequence_id: str, track_id: int, hops: int = 3) -> DataFrame:
    """Frames of a track and of all tracks within ``hops`` identity links of it, in either direction."""
    one = appeared.sparkSession.range(1).select(F.lit(track_id).cast("long").alias("track_id"))
    found = reach(in_sequence(same_entity, sequence_id), one, "track_a", "track_b", 0, hops).select(F.col("b").alias("track_id"))
    return in_sequence(appeared, sequence_id).join(found, "track_id", "left_semi").select("track_id", "frame_id", "cx", "cy").orderBy("frame_id", "track_id")


def loitering_hotspots(g, durations: DataFrame, top: int = 10) -> DataFrame:
    lo = g["edge_loitering_in"].join(durations.hint("merge"), ["sequence_id", "track_id", "zone_id"], "left")
    out = lo.groupBy("zone_id").agg(F.count(F.lit(1)).alias("loiter_events"), F.avg("duration_frames").alias("avg_duration"))
    return out.orderBy(F.col("loiter_events").desc_nulls_first(), "zone_id").limit(top)


def crowd_then_loiter(g, sequence_id: str | None = None, within: int = 30) -> DataFrame:
    """Each frame with loitering and the latest crowd at most ``within`` frames before it in the sequence: one window, no pairs."""
    ev = in_sequence(g["node_event"], sequence_id).where("event_type in ('CROWD_FORM', 'LOITER')").groupBy("sequence_id", "frame_id")
    at = ev.agg(F.max(F.when(F.col("event_type") == "CROWD_FORM", F.col("frame_id"))).alias("crowd"), F.count_if(F.col("event_type") == "LOITER").alias("n"))
    before = W.partitionBy("sequence_id").orderBy("frame_id").rangeBetween(-within, -1)
    at = at.withColumn("crowd_frame", F.max("crowd").over(before)).where("n > 0 and crowd_frame is not null")
    return at.select("sequence_id", "crowd_frame", F.col("frame_id").alias("loiter_frame"), (F.col("frame_id") - F.col("crowd_frame")).alias("frames_between"))


def messages_by(messages: DataFrame, sender: str) -> DataFrame:
    return messages.where(F.col("sender") == sender).select("message_id", "text")


def persons_by_zone(g, classes=("person", "pedestrian", "people")) -> DataFrame:
    """Object-frames and distinct objects of the given classes in each zone."""
    o = g["node_object"].where(F.col("class").isin(*classes)).select("sequence_id", "track_id")
    e = g["edge_in_zone"].join(o.hint("merge"), ["sequence_id", "track_id"], "left_semi")
    return e.groupBy("sequence_id", "zone_id").agg(F.count(F.lit(1)).alias("person_count"), F.countDistinct("track_id").alias("distinct_persons")).orderBy(F.col("person_count").desc_nulls_first())


def audit(g) -> DataFrame:
    """Row counts of all node and edge tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in sorted(g.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_inventory(g) -> DataFrame:
    return g["node_object"].select("class").distinct().orderBy("class")


def class_counts(g, sequence_id: str | None = None) -> DataFrame:
    return in_sequence(g["node_object"], sequence_id).groupBy("sequence_id", "class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc_nulls_first(), "class")


def class_query(g, name: str) -> DataFrame:
    """Objects of a class through the taxonomy; without taxonomy edges, from the objects themselves."""
    tax = g["edge_belongs_to_class"].where(F.col("name") == name).select("sequence_id", "track_id")
    if tax.isEmpty():
        return g["node_object"].where(F.col("class") == name).select("sequence_id", "track_id")
    return tax


def class_answer(g, question: str, query: str) -> DataFrame:
    """(kind, class, n): classes through the taxonomy edges; if there are none, what the question asks of the objects themselves."""
    edges = g["edge_belongs_to_class"].select("sequence_id", "track_id", F.col("name").alias("class")).distinct()
    if "BELONGS_TO_CLASS" in query and not edges.isEmpty():
        return edges.groupBy("class").agg(F.count(F.lit(1)).alias("n")).select(F.lit("direct").alias("kind"), "class", "n")
    kind, objects = taxonomy_fallback(question, query), g["node_object"].groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n") if kind == "counts" else F.lit(None).cast("long")
    out = objects.select(F.lit(kind or "").alias("kind"), "class", n.alias("n"))
    return out if kind else out.where("false")


def ascending(column: str):
    """The order of a graph query: nulls last."""
    return F.col(column).asc_nulls_last()


def descending(column: str):
    """The order of a graph query: nulls first."""
    return F.col(column).desc_nulls_first()


def union_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """UNION: the distinct rows of both."""
    return a.unionByName(b).distinct()


def track_frames(g, sequence_id: str, track_id: int, most: int = 5) -> DataFrame:
    e = in_sequence(g["edge_appeared_in"], sequence_id).where(F.col("track_id") == track_id)
    return e.select("frame_id").distinct().orderBy("frame_id").limit(most)


def frame_boxes(g, sequence_id: str, frame_id: int, tracks: list[int] | None = None) -> DataFrame:
    e = in_sequence(g["edge_appeared_in"], sequence_id).where(F.col("frame_id") == frame_id)
    e = e if not tracks else e.where(F.col("track_id").isin(*tracks))
    return e.select("track_id", "x1", "y1", "x2", "y2").orderBy("track_id")


def reach(edges: DataFrame, starts: DataFrame, start: str, end: str, low: int = 1, high: int | None = None) -> DataFrame:
    """(a, b, hops): from each node of ``starts`` (a column), all nodes on undirected walks of ``low`` to ``high`` edges, with the fewest edges.

    Breadth first: a round joins the nodes found last with the edges and drops what was found
    before, so cycles end and each pair is followed once; without ``high`` it runs until nothing is
    new.  Rounds are written as tables; the driver only sees whether one is empty.
    """
    both = write_once(edges.select(F.col(start).alias("b"), F.col(end).alias("to")).unionByName(edges.select(F.col(end).alias("b"), F.col(start).alias("to"))).distinct())
    (node,) = starts.columns
    at = write_once(starts.select(F.col(node).alias("a"), F.col(node).alias("b")).where(F.col("a").isNotNull()).distinct())
    found = [at.withColumn("hops", F.lit(0))] if low == 0 else []
    k = 0
    while (high is None or k < high) and at.head(1):
        k += 1
        step = at.join(both, "b").select("a", F.col("to").alias("b")).distinct()
        if found:
            step = step.join(reduce(DataFrame.unionByName, found).select("a", "b"), ["a", "b"], "left_anti")
        at = write_once(step)
        if k >= low:
            found.append(at.withColumn("hops", F.lit(k)))
    if not found:
        return at.where("false").withColumn("hops", F.lit(0))
    return reduce(DataFrame.unionByName, found)


def paths(edges: DataFrame, start: str, end: str, low: int, high: int | None) -> DataFrame:
    """``reach`` from every node that has an edge."""
    nodes = edges.select(F.col(start).alias("a")).union(edges.select(end)).distinct()
    return reach(edges, nodes, start, end, low, high)


def ranked(df: DataFrame, keys: list[str], order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
