"""The property graph as node and edge tables; upserts are last-write-wins aggregations."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import CLASS_GROUPS, DEFAULT, Config
from ..functions import geometry as G
from ..sources.shared import write_once
from . import events as E
from .neighbours import within


def class_nodes(spark: SparkSession) -> DataFrame:
    """(name, class_group): a fixed dimension of twelve rows."""
    return spark.createDataFrame([(n, g) for g, names in CLASS_GROUPS.items() for n in names], "name string, class_group string")


def scene_nodes(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    s = cfg.scene
    return states.groupBy("sequence_id").agg(F.countDistinct("frame_id").alias("total_frames")).select(
        "sequence_id", F.lit(s.altitude_m).alias("altitude_m"), F.lit(s.weather).alias("weather"), F.lit(s.scene_type).alias("scene_type"), F.lit(s.time_of_day).alias("time_of_day"), "total_frames"
    )


def object_nodes(states: DataFrame) -> DataFrame:
    """First frame on creation; everything else from the last observation."""
    cols = {"class_name": "class", "cx": "cx", "cy": "cy", "speed": "speed", "heading_deg": "heading", "movement_pattern": "movement_pattern", "occlusion": "occlusion"}
    o = states.groupBy("sequence_id", "track_id").agg(
        F.min("frame_id").alias("first_seen_frame"), F.max("frame_id").alias("last_seen_frame"), F.max_by(F.struct(*(F.col(k).alias(v) for k, v in cols.items())), "frame_id").alias("o")
    )
    return o.select("sequence_id", "track_id", "first_seen_frame", "last_seen_frame", "o.*", F.lit("active").alias("status"))


def in_zone(states: DataFrame) -> DataFrame:
    return states.select("sequence_id", "track_id", "zone_id", "frame_id", F.lit(1).alias("density_contribution")).distinct()


def appeared_in(states: DataFrame) -> DataFrame:
    return states.select("sequence_id", "track_id", "frame_id", "cx", "cy", "x1", "y1", "x2", "y2")


def detected_in(states: DataFrame) -> DataFrame:
    return states.select("sequence_id", "track_id").distinct()


def belongs_to_class(states: DataFrame, classes: DataFrame) -> DataFrame:
    """One edge for every class an object ever had, if the class is known."""
    seen = states.select("sequence_id", "track_id", F.col("class_name").alias("name")).distinct()
    return seen.join(F.broadcast(classes), "name").select("sequence_id", "track_id", "name", "class_group")  # twelve rows


def precedes(frames: DataFrame) -> DataFrame:
    return frames.where("previous is not null").select("sequence_id", F.col("previous").alias("from_frame"), F.col("frame_id").alias("to_frame"))


def near_pairs(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Pairs of one frame (and one zone, unless configured otherwise) closer than the limit."""
    g = cfg.graph
    if not g.same_zone_only:
        return near_pairs_any_zone(states, cfg)
    keys = ["sequence_id", "frame_id", "zone_id"]
    side = lambda s: states.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in ("track_id", "cx", "cy", "speed")))
    return _near(side("a").join(side("b").hint("merge"), keys), cfg)


def _near(pairs: DataFrame, cfg: Config) -> DataFrame:
    g = cfg.graph
    p = pairs.where("a_track_id < b_track_id").withColumn("d", G.distance(F.col("a_cx"), F.col("a_cy"), F.col("b_cx"), F.col("b_cy"))).where(F.col("d") < g.near)
    moving = (F.col("a_speed") > g.moving_speed) & (F.col("b_speed") > g.moving_speed)
    return p.select("sequence_id", "frame_id", "a_track_id", "b_track_id", F.bround("d", 6).alias("distance"), moving.alias("both_moving"))


def near_pairs_any_zone(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """All neighbours in a frame, across zones."""
    return _near(within(states, states, cfg.graph.near, ("track_id", "speed")).drop("distance"), cfg)


def last_write(df: DataFrame, keys: list[str], values: list[str], by: str = "frame_id") -> DataFrame:
    """One row per key with the values of its last frame."""
    out = df.groupBy(*keys).agg(F.max_by(F.struct(by, *values), by).alias("s"))
    return out.select(*keys, "s.*")


def near(states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return last_write(near_pairs(states, cfg), ["sequence_id", "a_track_id", "b_track_id"], ["distance", "both_moving"])


def event_nodes(events: DataFrame) -> DataFrame:
    """Event nodes are unique by key and zone, so ingesting a sequence again cannot double them."""
    out = E.metadata_json(E.keyed(events)).select("event_key", "event_type", "frame_id", "sequence_id", "confidence", "primary_track_id", "secondary_track_id", "zone_id", "metadata_json")
    return out.dropDuplicates(["event_key", "zone_id"])


def occurred_in(events: DataFrame, frames: DataFrame) -> DataFrame:
    keyed = E.keyed(events).select("sequence_id", "frame_id", "event_key").distinct()
    return keyed.join(frames.select("sequence_id", "frame_id").hint("merge"), ["sequence_id", "frame_id"], "left_semi")


def involves(events: DataFrame, objects: DataFrame) -> DataFrame:
    """(event, object, role); an event whose track is no object (a crowd's -1) gets no edge."""
    k = E.keyed(events)
    both = k.select("sequence_id", "event_key", F.explode(F.array(
        F.struct(F.lit("primary").alias("role"), F.col("primary_track_id").alias("track_id")), F.struct(F.lit("secondary").alias("role"), F.col("secondary_track_id").alias("track_id"))
    )).alias("r")).select("sequence_id", "event_key", "r.role", "r.track_id").where("track_id is not null").distinct()
    return both.join(objects.select("sequence_id", "track_id").hint("merge"), ["sequence_id", "track_id"], "left_semi").select("sequence_id", "event_key", "track_id", "role")


def _of(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).withColumnsRenamed({"primary_track_id": "a_track_id", "secondary_track_id": "b_track_id"})


def near_miss_edges(events: DataFrame) -> DataFrame:
    return last_write(_of(events, "NEAR_MISS"), ["sequence_id", "a_track_id", "b_track_id"], ["distance"])


def convoy_edges(events: DataFrame) -> DataFrame:
    """Both directions."""
    one = last_write(_of(events, "CONVOY").withColumn("avg_distance", F.col("distance")), ["sequence_id", "a_track_id", "b_track_id"], ["avg_distance"])
    back = one.select("sequence_id", F.col("b_track_id").alias("a_track_id"), F.col("a_track_id").alias("b_track_id"), "frame_id", "avg_distance")
    return one.unionByName(back)


def loitering_edges(events: DataFrame) -> DataFrame:
    e = _of(events, "LOITER").groupBy("sequence_id", F.col("a_track_id").alias("track_id"), "zone_id").agg(F.max("frame_id").alias("frame_id"))
    return e


def jaywalking_edges(events: DataFrame) -> DataFrame:
    return last_write(_of(events, "JAYWALKING").withColumnRenamed("a_track_id", "track_id"), ["sequence_id", "track_id", "zone_id"], ["vehicle_ratio"])


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table partitioned by sequence, replacing only the sequences it holds: writing again doubles nothing.

    Rows are brought together by sequence first, large ones in several parts, so a sequence is
    a few files and not one from every task.
    """
    for name, df in tables.items():
        scoped = "sequence_id" in df.columns
        out = (df.hint("rebalance", "sequence_id") if scoped else df).write.mode("overwrite")
        if scoped:
            out = out.option("partitionOverwriteMode", "dynamic").partitionBy("sequence_id")
        out.parquet(f"{path}/{name}")


class Tables(Mapping):
    """All node and edge tables of a set of object states, each planned when it is asked for.

    What depends on events shares the states (without trajectories) and the events, each
    written once, so no rule or edge plans the scan and the windows again.
    """

    def __init__(self, states: DataFrame, cfg: Config = DEFAULT):
        from . import motion, zones

        s, z, ev = (lambda: self.states), (lambda: self.stats), (lambda: self.events)
        self._lazy, self._cfg, self._done = states, cfg, {}
        frames = lambda: motion.frames(self.states)
        self._plans: dict[str, Callable[[], DataFrame]] = {
            "node_scene": lambda: scene_nodes(s(), cfg), "node_frame": lambda: frames().select("sequence_id", "frame_id"), "node_object": lambda: object_nodes(s()),
            "node_zone": lambda: zones.nodes(z(), s()), "node_event": lambda: event_nodes(ev()), "node_object_class": lambda: class_nodes(states.sparkSession),
            "edge_in_zone": lambda: in_zone(s()), "edge_appeared_in": lambda: appeared_in(s()), "edge_detected_in": lambda: detected_in(s()),
            "edge_belongs_to_class": lambda: belongs_to_class(s(), self["node_object_class"]), "edge_precedes": lambda: precedes(frames()), "edge_near": lambda: near(s(), cfg),
            "edge_occurred_in": lambda: occurred_in(ev(), frames()), "edge_involves": lambda: involves(ev(), self["node_object"]), "edge_near_miss": lambda: near_miss_edges(ev()),
            "edge_convoy_with": lambda: convoy_edges(ev()), "edge_loitering_in": lambda: loitering_edges(ev()), "edge_jaywalking_in": lambda: jaywalking_edges(ev()),
        }

    @cached_property
    def written(self) -> DataFrame:
        return write_once(self._lazy.drop("trajectory"))

    @property
    def states(self) -> DataFrame:
        return self.__dict__.get("written", self._lazy)

    @property
    def stats(self) -> DataFrame:
        from . import zones

        return zones.frame_stats(self.states, self._cfg)

    @cached_property
    def events(self) -> DataFrame:
        return write_once(E.all_events(self.written, self._cfg))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._done:
            self._done[name] = self._plans[name]()
        return self._done[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)

    def changed(self, **tables: DataFrame) -> Mapping[str, DataFrame]:
        """These tables with some replaced; the others are still planned only when asked for."""
        return ChainMap(tables, self)


def build(states: DataFrame, cfg: Config = DEFAULT) -> Tables:
    return Tables(states, cfg)
