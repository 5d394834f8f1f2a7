"""Stream rules over the registered tracks, against the oracles of the batch rules."""

from __future__ import annotations

from ..sources.adapter import CONFIG
from ..streaming import behaviour as B
from ..streaming.events import replay
from .oracles import sql
from .registry import _event, _kind, register, states


@register("stream_near_miss", _kind("NEAR_MISS"))
def _(spark, sf):
    return _event(replay(states(spark, sf), lambda s: B.near_miss(s, CONFIG)))


@register("stream_convoy", _kind("CONVOY"))
def _(spark, sf):
    return _event(replay(states(spark, sf), lambda s: B.convoy(s, CONFIG)))


@register("stream_crowd", _kind("CROWD_FORM"))
def _(spark, sf):
    return _event(replay(states(spark, sf), lambda s: B.crowd_form(s, CONFIG)))


@register("stream_jaywalking", _kind("JAYWALKING"))
def _(spark, sf):
    return _event(replay(states(spark, sf), lambda s: B.jaywalking(s, CONFIG)))


@register("stream_zone_visits", sql("""
SELECT sequence_id, track_id, zone_id, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(*) AS n_states FROM (
  SELECT *, sum(CASE WHEN frame_id - before > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id, track_id, zone_id ORDER BY frame_id) AS visit FROM (
    SELECT sequence_id, track_id, zone_id, frame_id, lag(frame_id) OVER (PARTITION BY sequence_id, track_id, zone_id ORDER BY frame_id) AS before FROM states))
GROUP BY sequence_id, track_id, zone_id, visit""", "states"))
def _(spark, sf):
    visits = replay(states(spark, sf), lambda s: B.zone_visits(s, gap=3).withColumn("frame_id", B.F.col("first_frame")))
    return visits.drop("frame_id")
