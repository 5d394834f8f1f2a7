"""DuckDB oracles of the greedy matchers: each step takes the first acceptable candidate that is still free."""

from __future__ import annotations

from ..operators.evaluation import THRESHOLDS
from .oracles import CTES, sql
from .registry import ORACLES

AREA = "greatest(0, {0}.x2 - {0}.x1) * greatest(0, {0}.y2 - {0}.y1)"
BOTH = "greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1))"
IOU = f"({BOTH}) / ({AREA.format('p')} + {AREA.format('t')} - {BOTH})"

CTES["truths"] = (
    """SELECT *, CASE class_name WHEN 'car' THEN 1 WHEN 'truck' THEN 2 WHEN 'people' THEN 3 ELSE 0 END AS class_id, sequence_id || ':' || frame_id AS image_id FROM states""",
    ("states",),
)
CTES["preds"] = (
    """SELECT * REPLACE (x1 + (track_id * 7 + frame_id * 3) % 5 / 400 AS x1, x2 + (track_id * 7 + frame_id * 3) % 5 / 400 AS x2),
         (track_id * 13 + frame_id * 29) % 101 / 100 AS confidence FROM truths WHERE (track_id + frame_id) % 11 <> 0""",
    ("truths",),
)


def greedy(steps: str) -> str:
    """Body of a recursive table (g, k, used, hit) over ``steps`` (g, k, cands): candidates in the order of preference."""
    return f"""SELECT DISTINCT g, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS hit FROM {steps}
      UNION ALL SELECT g, k, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, hit FROM (
        SELECT s.g, s.k, d.used, list_filter(s.cands, lambda x: NOT list_contains(d.used, x))[1] AS hit FROM {steps}_done d JOIN {steps} s ON s.g = d.g AND s.k = d.k + 1)"""


# average precision: by confidence, the best overlapping truth of image and class
CTES["ap_pairs"] = (
    f"SELECT p.image_id, p.class_id, p.track_id AS p, t.track_id AS t, {IOU} AS iou FROM preds p JOIN truths t ON p.image_id = t.image_id AND p.class_id = t.class_id",
    ("preds", "truths"),
)
CTES["ap"] = (
    f"""SELECT p.image_id || '/' || p.class_id || '/' || th AS g, p.image_id, p.class_id, th, p.track_id, p.confidence,
          row_number() OVER (PARTITION BY p.image_id, p.class_id, th ORDER BY p.confidence DESC, p.track_id) AS k,
          coalesce((SELECT list(t ORDER BY iou DESC, t) FROM ap_pairs x WHERE x.image_id = p.image_id AND x.class_id = p.class_id AND x.p = p.track_id AND x.iou >= th), []) AS cands
        FROM preds p, (SELECT unnest({list(THRESHOLDS)}::DOUBLE[]) AS th)""",
    ("preds", "ap_pairs"),
)
CTES["ap_done"] = (greedy("ap"), ("ap",))
CTES["ap_class"] = (
    """SELECT c.class_id, c.th, CASE WHEN n_gt > 0 THEN coalesce(s, 0) / n_gt ELSE 0.0 END AS ap FROM
         (SELECT DISTINCT class_id, th FROM (SELECT class_id FROM truths UNION SELECT class_id FROM preds), (SELECT DISTINCT th FROM ap)) c
       LEFT JOIN (SELECT class_id, count(*) AS n_gt FROM truths GROUP BY ALL) n ON n.class_id = c.class_id
       LEFT JOIN (SELECT class_id, th, sum(CASE WHEN hit IS NULL THEN 0 ELSE tps / n END) AS s FROM (
         SELECT ap.class_id, ap.th, hit, count(hit) OVER w AS tps, count(*) OVER w AS n FROM ap JOIN ap_done d ON d.g = ap.g AND d.k = ap.k
         WINDOW w AS (PARTITION BY ap.class_id, ap.th ORDER BY confidence DESC, track_id, image_id ROWS UNBOUNDED PRECEDING)) GROUP BY ALL) h ON h.class_id = c.class_id AND h.th = c.th""",
    ("ap", "ap_done", "truths", "preds"),
)
ORACLES["a9_ap"] = sql("SELECT class_id, th AS threshold, round(ap, 6) AS ap FROM ap_class", "ap_class")
ORACLES["a10_map"] = sql("SELECT round(avg(ap) FILTER (WHERE th = 0.5::DOUBLE), 6) AS map_50, round(avg(ap), 6) AS map_50_95 FROM ap_class", "ap_class")

# tracking: pairs of a frame by overlap, later prediction and later truth first among equals
CTES["mt"] = (
    f"""SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, p DESC, t DESC) AS k FROM (
          SELECT p.image_id, p.sequence_id, p.frame_id, p.track_id AS p, t.track_id AS t, {IOU} AS iou FROM preds p JOIN truths t ON p.image_id = t.image_id) WHERE iou >= 0.5""",
    ("preds", "truths"),
)
CTES["mt_done"] = (
    """SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS ts, false AS hit FROM mt
       UNION ALL SELECT image_id, k, CASE WHEN hit THEN list_append(ps, p) ELSE ps END, CASE WHEN hit THEN list_append(ts, t) ELSE ts END, hit FROM (
         SELECT m.*, d.ps, d.ts, NOT list_contains(d.ps, m.p) AND NOT list_contains(d.ts, m.t) AS hit FROM mt_done d JOIN mt m ON m.image_id = d.image_id AND m.k = d.k + 1)""",
    ("mt",),
)
CTES["matched"] = ("SELECT m.*, lag(p) OVER (PARTITION BY sequence_id, t ORDER BY frame_id) AS before FROM mt m JOIN mt_done d ON d.image_id = m.image_id AND d.k = m.k WHERE hit", ("mt", "mt_done"))
ORACLES["a11_mota"] = sql(
    """SELECT m AS matches, nt - m AS misses, np - m AS false_positives, sw AS id_switches, round(1 - (nt - m + np - m + sw) / nt, 6) AS mota, round(motp, 6) AS motp, round(sw / greatest(1, tracks), 6) AS switch_rate
       FROM (SELECT count(*) AS m, CAST(coalesce(sum(CASE WHEN before <> p THEN 1 ELSE 0 END), 0) AS BIGINT) AS sw, avg(iou) AS motp FROM matched), (SELECT count(*) AS np FROM preds),
            (SELECT count(*) AS nt, count(DISTINCT (sequence_id, track_id)) AS tracks FROM truths)""",
    "matched", "preds", "truths",
)

# events: each prediction, in order, takes the first free truth of its key at most one frame away
CTES["ev_truth"] = (
    """SELECT event_type || '/' || sequence_id || '/' || primary_track_id || '/' || coalesce(CAST(secondary_track_id AS VARCHAR), '') AS g, frame_id,
         frame_id + CASE WHEN primary_track_id % 3 = 0 THEN 2 ELSE 0 END AS shifted,
         row_number() OVER (PARTITION BY event_type, sequence_id, primary_track_id, secondary_track_id ORDER BY frame_id) AS pos
       FROM events_ WHERE event_type IN ('NEAR_MISS', 'JAYWALKING')""",
    ("events_",),
)
CTES["em"] = (
    "SELECT p.g, p.pos AS k, coalesce((SELECT list(t.pos ORDER BY t.pos) FROM ev_truth t WHERE t.g = p.g AND abs(t.frame_id - p.shifted) <= 1), []) AS cands FROM ev_truth p",
    ("ev_truth",),
)
CTES["em_done"] = (greedy("em"), ("em",))
ORACLES["a12_event_prf"] = sql(
    """SELECT tp, n - tp AS fp, n - tp AS fn, round(tp / n, 6) AS precision, round(tp / n, 6) AS recall, round(tp / n, 6) AS f1
       FROM (SELECT count(hit) AS tp FROM em_done), (SELECT count(*) AS n FROM ev_truth)""",
    "em_done", "ev_truth",
)
