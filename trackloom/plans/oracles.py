"""DuckDB SQL for the parity queries, put together from named common table expressions."""

from __future__ import annotations

#: name -> (CTE body, names it needs)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "tracks": (
        """SELECT 'seq_' || (track_id // 50) AS sequence_id, track_id, frame_id, ['pedestrian','car','people','car','truck'][1 + (track_id % 50) % 5] AS class_name,
             px - 0.02::DOUBLE AS x1, py - 0.02::DOUBLE AS y1, px + 0.02::DOUBLE AS x2, py + 0.02::DOUBLE AS y2
           FROM (SELECT track_id, frame_id,
                   (((track_id % 50) * 97 + CASE WHEN track_id % 50 % 2 = 0 THEN 0 ELSE frame_id * 5 END) % 1000)::DOUBLE / 1000 AS px,
                   (((track_id % 50) * 53 + k % 3) % 1000)::DOUBLE / 1000 AS py
                 FROM (SELECT user_id AS track_id, CAST((epoch_us(ts) - 1704067200000000) // 43200000000 AS INTEGER) AS frame_id,
                         arg_max(json_extract_string(props, '$.k')::BIGINT, event_id) AS k FROM events GROUP BY 1, 2))""",
        (),
    ),
    "moves": (
        """SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM tracks""",
        ("tracks",),
    ),
    "steps": (
        """SELECT *, coalesce(cx - lag(cx) OVER w, 0) AS dx, coalesce(cy - lag(cy) OVER w, 0) AS dy FROM moves WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY frame_id)""",
        ("moves",),
    ),
    "speeds": (
        """SELECT *, sqrt(dx * dx + dy * dy) AS speed, CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE (degrees(atan2(dy, dx)) + 360) % 360 END AS heading_deg FROM steps""",
        ("steps",),
    ),
    "states": (
        """SELECT *, CASE WHEN avg(speed) OVER w < 0.003 THEN 'stationary' WHEN var_pop(heading_deg) OVER w > 800 THEN 'erratic' ELSE 'linear' END AS movement_pattern,
             'cell_' || CAST(least(trunc(cy * 4), 3) AS INTEGER) || '_' || CAST(least(trunc(cx * 4), 3) AS INTEGER) AS zone_id,
             CASE WHEN class_name IN ('pedestrian','people','bicycle','motor','tricycle','person') THEN 'pedestrian'
                  WHEN class_name IN ('car','van','truck','bus','awning-tricycle','motorcycle') THEN 'vehicle' END AS event_role
           FROM speeds WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY frame_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
        ("speeds",),
    ),
    "frames": (
        """SELECT sequence_id, frame_id, row_number() OVER w AS ordinal, lag(frame_id) OVER w AS previous
           FROM (SELECT DISTINCT sequence_id, frame_id FROM states) WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_id)""",
        ("states",),
    ),
    "zstats": (
        """SELECT sequence_id, frame_id, zone_id, p AS pedestrian_count, v AS vehicle_count, CAST(p + v AS DOUBLE) AS density,
             CASE WHEN p + v > 0 THEN p / (p + v) ELSE 0.0 END AS pedestrian_ratio, CASE WHEN p + v > 0 THEN v / (p + v) ELSE 0.0 END AS vehicle_ratio
           FROM (SELECT sequence_id, frame_id, zone_id, count(*) FILTER (WHERE event_role = 'pedestrian') AS p, count(*) FILTER (WHERE event_role = 'vehicle') AS v FROM states GROUP BY ALL)""",
        ("states",),
    ),
    "zlatest": (
        """SELECT s.* FROM zstats s JOIN (SELECT sequence_id, zone_id, max(frame_id) AS frame_id FROM zstats GROUP BY ALL) USING (sequence_id, zone_id, frame_id)""",
        ("zstats",),
    ),
    "objects": (
        """SELECT s.sequence_id, s.track_id, m.first_seen_frame, m.last_seen_frame, class_name AS class, cx, cy, speed, heading_deg AS heading, movement_pattern
           FROM states s JOIN (SELECT sequence_id, track_id, min(frame_id) AS first_seen_frame, max(frame_id) AS last_seen_frame FROM states GROUP BY ALL) m
             ON s.sequence_id = m.sequence_id AND s.track_id = m.track_id AND s.frame_id = m.last_seen_frame""",
        ("states",),
    ),
    "classes": (
        """SELECT unnest(['car','van','truck','bus']) AS name, 'MotorVehicle' AS class_group UNION ALL
           SELECT unnest(['pedestrian','people','person','bicycle','tricycle','awning-tricycle','motor','motorcycle']), 'VulnerableRoadUser'""",
        (),
    ),
    "hits": (
        """SELECT *, row_number() OVER (PARTITION BY sequence_id, a, b ORDER BY frame_id) AS n FROM (
             SELECT p.sequence_id, p.frame_id, p.track_id AS a, v.track_id AS b, sqrt((p.cx - v.cx) * (p.cx - v.cx) + (p.cy - v.cy) * (p.cy - v.cy)) AS distance
             FROM states p JOIN states v ON p.sequence_id = v.sequence_id AND p.frame_id = v.frame_id AND p.event_role = 'pedestrian' AND v.event_role = 'vehicle'
             WHERE greatest(p.speed, v.speed) > 0.004) WHERE distance < 0.05""",
        ("states",),
    ),
    "cool": (
        """SELECT sequence_id, a, b, n, frame_id, distance, frame_id AS fired, true AS fires FROM hits WHERE n = 1 UNION ALL
           SELECT h.sequence_id, h.a, h.b, h.n, h.frame_id, h.distance, CASE WHEN h.frame_id - c.fired >= 4 THEN h.frame_id ELSE c.fired END, h.frame_id - c.fired >= 4
           FROM cool c JOIN hits h ON h.sequence_id = c.sequence_id AND h.a = c.a AND h.b = c.b AND h.n = c.n + 1""",
        ("hits",),
    ),
    "loiter_flags": (
        """SELECT *, class_name IN ('pedestrian','people','person') AND movement_pattern = 'stationary' AS ok FROM states""",
        ("states",),
    ),
    "loiter_isles": (
        """SELECT *, sum(CASE WHEN keeps THEN 0 ELSE 1 END) OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) AS island FROM (
             SELECT *, coalesce(ok AND lag(ok) OVER w AND zone_id = lag(zone_id) OVER w, false) AS keeps FROM loiter_flags WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY frame_id))""",
        ("loiter_flags",),
    ),
    "loiter_runs": (
        """SELECT *, row_number() OVER (PARTITION BY sequence_id, track_id, island ORDER BY frame_id) AS run FROM loiter_isles""",
        ("loiter_isles",),
    ),
    "convoy_pairs": (
        """SELECT * FROM (
             SELECT a.sequence_id, a.frame_id, a.track_id AS a, b.track_id AS b, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS distance,
               least(abs(a.heading_deg - b.heading_deg) % 360, 360 - abs(a.heading_deg - b.heading_deg) % 360) AS heading_diff
             FROM states a JOIN states b ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id AND a.track_id < b.track_id AND a.class_name = b.class_name
             WHERE a.event_role = 'vehicle') WHERE distance >= 0.03 AND distance <= 0.12 AND heading_diff <= 20""",
        ("states",),
    ),
    "convoy_runs": (
        """SELECT *, row_number() OVER (PARTITION BY sequence_id, a, b, island ORDER BY ordinal) AS run FROM (
             SELECT c.*, f.ordinal, f.ordinal - row_number() OVER (PARTITION BY c.sequence_id, a, b ORDER BY f.ordinal) AS island
             FROM convoy_pairs c JOIN frames f ON c.sequence_id = f.sequence_id AND c.frame_id = f.frame_id)""",
        ("convoy_pairs", "frames"),
    ),
    "crowd_grid": (
        """SELECT g.sequence_id, g.frame_id, g.zone_id, last_value(density IGNORE NULLS) OVER w AS cur, first_value(density IGNORE NULLS) OVER w AS past
           FROM (SELECT z.sequence_id, f.frame_id, z.zone_id FROM (SELECT sequence_id, zone_id, min(frame_id) AS ff FROM zstats GROUP BY ALL) z
                 JOIN frames f ON z.sequence_id = f.sequence_id AND f.frame_id >= z.ff) g
           LEFT JOIN zstats s ON g.sequence_id = s.sequence_id AND g.frame_id = s.frame_id AND g.zone_id = s.zone_id
           WINDOW w AS (PARTITION BY g.sequence_id, g.zone_id ORDER BY g.frame_id RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)""",
        ("zstats", "frames"),
    ),
    "events_": (
        """SELECT 'NEAR_MISS' AS event_type, sequence_id, frame_id, a AS primary_track_id, b AS secondary_track_id, 1 - least(distance / 0.05, 1) AS confidence,
             NULL::VARCHAR AS zone_id, distance, NULL::DOUBLE AS heading_diff, NULL::DOUBLE AS density, NULL::DOUBLE AS vehicle_ratio FROM cool WHERE fires
           UNION ALL SELECT 'LOITER', sequence_id, frame_id, track_id, NULL, 1, zone_id, NULL, NULL, NULL, NULL FROM loiter_runs WHERE ok AND run = 5
           UNION ALL SELECT 'CONVOY', sequence_id, frame_id, a, b, 1, NULL, distance, heading_diff, NULL, NULL FROM convoy_runs WHERE run = 3
           UNION ALL SELECT 'CROWD_FORM', sequence_id, frame_id, -1, NULL, 1, zone_id, NULL, NULL, cur, NULL FROM crowd_grid WHERE cur >= 3 AND cur > 2 * past
           UNION ALL SELECT 'JAYWALKING', s.sequence_id, s.frame_id, s.track_id, NULL, z.vehicle_ratio, s.zone_id, NULL, NULL, NULL, z.vehicle_ratio
             FROM states s JOIN zstats z ON s.sequence_id = z.sequence_id AND s.frame_id = z.frame_id AND s.zone_id = z.zone_id
             WHERE s.class_name IN ('pedestrian','people','person') AND z.vehicle_ratio > 0.6""",
        ("cool", "loiter_runs", "convoy_runs", "crowd_grid", "zstats", "states"),
    ),
    "keyed": (
        """SELECT *, sequence_id || ':' || frame_id || ':' || event_type || ':' || primary_track_id || ':' || coalesce(CAST(secondary_track_id AS VARCHAR), 'None') AS event_key FROM events_""",
        ("events_",),
    ),
    "near_": (
        """SELECT DISTINCT ON (sequence_id, a, b) * FROM (
             SELECT a.sequence_id, a.frame_id, a.track_id AS a, b.track_id AS b, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d, a.speed > 0.001 AND b.speed > 0.001 AS both_moving
             FROM states a JOIN states b ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id AND a.zone_id = b.zone_id AND a.track_id < b.track_id) WHERE d < 0.08
           ORDER BY sequence_id, a, b, frame_id DESC""",
        ("states",),
    ),
    "parts": (
        """SELECT sequence_id, track_id * 10 + frame_id // 20 AS track_id, frame_id, class_name, cx, cy, heading_deg FROM states""",
        ("states",),
    ),
    "snaps": (
        """SELECT sequence_id, track_id, min(frame_id) AS f0, max(frame_id) AS f1, arg_max(class_name, frame_id) AS class, arg_min(cx, frame_id) AS fx, arg_min(cy, frame_id) AS fy,
             arg_max(cx, frame_id) AS lx, arg_max(cy, frame_id) AS ly, arg_max(heading_deg, frame_id) AS stored, count(*) AS n,
             list(cx ORDER BY frame_id) AS xs, list(cy ORDER BY frame_id) AS ys FROM parts GROUP BY ALL""",
        ("parts",),
    ),
    "snaps2": (
        """SELECT *, CASE WHEN n < 2 THEN stored WHEN xs[2] - xs[1] = 0 AND ys[2] - ys[1] = 0 THEN 0.0 ELSE (degrees(atan2(ys[2] - ys[1], xs[2] - xs[1])) + 360) % 360 END AS h_in,
             CASE WHEN n < 2 THEN stored WHEN xs[n] - xs[n-1] = 0 AND ys[n] - ys[n-1] = 0 THEN 0.0 ELSE (degrees(atan2(ys[n] - ys[n-1], xs[n] - xs[n-1])) + 360) % 360 END AS h_out FROM snaps""",
        ("snaps",),
    ),
    "compared": (
        """SELECT *, d < 0.10 AS spatial_ok, gap < 60 AS temporal_ok, hd < 45 AS heading_ok FROM (
             SELECT a.sequence_id, a.track_id AS track_a, b.track_id AS track_b, a.f0 AS a_first, b.f0 AS b_first, sqrt((a.lx - b.fx) * (a.lx - b.fx) + (a.ly - b.fy) * (a.ly - b.fy)) AS d,
               b.f0 - a.f1 AS gap, least(abs(a.h_out - b.h_in) % 360, 360 - abs(a.h_out - b.h_in) % 360) AS hd
             FROM snaps2 a JOIN snaps2 b ON a.sequence_id = b.sequence_id AND a.class = b.class AND a.f1 < b.f0 AND b.f0 - a.f1 < 60)""",
        ("snaps2",),
    ),
    "scored": (
        """SELECT *, CASE WHEN spatial_ok AND temporal_ok AND heading_ok THEN round(0.35::DOUBLE * greatest(0, least(1, 1 - d / 0.10::DOUBLE)) + 0.25::DOUBLE * greatest(0, least(1, 1 - gap / 60::DOUBLE))
             + 0.2::DOUBLE * greatest(0, least(1, 1 - hd / 45::DOUBLE)) + 0.2::DOUBLE, 9) ELSE 0 END AS confidence FROM compared""",
        ("compared",),
    ),
    "cands": ("SELECT * FROM scored WHERE confidence >= 0.7::DOUBLE", ("scored",)),
    "accepted": (
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, track_b ORDER BY a_first, track_a) AS claim FROM (
             SELECT *, row_number() OVER w AS rk, lead(confidence) OVER w AS nxt FROM cands WINDOW w AS (PARTITION BY sequence_id, track_a ORDER BY confidence DESC, b_first, track_b))
             WHERE rk = 1 AND (nxt IS NULL OR round(confidence - nxt, 9) > 0.05::DOUBLE)) WHERE claim = 1""",
        ("cands",),
    ),
    "messages": (
        """SELECT conv_id || ':' || turn AS message_id, 'seq_' || (conv_id % 3) AS sequence_id, coalesce(role, 'Unknown') AS sender,
             coalesce(text, '') || CASE conv_id % 4 WHEN 0 THEN ' Truck near the car' WHEN 1 THEN ' PEDESTRIAN ahead' ELSE '' END AS text, turn AS timestamp FROM conversations""",
        (),
    ),
    "found": (
        """SELECT DISTINCT message_id, sequence_id, unnest(regexp_extract_all(lower(text), '\\b(awning-tricycle|motorcycle|pedestrian|tricycle|bicycle|people|person|motor|truck|bus|car|van)\\b')) AS entity FROM messages""",
        ("messages",),
    ),
}


def sql(select: str, *names: str) -> str:
    """``select`` with the CTEs that it needs, in order."""
    done: list[str] = []

    def need(name: str) -> None:
        if name in done:
            return
        for x in CTES[name][1]:
            need(x)
        done.append(name)

    for n in names:
        need(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in done) + "\n" + select
