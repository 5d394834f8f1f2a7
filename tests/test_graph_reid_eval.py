"""Graph edges, re-identification, metrics, tracker, sources and question answering on literal fixtures."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from trackloom.config import DEFAULT
from trackloom.functions import text as T
from trackloom.operators import evaluation as V, graph, messages as M, motion, reid, tracking
from trackloom.plans import digest, language, traversals as Q
from trackloom.sources import sequences as S

SNAP = "sequence_id string, track_id long, first_seen_frame int, last_seen_frame int, class string, first_cx double, first_cy double, last_cx double, last_cy double, heading_at_entry double, heading_at_exit double, trajectory array<struct<cx:double,cy:double>>"


def snap(track, f0, f1, first, last, h_in, h_out, cls="car", points=None):
    return ("s", track, f0, f1, cls, *first, *last, h_in, h_out, points or [first, last])


def test_snapshots(spark):
    rows = [("s", 10, 1, "car", 15.0, 0.1, 0.1), ("s", 10, 2, "car", 15.0, 0.2, 0.1), ("s", 11, 5, "car", 20.0, 0.25, 0.1), ("s", 11, 6, "bus", 20.0, None, None)]
    out = {r.track_id: r for r in reid.snapshots(spark.createDataFrame(rows, "sequence_id string, track_id long, frame_id int, class_name string, heading_deg double, cx double, cy double")).collect()}
    assert (out[10].first_seen_frame, out[10].last_seen_frame, out[10].heading_at_entry, out[10].heading_at_exit) == (1, 2, 0.0, 0.0)
    assert (out[11]["class"], out[11].heading_at_exit, len(out[11].trajectory)) == ("bus", 20.0, 1)


def resolve(spark, snaps):
    return {k: [r.asDict() for r in v.collect()] for k, v in reid.resolve(spark.createDataFrame(snaps, SNAP)).items()}


def test_reid_accepts_and_rejects(spark):
    got = resolve(spark, [snap(10, 0, 100, (0.1, 0.3), (0.30, 0.30), 15.0, 15.0), snap(11, 110, 180, (0.31, 0.30), (0.5, 0.3), 18.0, 18.0)])
    (e,) = got["same_entity_as"]
    assert e["resolved_at_frame"] == 110 and e["confidence"] > 0.7
    assert {(r["track_id"], r["canonical_id"]) for r in got["canonical"]} == {(10, 10), (11, 10)}
    assert not resolve(spark, [snap(1, 0, 40, (0.1, 0.1), (0.1, 0.1), 0.0, 0.0), snap(2, 50, 80, (0.1, 0.1), (0.1, 0.1), 0.0, 0.0, "bus")])["same_entity_as"]


def test_reid_ambiguity_and_coexistence(spark):
    got = resolve(spark, [snap(30, 0, 100, (0.3, 0.3), (0.32, 0.31), 0.0, 0.0), snap(31, 120, 150, (0.33, 0.31), (0.4, 0.4), 0.0, 0.0), snap(32, 122, 160, (0.34, 0.31), (0.5, 0.5), 0.0, 0.0)])
    assert not got["same_entity_as"] and {r["track_b"] for r in got["ambiguous"]} == {31, 32}
    (c,) = resolve(spark, [snap(20, 10, 40, (0.1, 0.1), (0.2, 0.1), 0.0, 0.0), snap(21, 25, 55, (0.11, 0.1), (0.9, 0.9), 0.0, 0.0, "bus")])["coexists_with"]
    assert (c["overlap_start"], c["overlap_end"], c["overlap_frames"]) == (25, 40, 16) and c["min_distance_ever"] < 0.02


def greedy(snaps):
    """Sequential acceptance over tracks in order of appearance."""
    def conf(a, b):
        d = ((a[7] - b[5]) ** 2 + (a[8] - b[6]) ** 2) ** 0.5
        gap, hd = b[2] - a[3], abs(a[10] - b[9]) % 360
        hd = min(hd, 360 - hd)
        if not (a[4] == b[4] and gap > 0 and d < 0.1 and gap < 60 and hd < 45):
            return 0
        return round(0.35 * (1 - d / 0.1) + 0.25 * (1 - gap / 60) + 0.2 * (1 - hd / 45) + 0.2, 9)

    taken, out = set(), set()
    for a in sorted(snaps, key=lambda x: (x[2], x[1])):
        cands = sorted(((-conf(a, b), b[2], b[1]) for b in snaps if conf(a, b) >= 0.7))
        if cands and (len(cands) == 1 or round(cands[1][0] - cands[0][0], 9) > 0.05) and cands[0][2] not in taken:
            taken.add(cands[0][2])
            out.add((a[1], cands[0][2]))
    return out


def test_reid_equals_sequential_rules(spark):
    rng, all_snaps, want = random.Random(7), [], {}
    for scene in range(25):
        snaps = []
        for t in range(14):
            f0 = rng.randrange(0, 200)
            p = (0.5 + rng.randrange(6) / 100, 0.5)
            q = (0.5 + rng.randrange(6) / 100, 0.5)
            snaps.append((f"s{scene}", t, f0, f0 + rng.randrange(1, 60), rng.choice(["car", "bus"]), *p, *q, float(rng.randrange(30)), float(rng.randrange(30)), [p, q]))
        want[f"s{scene}"] = greedy(snaps)
        all_snaps += snaps
    acc = reid.resolve(spark.createDataFrame(all_snaps, SNAP))["same_entity_as"].collect()
    got = {k: set() for k in want}
    for r in acc:
        got[r.sequence_id].add((r.track_a, r.track_b))
    assert got == want


def boxes(rows, kind):
    return [(i, c, k, *map(float, b), *([conf] if kind == "p" else [])) for k, (i, c, b, *conf_) in enumerate(rows) for conf in (conf_ or [None])]


def test_detection_metrics(spark):
    gt = [("a", 0, [0, 0, 10, 10]), ("a", 0, [20, 20, 30, 30]), ("b", 1, [0, 0, 10, 10])]
    schema = "image_id string, class_id int, pos long, x1 double, y1 double, x2 double, y2 double"
    t = spark.createDataFrame(boxes(gt, "t"), schema)
    p = spark.createDataFrame(boxes([(*g, 0.9) for g in gt], "p"), schema + ", confidence double")
    assert [r.ap for r in V.average_precision(p, t).collect()] == [1.0] * 20
    q = spark.createDataFrame(boxes([("a", 0, [0, 0, 10, 10], 0.5), ("a", 0, [50, 50, 60, 60], 0.9), ("z", 7, [0, 0, 1, 1], 0.9)], "p"), schema + ", confidence double")
    ap = {(r.class_id, r.threshold): r.ap for r in V.average_precision(q, t).collect()}
    assert (ap[0, 0.5], ap[1, 0.5], ap[7, 0.5]) == (0.25, 0.0, 0.0)
    assert abs(V.mean_average_precision(V.average_precision(q, t)).head().map_50 - 0.25 / 3) < 1e-9


def test_tracking_metrics(spark):
    schema = "sequence_id string, frame_id int, track_id long, pos long, x1 double, y1 double, x2 double, y2 double"
    t = spark.createDataFrame([("s", f, 1, 0, 0.0, 0.0, 10.0, 10.0) for f in (1, 2)], schema)
    p = spark.createDataFrame([("s", 1, 5, 0, 0.0, 0.0, 10.0, 10.0), ("s", 2, 6, 0, 0.0, 0.0, 10.0, 10.0)], schema)
    r = V.tracking_metrics(p, t).head()
    assert (r.mota, r.motp, r.id_switches, r.switch_rate) == (0.5, 1.0, 1, 1.0)


def test_event_and_query_metrics(spark):
    schema = "event_type string, sequence_id string, primary_track_id long, secondary_track_id long, frame_id int, pos long"
    t = spark.createDataFrame([("NEAR_MISS", "s", 1, 2, 10, 0)], schema)
    p = spark.createDataFrame([("NEAR_MISS", "s", 1, 2, 11, 0), ("NEAR_MISS", "s", 1, None, 10, 1)], schema)
    r = V.event_metrics(p, t, 1).head()
    assert (r.precision, r.recall, round(r.f1, 4)) == (0.5, 1.0, 0.6667)
    none = V.event_metrics(p.limit(0), t.limit(0)).head()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
    cases = spark.createDataFrame([(False, True, True, True), (True, True, True, False)], "first_valid boolean, final_valid boolean, results_equal boolean, retried boolean")
    q = V.query_metrics(cases).head()
    assert (q.first_attempt_validity, q.final_validity, q.semantic_correctness, q.retry_rate, q.cases) == (0.5, 1, 1, 0.5, 2)
    a = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert V.same_rows(a, a.orderBy(F.desc("x"))) and not V.same_rows(a, a.distinct())
    with pytest.raises(ValueError):
        V.calibrate(spark.createDataFrame([], "f1 double, precision double, recall double, pos int"))


def test_tracker_new_lost_and_empty_frames(spark):
    det = lambda f, k, x, c=0.9: ("s", f, k, "car", x, 0.0, x + 10.0, 10.0, c)
    rows = [det(0, 0, 0.0), det(1, 0, 1.0), det(1, 1, 50.0), det(2, 0, 51.0), det(4, 0, 52.0), det(4, 1, 90.0, 0.2)]
    df = spark.createDataFrame(rows, "sequence_id string, frame_id int, pos long, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double")
    out = tracking.track(df).orderBy("frame_id", "track_id").collect()
    assert [(r.frame_id, r.track_id, r.is_new, r.is_lost) for r in out] == [(0, 1, True, False), (1, 1, False, False), (1, 2, True, False), (2, 1, False, True), (2, 2, False, False), (4, 2, False, False)]
    assert tracking.active(tracking.track(df)).count() == 5


def test_detection_formatting_and_suppression(spark):
    raw = spark.createDataFrame([("i", 12, [[10.0, 20.0, 30.0, 40.0], [50.0, 60.0, 70.0, 80.0], [0.0] * 4], [0.9, 0.75], [0, 3, 3])], "image_id string, frame_id int, xyxy array<array<double>>, conf array<double>, cls array<int>")
    out = tracking.format_detections(raw, {0: "pedestrian", 3: "car"}).orderBy("pos").collect()
    assert [(r.class_name, r.confidence, r.x2, r.occlusion) for r in out] == [("pedestrian", 0.9, 30.0, 0), ("car", 0.75, 70.0, 0)]
    d = spark.createDataFrame([("i", "car", k, 0.0 + s, 0.0, 10.0 + s, 10.0, c) for k, s, c in ((0, 0.0, 0.5), (1, 1.0, 0.9), (2, 40.0, 0.4))], "image_id string, class_name string, pos long, x1 double, y1 double, x2 double, y2 double, confidence double")
    assert {r.pos for r in tracking.suppress(d).collect()} == {1, 2}


def test_text_rules():
    ok = "MATCH (o:Object) RETURN o.class"
    assert T.validate_query(ok) == (True, None)
    for bad in ("", "MATCH (o) SET o.x = 1 RETURN o", "MATCH (o) RETURN o GROUP BY o", "MATCH (o {is_active: 1}) RETURN o", "SHOW x RETURN y", "MATCH (o)", ok + ";", "MATCH (o RETURN o.class"):
        assert not T.validate_query(bad)[0], bad
    q = "MATCH (o) WHERE o.class IN ['person'] RETURN o"
    assert T.expand_aliases("how many people", q).count("'") == 6
    assert T.expand_aliases("how many cars", q) == q
    assert T.expand_aliases("how many cars", q, literal=True).count("'") == 6  # "many" contains "man"


def test_graph_has_no_doubles_and_questions_work(spark, tmp_path):
    rows = [("s", t, f, c, x, 0.1, x + 0.04, 0.14, 1.0, 1.0, 0) for f in range(6) for t, c, x in ((1, "pedestrian", 0.1), (2, "car", 0.12 + f / 100))]
    df = spark.createDataFrame(rows, "sequence_id string, track_id long, frame_id int, class_name string, x1 double, y1 double, x2 double, y2 double, frame_width double, frame_height double, occlusion int")
    g = graph.build(motion.enrich(df))
    g = {k: v.cache() for k, v in g.items()}
    for _ in range(2):
        graph.write({"node_event": g["node_event"], "node_object": g["node_object"]}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/node_event").count() == g["node_event"].count() == 1
    assert g["edge_near_miss"].count() == 1 and {r["class"] for r in Q.class_inventory(g).collect()} == {"car", "pedestrian"}
    assert [r.hops for r in Q.paths(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), "a", "b", 0, 2).where("a = 1").orderBy("b").collect()] == [0, 1, 2]
    language.register_views(g)
    r = language.ask(spark, "Were there near misses?", "s")
    assert r.error is None and r.rows.count() == 1 and r.answer.startswith("1 rows")
    assert language.ask(spark, "any convoys?", "s").answer == language.NO_DATA

    class Bad:
        def __init__(self):
            self.asked = []

        def generate(self, system, prompt):
            self.asked.append(prompt)
            return "DROP TABLE node_object" if len(self.asked) < 3 else "```sql\nSELECT track_id FROM node_object WHERE sequence_id = :seq\n```"

    bad = Bad()
    r = language.ask(spark, "objects", "s", bad)
    assert r.attempts == 3 and r.rows.count() == 2 and "only queries" in bad.asked[1]
    steps = iter(['{"action": "QUERY", "action_input": "events"}', 'text {"action": "dance"} more', "done"])
    actions = [s["action"] for s in language.Reasoner(lambda q, m: next(steps), spark, "s").run("what happened")]
    assert actions == ["QUERY", "SUMMARIZE", "INFER", "FINAL_ANSWER"]
    assert language.visual_targets([{"frame_id": 12, "track_a": 7, "n": 3}, {"frame_id": 10, "track_a": -1}]) == {"frames": [10, 12], "tracks": [7], "sequences": []}
    assert language.chart_spec(Q.class_counts(g).drop("sequence_id")) == {"x": "class", "y": "n"}
    d = digest.summary(spark.range(20).withColumn("b", F.lit(True)))
    assert d["rows"] == 20 and d["values"]["id"][-1] == "+10 more" and d["numbers"]["b"] == (1.0, 1.0, 1.0)


def test_sources(spark, tmp_path):
    root = tmp_path / "x" / "sequences" / "q1" / "img1"
    root.mkdir(parents=True)
    for k in range(1, 6):
        (root / f"{k:07d}.jpg").write_bytes(b"x")
    found = S.find_root("q1", str(tmp_path))
    assert [r.frame_id for r in S.frames(spark, found, "q1", 2).orderBy("frame_id").collect()] == [0, 2, 4]
    with pytest.raises(FileNotFoundError):
        S.find_root("nope", str(tmp_path))
    with pytest.raises(ValueError):
        S.frames(spark, found, "q1", 0)
    ini = tmp_path / "seqinfo.ini"
    ini.write_text("[Sequence]\nname=q1\nframeRate=30\nseqLength=5\nimWidth=1360\nimHeight=765\n")
    assert S.seqinfo(spark, str(ini)) == {"frameRate": 30, "seqLength": 5, "imWidth": 1360, "imHeight": 765}
    ini.write_text("[Sequence]\nframeRate=30\n")
    with pytest.raises(ValueError, match="imWidth"):
        S.seqinfo(spark, str(ini))
    m = tmp_path / "m.json"
    for data, want in ((["a", "b"], ["a", "b"]), ({"sequence_ids": ["c"]}, ["c"])):
        m.write_text(json.dumps(data))
        assert S.manifest(str(m)) == want
    m.write_text(json.dumps({"sequences": ["a"]}))
    with pytest.raises(ValueError):
        S.manifest(str(m))
    seq = spark.createDataFrame([("q1", 5, None, 1360, 765, "d/train/q1", False)], "sequence_id string, total_frames int, frame_rate int, frame_width int, frame_height int, path string, annotated boolean")
    look = spark.createDataFrame([("q1", 60.0, None, None, None)], "sequence_id string, altitude_m double, weather string, scene_type string, time_of_day string")
    r = S.scenes(seq, look).head()
    assert (r.altitude_m, r.altitude_source, r.weather, r.weather_source, r.split, r.frame_rate) == (60.0, "lookup", "clear", "default", "train", 30)
    assert S.scenes(seq).head().altitude_source == "estimated"
    msgs = tmp_path / "msgs.json"
    msgs.write_text(json.dumps([{"message_id": "1", "text": "A Car and a truck", "timestamp": 5}, {"message_id": "2", "text": None}]))
    got = M.normalise(S.messages(spark, str(msgs), "q1"))
    assert {(r.message_id, r.sender, r.timestamp) for r in got.collect()} == {("1", "Unknown", 5), ("2", "Unknown", 0)}
    assert {r.entity for r in M.entities(got).collect()} == {"car", "truck"}
    pay = tmp_path / "pay.json"
    pay.write_text(json.dumps({"predictions": [{"a": 1}, {"a": 2}], "ground_truths": []}))
    p, t = S.evaluation(spark, str(pay), "a:int")
    assert (p.count(), t.count()) == (2, 0)


def test_entry_contract():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "q3_zone_density" in q
    assert all(isinstance(s, str) for s in itertools.chain(q, o)) and DEFAULT.graph.batch_frames == 30
