"""Reports of the four evaluations from payload files."""

import json

import pytest

from trackloom import report


def payload(tmp_path, **content):
    path = tmp_path / "payload.json"
    path.write_text(json.dumps(content, indent=1))
    return str(path)


def box(x):
    return [x, 0.0, x + 10.0, 10.0]


def test_detection(spark, tmp_path):
    truth = [{"image_id": f"i{k}", "class_id": 2, "bbox": box(10.0 * k)} for k in range(4)]
    path = payload(tmp_path, predictions=[{**t, "confidence": 0.9 - 0.1 * k} for k, t in enumerate(truth[:3])], ground_truths=truth)
    got = json.loads(report.main(["detection", path, "--out", str(tmp_path / "out.json")], spark))
    assert got["map_50"] == got["map_50_95"] == pytest.approx(0.75) and got["ap"]["2@0.95"] == pytest.approx(0.75)
    assert json.loads((tmp_path / "out.json").read_text()) == got


def test_tracking(spark, tmp_path):
    truth = [{"frame_id": f, "track_id": 1, "bbox": box(5.0 * f)} for f in range(5)]
    found = [{**t, "track_id": 7 if t["frame_id"] < 3 else 8} for t in truth]
    got = json.loads(report.main(["tracking", payload(tmp_path, predictions=found, ground_truths=truth)], spark))
    assert (got["matches"], got["id_switches"], got["mota"], got["motp"], got["switch_rate"]) == (5, 1, pytest.approx(0.8), 1.0, 1.0)


def test_events_of_many_payloads(spark, tmp_path):
    event = lambda f, s="s", t=4: {"event_type": "LOITER", "sequence_id": s, "frame_id": f, "primary_track_id": t, "secondary_track_id": None}
    one, two = {"predictions": [event(3), event(50)], "ground_truths": [event(4)]}, {"predictions": [event(9, "r")], "ground_truths": [event(9, "r"), event(70, "r")]}
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.json").write_text(json.dumps(one) + "\n" + json.dumps(two) + "\n")
    got = json.loads(report.main(["events", str(tmp_path / "many"), "--lines", "--tolerance", "1"], spark))
    assert (got["tp"], got["fp"], got["fn"]) == (2, 1, 1)
    strict = json.loads(report.main(["events", str(tmp_path / "many"), "--lines"], spark))
    assert (strict["tp"], strict["fp"], strict["fn"]) == (1, 2, 2)


def test_queries(spark, tmp_path):
    good, bad = "MATCH (o:Object) RETURN o.class", "MERGE (o:Object) RETURN o"
    cases = [
        {"first_attempt_cypher": good, "final_cypher": good, "expected_cypher": good, "expected_results": [{"n": 1}, {"n": 2}], "actual_results": [{"n": 2}, {"n": 1}]},
        {"first_attempt_cypher": bad, "final_cypher": good, "expected_cypher": good, "expected_results": [{"n": 1}], "actual_results": [{"n": 3}]},
    ]
    got = json.loads(report.main(["queries", payload(tmp_path, cases=cases)], spark))
    assert got == {"first_attempt_validity": 0.5, "final_validity": 1.0, "semantic_correctness": 0.5, "retry_rate": 0.5, "cases": 2}


def test_a_wrong_kind_is_refused(spark):
    with pytest.raises(SystemExit):
        report.main(["nothing", "x"], spark)
