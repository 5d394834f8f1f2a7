"""Sources, writers and lifecycles on small inputs: paths, sizes, lookups, refusals, states of conditions."""

import json

import pytest
from pyspark.sql import functions as F

from trackloom import config
from trackloom.operators import lifecycle as L, reid, tracking
from trackloom.sources import sequences as S, sinks


def jpeg(width, height):
    size = height.to_bytes(2, "big") + width.to_bytes(2, "big")
    return bytes.fromhex("FFD8FFE000044A46FFC0001108") + size + bytes.fromhex("03012200021101031101")


def test_bundles_and_inferred_metadata(spark, tmp_path):
    root = tmp_path / "q1"
    (root / "gt").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        S.bundle("q1", str(tmp_path))
    for k in (2, 1):
        (root / f"{k:07d}.jpg").write_bytes(jpeg(100 + k, 50))
    (root / "gt" / "gt.txt").write_text("1,7,10,20,5,6,1,4,1,2\n1,8,0,0,1,1,1,0,0,0\n2,7,11,20,5,6,0,4,0,0\n2,9,1,2,3,4,1,10,0,1\nbroken\n")
    b = S.bundle("q1", str(tmp_path))
    assert b.image_dir == str(root) and b.ini is None and b.gt == str(root / "gt" / "gt.txt")
    frames = S.frames(spark, b.root, "q1", pixels=True)
    got = S.infer(S.with_size(frames)).head()
    assert (got.total_frames, got.frame_rate, got.frame_width, got.frame_height) == (2, 30, 101, 50)
    with pytest.raises(Exception, match="cannot read"):
        S.infer(S.with_size(frames.withColumn("content", F.lit(b"no jpeg")))).collect()
    a = {(r.frame_id, r.track_id): r for r in S.annotations(spark, {"q1": b.gt}).collect()}
    assert set(a) == {(0, 7), (1, 9)} and (a[0, 7].class_name, a[0, 7].class_group, a[0, 7].x2, a[0, 7].is_reliable) == ("car", "MotorVehicle", 15.0, False)
    assert a[1, 9].class_name == "motor" and a[1, 9].is_reliable


def test_seqinfo_of_many_sequences(spark):
    lines = [("a", i, x) for i, x in enumerate(("[Sequence]", "seqLength = 5", "frameRate=30", "imWidth=10", "imHeight=20", "[More]", "seqLength=9"))]
    df = lambda rows: spark.createDataFrame(rows, "sequence_id string, n int, value string")
    assert tuple(S.seqinfo_rows(df(lines)).head()) == ("a", 5, 30, 10, 20)
    for rows, why in ((lines[1:], "missing section"), (lines[:3] + lines[4:], "imWidth"), ([*lines[:3], ("a", 3, "imWidth=x"), *lines[4:]], "imWidth")):
        with pytest.raises(Exception, match=why):
            S.seqinfo_rows(df(rows)).collect()


def test_lookup_in_the_folders_above(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert S.meta_path(str(deep)) is None and S.meta_lookup(spark, None).count() == 0
    (tmp_path / S.META_FILE).write_text(json.dumps({"q1": {"altitude_m": 60, "weather": "foggy"}, "q2": 5, "q3": {}}))
    got = {r.sequence_id: (r.altitude_m, r.weather) for r in S.meta_lookup(spark, S.meta_path(str(deep))).collect()}
    assert got == {"q1": (60.0, "foggy"), "q3": (None, None)}
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        S.meta_lookup(spark, S.meta_path(str(deep), str(tmp_path / "list.json")))


def test_payloads(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"messages": []}))
    with pytest.raises(ValueError):
        S.messages(spark, str(p), "q1")
    p.write_text(json.dumps({"cases": [{"final_cypher": "x", "expected_results": [{"a": 1}], "actual_results": []}, {"first_attempt_cypher": "y"}]}))
    rows = S.evaluation_cases(spark, str(p)).orderBy("pos").collect()
    assert [(r.pos, r.final_cypher, r.first_attempt_cypher) for r in rows] == [(0, "x", None), (1, None, "y")] and json.loads(rows[0].expected_results[0]) == {"a": 1}
    with pytest.raises(ValueError):
        S.video_frames(spark.createDataFrame([("v.mp4", 0, 0.0)], "path string, frame_idx int, fps double"), 0)


def test_settings_from_a_file(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text('{"loiter": {"frames": 7}}')
    assert config.load(str(p)).loiter.frames == 7 and config.load(str(p)).convoy.frames == 45
    for bad in ("[1, 2]", '{"loiter": 3}', '{"nothing": {}}'):
        p.write_text(bad)
        with pytest.raises(ValueError):
            config.load(str(p))


def test_reports(tmp_path):
    text = sinks.report({"b": 1, "a": [2]}, str(tmp_path / "r.json"))
    assert json.loads(text) == json.loads((tmp_path / "r.json").read_text()) == {"a": [2], "b": 1}


def test_fields_and_their_fallbacks(spark):
    rows = [("s", 1, 0, 9, "car", None, 30.0, [(0.1, 0.2), (0.3, 0.4)])]
    df = spark.createDataFrame(rows, "sequence_id string, track_id long, first_seen_frame int, last_seen_frame int, class_name string, heading_at_exit double, heading_deg double, trajectory array<struct<cx:double,cy:double>>")
    r = reid.snapshot_fields(df).head()
    assert (r["class"], r.first_cx, r.last_cy, r.heading_at_entry, r.heading_at_exit) == ("car", 0.1, 0.4, 30.0, 30.0)
    for gone, why in (("heading_deg", "heading_at_entry"), ("class_name", "class"), ("trajectory", "first_cx")):
        with pytest.raises(Exception, match=f"track lacks {why}"):
            reid.snapshot_fields(df.drop(gone)).collect()


def test_lifecycle_of_a_condition(spark):
    frames = spark.createDataFrame([("s", f, f - 1 if f else None) for f in range(30)], "sequence_id string, frame_id int, previous int")
    held = {1: [0, 1, 2, 6, 7], 2: [0, 1, 5, 9], 3: [20, 21, 22, 29], 4: [24, 25, 26, 27], 5: [10, 29]}
    hits = spark.createDataFrame([("s", k, f) for k, fs in held.items() for f in fs], "sequence_id string, k long, frame_id int")
    got = {(r.k, r.valid_from): (r.valid_to, r.n_frames, r.state) for r in L.condition_states(hits, ["sequence_id", "k"], frames, "X", {"X": (3, 3)}).collect()}
    assert got == {
        (1, 0): (7, 5, "closed"), (2, 0): (9, 4, "closed"), (3, 20): (22, 3, "closed"), (3, 29): (None, 1, "candidate"),
        (4, 24): (None, 4, "interrupted"), (5, 10): (None, 1, "candidate"), (5, 29): (None, 1, "candidate"),
    }
    states = L.condition_states(hits, ["sequence_id", "k"], frames, "X", {"X": (3, 3)})
    closed = {(r.k, r.valid_from): (r.valid_to, r.state, r.is_active) for r in L.close(states, frames).collect()}
    assert closed[4, 24] == (29, "closed", False) and closed[1, 0] == (7, "closed", False) and closed[5, 10] == (None, "candidate", False)


def test_tracker_follows_a_fast_object(spark):
    a = tracking.Associator()
    import numpy as np

    box = lambda x: np.array([[x, 0.0, x + 10, 10.0]])
    ids = [next(iter(a.update(f, box(x), np.array([0.9]))[0].values())) for f, x in enumerate((0, 4, 10, 18, 28, 39, 51))]
    assert set(ids) == {1}  # from the fourth frame on, boxes hardly overlap without the velocity
    with pytest.raises(KeyError):
        tracking.infer(spark.createDataFrame([("s", 1)], "sequence_id string, frame_id int"), lambda: None)


def test_frame_buffer_writes_batches_and_the_rest(spark, tmp_path):
    part = lambda f: spark.createDataFrame([(f,)], "frame_id int")
    put = lambda df: df.write.mode("append").parquet(str(tmp_path / "t"))
    with pytest.raises(KeyError), sinks.FrameBuffer(put, str(tmp_path / "dead"), batch_frames=3) as b:
        for f in range(7):
            b.add(part(f))
        assert b.flushes == 2
        raise KeyError("the run breaks off")
    assert b.flushes == 3 and {r.frame_id for r in spark.read.parquet(str(tmp_path / "t")).collect()} == set(range(7))

    def fails(df):
        raise OSError("away")

    with pytest.raises(OSError), sinks.FrameBuffer(fails, str(tmp_path / "dead")) as b:
        b.add(part(8), 2)
    assert [r.frame_id for r in spark.read.schema("frame_id int").json(str(tmp_path / "dead")).collect()] == [8] and not b.parts
