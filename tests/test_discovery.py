"""Sequences found by listing, overlapping boxes over a grid, counts from the writes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trackloom.operators.neighbours import overlapping
from trackloom.sources import sequences as S, sinks


def make(top, name, frames, *, img1=False, ini=False, gt=None):
    at = top / name
    (at / "img1" if img1 else at).mkdir(parents=True)
    for k in frames:
        ((at / "img1" if img1 else at) / f"{k:07d}.jpg").write_bytes(b"x")
    if ini:
        (at / "seqinfo.ini").write_text("[Sequence]\n")
    if gt is not None:
        (at / "gt").mkdir()
        (at / "gt" / "gt.txt").write_text(gt)


def test_discovery_agrees_with_the_local_search(spark, tmp_path):
    make(tmp_path, "a", (1, 2, 3), ini=True)
    make(tmp_path, "sequences/a", (1,))  # root/a comes first
    make(tmp_path, "sequences/b", (1, 2), img1=True, gt="1,7,0,0,4,4,1,4,0,0\n2,7,0,0,4,4,1,4,0,0\nbroken\n")
    make(tmp_path, "y/sequences/c", (5, 6))
    make(tmp_path, "x/sequences/c", (8,), ini=True)  # the first in order
    make(tmp_path, "x/sequences/d", (1,), img1=True)
    (tmp_path / "x/sequences/d/0000009.jpg").write_bytes(b"x")  # beside img1: no frame
    make(tmp_path, "too/deep/sequences/e", (1,))
    (tmp_path / "notes.txt").write_text("no sequence")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        found = S.discover(spark, root)
        frames = {(r.sequence_id, r.path.rsplit("/", 1)[1]) for r in found.where("kind = 'frame'").collect()}
        assert frames == {("a", f"000000{k}.jpg") for k in (1, 2, 3)} | {("b", f"000000{k}.jpg") for k in (1, 2)} | {("c", "0000008.jpg"), ("d", "0000001.jpg")}
        assert {(r.sequence_id, r.kind) for r in found.where("kind <> 'frame'").collect()} == {("a", "ini"), ("c", "ini"), ("b", "gt")}
        for r in found.select("sequence_id", "root").distinct().collect():
            assert r.root.removeprefix("file:").replace("///", "/") == S.find_root(r.sequence_id, str(tmp_path))
    assert sorted((r.sequence_id, r.frame_id) for r in S.all_frames(spark, str(tmp_path), 2).collect()) == [("a", 0), ("a", 2), ("b", 0), ("c", 7), ("d", 0)]
    assert sorted((r.sequence_id, r.frame_id, r.track_id) for r in S.all_annotations(spark, str(tmp_path)).collect()) == [("b", 0, 7), ("b", 1, 7)]


def test_many_sequences_have_the_plan_of_one(spark, tmp_path):
    size = []
    for n in (1, 1000):
        top = tmp_path / f"n{n}"
        for k in range(n):
            make(top, f"sequences/s{k}", (1,), gt="1,7,0,0,4,4,1,4,0,0\n")
        both = S.all_annotations(spark, str(top))
        size.append(len(both._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert both.count() == n and S.all_frames(spark, str(top)).count() == n
    assert size[0] == size[1]


@pytest.mark.parametrize("cell", [0.03, 0.2, 1.5])
def test_overlapping_boxes_meet_once(spark, cell):
    rng = random.Random(6)
    box = lambda: (x := rng.uniform(-1, 1), y := rng.uniform(-1, 1), x + rng.choice((0.0, 0.05, 0.3, 1.1)), y + rng.choice((0.05, 0.2)))
    a, b = ([("s", rng.randint(0, 1), k, *box()) for k in range(40)] for _ in range(2))
    schema = "sequence_id string, frame_id int, pos long, x1 double, y1 double, x2 double, y2 double"
    got = [(r.a_pos, r.b_pos) for r in overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), cell, ("pos",)).collect()]
    want = [(p[2], q[2]) for p in a for q in b if p[1] == q[1] and max(p[3], q[3]) < min(p[5], q[5]) and max(p[4], q[4]) < min(p[6], q[6])]
    assert sorted(got) == sorted(want) and want


def test_a_crowded_image_costs_its_overlaps(spark):
    """2,000 boxes side by side: pairs before the overlap test stay near their number."""
    boxes = spark.range(2000).select(F.lit("s").alias("sequence_id"), F.lit(0).alias("frame_id"), F.col("id").alias("pos"), ((F.col("id") % 50) / 50).alias("x1"), (F.floor(F.col("id") / 50) / 40).alias("y1"))
    boxes = boxes.withColumns({"x2": F.col("x1") + 0.019, "y2": F.col("y1") + 0.024})
    met = overlapping(boxes, boxes, 0.025, ("pos",))
    assert met.count() == 2000
    join = next(p for p in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in p)
    assert "gx" in join and "gy" in join


def test_counts_come_from_the_writes(spark, tmp_path):
    states = spark.createDataFrame([("s", f, t) for f in range(4) for t in range(3)] + [("s", 0, 9)], "sequence_id string, frame_id int, track_id long")
    objects, events = states.select("sequence_id", "track_id").distinct(), states.where("track_id = 9")
    got = sinks.written_summary(states, objects, events, str(tmp_path / "run"), time.time())
    assert {k: v for k, v in got.items() if k.endswith("_count")} == {"frame_count": 4, "object_count": 4, "state_count": 13, "event_count": 1}
    assert got["peak_rss_mb"] > 0 and spark.read.parquet(str(tmp_path / "run" / "state")).count() == 13
    assert sinks.summary(states, events, time.time())["frame_count"] == 4


def test_an_unreadable_frame_is_an_error(spark, tmp_path):
    at = tmp_path / "q"
    at.mkdir()
    whole = b"\xff\xd8" + b"x" * 200 + b"\xff\xd9"
    for k, content in ((1, whole), (2, whole + b"\0" * 9), (3, b"\xff\xd8\xff\xd9")):
        (at / f"{k:07d}.jpg").write_bytes(content)
    assert S.frames(spark, str(at), "q", pixels=True, checked=True).select("content").count() == len(S.frames(spark, str(at), "q", pixels=True, checked=True).collect()) == 3
    for bad in (b"n", b"not a picture", whole[:100]):
        (at / "0000004.jpg").write_bytes(bad)
        with pytest.raises(Exception, match="unreadable frame.*0000004"):
            S.frames(spark, str(at), "q", pixels=True, checked=True).collect()
        assert S.frames(spark, str(at), "q", frame_skip=4, pixels=True, checked=True).count() == 1  # dropped before it is looked at
        assert len(S.frames(spark, str(at), "q").collect()) == 4
