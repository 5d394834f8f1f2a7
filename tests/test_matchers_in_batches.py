"""Matchers and suppression over batches that cut groups, against plain loops over each group; no call for each group."""

import random
from contextlib import contextmanager

import pytest

from trackloom.config import DEFAULT
from trackloom.operators import evaluation as V, tracking

SIZES = (1, 2, 30, 3, 1, 9, 0, 5)


@contextmanager
def batches_of(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def box(rng):
    x, y = rng.randint(0, 8) / 10, rng.randint(0, 2) / 10
    return x, y, x + 0.5, y + 0.5


def iou(a, b):
    w, h = (max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def boxes(seed, classes=2):
    """(image, class, pos, confidence, box): images of many sizes, one of them without a name, one confidence not a number and one missing."""
    rng, out = random.Random(seed), []
    for k, n in enumerate(SIZES * 4):
        for pos in range(n):
            c = float("nan") if (k, pos) == (2, 3) else None if (k, pos) == (2, 4) else rng.randint(0, 9) / 10
            out.append((None if k == 4 else f"i{k}", rng.randrange(classes), pos, c, *box(rng)))
    rng.shuffle(out)
    return out


SCHEMA = "image_id string, class_id int, pos long, confidence double, x1 double, y1 double, x2 double, y2 double"
first = lambda r: (r[3] is None or r[3] != r[3], -(r[3] or 0), r[2])


def groups(rows, n):
    out = {}
    for r in rows:
        out.setdefault(r[:n], []).append(r)
    return out


@pytest.mark.parametrize("batch", [3, 16, 10_000])
def test_suppression(spark, batch):
    rows = boxes(1)
    want = set()
    for (image, cls), own in groups(rows, 2).items():
        kept = []
        for r in sorted(own, key=first):
            if all(iou(r[4:], k[4:]) <= DEFAULT.inference.iou for k in kept):
                kept.append(r)
        want |= {(image, str(cls), r[2]) for r in kept}
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("image_id", "cast(class_id as string) class_name", "pos", "confidence", "x1", "y1", "x2", "y2")
    with batches_of(spark, batch):
        got = tracking.suppress(d).select("image_id", "class_name", "pos").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("batch", [3, 16, 10_000])
def test_detections(spark, batch):
    p, t, ths = boxes(2), boxes(3), (0.75, 0.3, 0.5)
    want, theirs = {}, groups(t, 2)
    for key, own in groups(p, 2).items():
        for k, th in enumerate(ths):
            free = sorted(theirs.get(key, []), key=lambda r: r[2])
            for r in sorted(own, key=first):
                best = max(free, key=lambda x: iou(r[4:], x[4:]), default=None)
                hit = best is not None and iou(r[4:], best[4:]) >= th
                if hit:
                    free.remove(best)
                want[(*key, r[2])] = want.get((*key, r[2]), 0) | hit << k
    with batches_of(spark, batch):
        got = V.match_detections(spark.createDataFrame(p, SCHEMA), spark.createDataFrame(t, SCHEMA), ths).collect()
    assert {(r.image_id, r.class_id, r.pos): r.hits for r in got} == want and len(got) == len(p)


@pytest.mark.parametrize("batch", [3, 16, 10_000])
def test_tracks(spark, batch):
    p, t = ([(r[0], r[1], r[2] + 100, r[2], *r[4:]) for r in boxes(s)] for s in (4, 5))
    want, theirs = set(), groups(t, 2)
    for key, own in groups(p, 2).items():
        pairs = [(iou(a[4:], b[4:]), a[3], b[3]) for a in own for b in theirs.get(key, []) if iou(a[4:], b[4:]) >= 0.5]
        used_p, used_t = set(), set()
        for v, a, b in sorted(pairs, reverse=True):
            if a not in used_p and b not in used_t:
                used_p.add(a)
                used_t.add(b)
                want.add((*key, b + 100, a + 100))
    schema = "sequence_id string, frame_id int, track_id long, pos long, x1 double, y1 double, x2 double, y2 double"
    with batches_of(spark, batch):
        got = V.match_tracks(spark.createDataFrame(p, schema), spark.createDataFrame(t, schema)).collect()
    assert len(got) == len(want) and {tuple(r)[:4] for r in got} == want


@pytest.mark.parametrize("batch", [3, 16, 10_000])
@pytest.mark.parametrize("tolerance", [0, 2])
def test_events(spark, batch, tolerance):
    rng = random.Random(6)
    make = lambda: [(k, f"s{k}", k % 3, None if k % 2 else k, None if rng.random() < 0.05 else rng.randint(-5, 20), pos) for k, n in enumerate(SIZES * 2) for pos in range(n)]
    p, t = make(), make()
    want, theirs = [], groups(t, 1)
    for key, own in groups(p, 1).items():
        free = sorted(theirs.get(key, []), key=lambda r: r[5])
        for r in sorted(own, key=lambda r: r[5]):
            hit = next((x for x in free if None not in (x[4], r[4]) and abs(x[4] - r[4]) <= tolerance), None)
            if hit:
                free.remove(hit)
                want.append((str(key[0]), r[5], hit[5]))
    schema = "event_type long, sequence_id string, primary_track_id long, secondary_track_id long, frame_id int, pos long"
    a, b = (spark.createDataFrame(x, schema).selectExpr("cast(event_type as string) event_type", "sequence_id", "primary_track_id", "secondary_track_id", "frame_id", "pos") for x in (p, t))
    with batches_of(spark, batch):
        assert sorted(map(tuple, V.match_events(a, b, tolerance).collect())) == sorted(want)


def test_no_call_for_each_group(spark):
    d = spark.createDataFrame(boxes(7), SCHEMA)
    tracks = d.selectExpr("image_id sequence_id", "class_id frame_id", "pos track_id", "pos", "x1", "y1", "x2", "y2")
    events = d.selectExpr("image_id event_type", "image_id sequence_id", "pos primary_track_id", "pos secondary_track_id", "class_id frame_id", "pos")
    suppressed = tracking.suppress(d.selectExpr("*", "cast(class_id as string) class_name"))
    for df in (suppressed, V.match_detections(d, d), V.match_tracks(tracks, tracks), V.match_events(events, events)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" in plan and "GroupsInPandas" not in plan
