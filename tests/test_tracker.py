"""The tracker on crossing and occluded objects, its assignment against all permutations, and hooks."""

import itertools
import random

import numpy as np
import pytest

from trackloom.config import DEFAULT
from trackloom.operators import evaluation as V, tracking as T


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_the_cheapest_of_all(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(0, 5, 2).tolist()
    cost, limit = np.round(rng.random((n, m)), 1 if seed % 2 else 3), float(rng.choice([0.3, 0.8, 2.0]))
    got = T.assign(cost, limit)
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and all(cost[i, j] <= limit for i, j in got)
    price = lambda pairs: sum(cost[i, j] for i, j in pairs) + limit * (n - len(pairs))
    best = min(price([(i, j) for i, j in enumerate(p) if j is not None and cost[i, j] <= limit]) for p in set(itertools.permutations([*range(m), *[None] * n], n)))
    assert price(got) == pytest.approx(best)


def test_the_filter_learns_a_speed_and_doubts_more_with_time():
    m = T.Motion()
    box = lambda x: np.array([[x, 10.0, x + 4, 18.0]])
    m.add(box(0.0), 0)
    for f in range(1, 20):
        m.predict(f)
        m.correct([0], box(2.0 * f))
    before = m.cov[0, 0, 0, 0]
    assert m.predict(25)[0, 0] == pytest.approx(50, abs=1.0) and m.cov[0, 0, 0, 0] > before


def crossing(seed, objects=8, frames=60):
    """(boxes, truth ids) of each frame: objects on straight paths that cross, hidden now and then, boxes shaken."""
    rng = random.Random(seed)
    paths = [(rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(-2.5, 2.5), rng.uniform(-2.5, 2.5), rng.randint(5, 40)) for _ in range(objects)]
    for f in range(frames):
        boxes, ids = [], []
        for k, (x, y, dx, dy, hidden) in enumerate(paths):
            if not hidden <= f < hidden + 6:
                cx, cy = x + dx * f + rng.gauss(0, 0.4), y + dy * f + rng.gauss(0, 0.4)
                boxes.append((cx - 6, cy - 6, cx + 6, cy + 6))
                ids.append(k)
        yield f, np.array(boxes).reshape(-1, 4), ids


def switches(make, seeds=range(12)):
    total = 0
    for seed in seeds:
        tracker, last = make(), {}
        for f, boxes, ids in crossing(seed):
            got = tracker.update(f, boxes, np.full(len(boxes), 0.9))[0]
            for j, t in got.items():
                total += last.get(ids[j], t) != t
                last[ids[j]] = t
    return total


class Still(T.Motion):
    """Greedy matching on the last boxes."""

    def predict(self, frame):
        self.mean[:, :, 1] = 0
        return super().predict(frame)


def test_fewer_switches_than_greedy_matching_without_motion():
    def plain():
        t = T.Associator(DEFAULT, T._greedy)
        t.motion = Still()
        return t

    ours, greedy = switches(T.Associator), switches(plain)
    assert ours < 0.6 * greedy and greedy > 20
    assert ours <= switches(lambda: T.Associator(DEFAULT, T._greedy))


def test_accuracy_against_truth(spark):
    found, truth = [], []
    for seed in range(4):
        for f, boxes, ids in crossing(seed):
            for pos, (b, k) in enumerate(zip(boxes.tolist(), ids)):
                truth.append((f"s{seed}", f, k, pos, *b))
                found.append((f"s{seed}", f, pos, "car", *b, 0.9))
    schema = "x1 double, y1 double, x2 double, y2 double"
    tracked = T.active(T.track(spark.createDataFrame(found, f"sequence_id string, frame_id int, pos long, class_name string, {schema}, confidence double")))
    truths = spark.createDataFrame(truth, f"sequence_id string, frame_id int, track_id long, pos long, {schema}")
    r = V.tracking_metrics(tracked, truths).head()
    assert r.matches == len(truth) and r.mota > 0.97


class EveryBoxIsNew:
    """A tracker of the caller's own."""

    def __init__(self, cfg):
        self.n = 0

    def update(self, frame, boxes, confidence):
        new = list(range(self.n, self.n + len(boxes)))
        self.n += len(boxes)
        return dict(enumerate(new)), new, []


def test_any_tracker_can_be_hooked_in(spark):
    rows = [("s", f, p, "car", 0.0, 0.0, 1.0, 1.0, 0.9) for f in range(3) for p in range(2)]
    df = spark.createDataFrame(rows, "sequence_id string, frame_id int, pos long, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double")
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        assert sorted(r.track_id for r in T.track(df, tracker=EveryBoxIsNew).collect()) == list(range(6))
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
