"""Average precision over ranges against one sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import evaluation as V


def test_running_counts_of_one_group_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [("one" if k % 10 else "two", k, rng.choice((0.9, 0.9, 0.5, rng.random())), rng.random() < 0.4) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, pos long, confidence double, hit boolean").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = df.repartitionByRange("g", F.col("confidence").desc(), "pos").select(F.spark_partition_id().alias("p"), "g").where("g = 'one'").distinct().count()
    assert parts > 1
    got = {(r.g, r.pos): (r.n, r.counts[0]) for r in V.running_counts(df, "g", [F.col("confidence").desc(), F.col("pos").asc()], [F.col("hit")]).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("one", "two"):
        n = hits = 0
        for _, pos, _, hit in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            n, hits = n + 1, hits + hit
            assert got[g, pos] == (n, hits)


def test_no_window_holds_a_class(spark):
    boxes = spark.createDataFrame([(f"i{k % 7}", k % 3, k, 0.0, 0.0, 1.0, 1.0, 0.5) for k in range(60)], "image_id string, class_id int, pos long, x1 double, y1 double, x2 double, y2 double, confidence double")
    plan = V.average_precision(boxes, boxes.drop("confidence"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in f" {line.strip(' +-:')} "]
    assert windows and all("part#" in w for w in windows)


@pytest.mark.parametrize("seed", [0, 1])
def test_average_precision_equals_a_sorted_list(spark, seed):
    rng = random.Random(seed)
    box = lambda: (x := 0.1 * rng.randint(0, 4), y := 0.1 * rng.randint(0, 4), x + 0.3, y + 0.2 + 0.1 * rng.randint(0, 1))
    truths = [(f"i{rng.randint(0, 5)}", rng.randint(0, 2), k, *box()) for k in range(40)]
    preds = [(f"i{rng.randint(0, 6)}", rng.randint(0, 3), k, *box(), rng.choice((0.9, 0.5, rng.random()))) for k in range(90)]
    schema = "image_id string, class_id int, pos long, x1 double, y1 double, x2 double, y2 double"
    got = {(r.class_id, round(r.threshold, 2)): r.ap for r in V.average_precision(spark.createDataFrame(preds, schema + ", confidence double"), spark.createDataFrame(truths, schema)).collect()}

    def iou(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
        return w * h / (area(a) + area(b) - w * h)

    assert len(got) == 40
    for c in range(4):
        for th in V.THRESHOLDS:
            free, hits, total = {t[2]: t for t in truths if t[1] == c}, 0, 0.0
            n_truth = len(free)
            for n, p in enumerate(sorted((p for p in preds if p[1] == c), key=lambda p: (-p[7], p[2])), 1):
                near = [(iou(p[3:7], t[3:7]), -t[2]) for t in free.values() if t[0] == p[0]]
                if near and max(near)[0] >= th:
                    del free[-max(near)[1]]
                    hits += 1
                    total += hits / n
            assert got[c, th] == pytest.approx(total / n_truth if n_truth else 0.0)
