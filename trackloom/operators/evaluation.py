"""Detection, tracking, event and query metrics.

Greedy matchers carry an explicit input position, since ties depend on it; each works within
frames, images or event keys, many of them in one batch, never over a whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.shared import write_once

BOX = ["x1", "y1", "x2", "y2"]
THRESHOLDS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.clip(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    h = np.clip(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
    area = lambda x: np.clip(x[:, 2] - x[:, 0], 0, None) * np.clip(x[:, 3] - x[:, 1], 0, None)
    union = area(a)[:, None] + area(b)[None, :] - w * h
    return np.where(union > 0, w * h / np.where(union > 0, union, 1), 0.0)


def _iou_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of boxes row by row."""
    w = np.clip(np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), 0, None)
    h = np.clip(np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]), 0, None)
    area = lambda x: np.clip(x[:, 2] - x[:, 0], 0, None) * np.clip(x[:, 3] - x[:, 1], 0, None)
    union = area(a) + area(b) - w * h
    return np.where(union > 0, w * h / np.where(union > 0, union, 1), 0.0)


def by_groups(rows: DataFrame, keys: list[str], order: list[Column], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over tables of many whole groups at once, their rows in order; ``first`` marks where a group begins.

    Groups are small and many, so a call for each of them would cost more than its work.  A table
    holds a batch of rows and the rest of its last group.
    """
    marked = rows.withColumn("first", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            starts = np.flatnonzero(b["first"].to_numpy(bool))
            if held and len(starts):
                yield run(pd.concat([*held, b.iloc[: starts[-1]]], ignore_index=True))
                held = []
            elif len(starts) and starts[-1]:
                yield run(b.iloc[: starts[-1]].reset_index(drop=True))
            held.append(b.iloc[starts[-1] :] if len(starts) else b)
        if held:
            yield run(pd.concat(held, ignore_index=True))

    return marked.mapInPandas(whole, schema)


def _both(preds: DataFrame, truths: DataFrame, columns: list[str], more: str | None = None) -> DataFrame:
    """Predictions and truths in one table; ``more`` is a column of predictions only."""
    extra = [] if more is None else [F.col(more).cast("double").alias(more)]
    none = [] if more is None else [F.lit(None).cast("double").alias(more)]
    return preds.select(*columns, *extra, F.lit(True).alias("pred")).unionByName(truths.select(*columns, *none, F.lit(False).alias("pred")))


#: Pairs of boxes that are compared at a time.
PAIRS = 1 << 20


def _changes(*columns: np.ndarray) -> np.ndarray:
    """A number for each run of equal rows; what is not a number equals nothing."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _overlaps(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, iou): rows of ``a`` and ``b`` of one group that overlap by ``least``; ``b_group`` ascends."""
    start = np.searchsorted(b_group, a_group, "left")
    n = np.searchsorted(b_group, a_group, "right") - start
    upto, out, at = np.cumsum(n), [], 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        k = n[at:end]
        i = np.repeat(np.arange(at, end), k)
        j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + start[i]
        iou = _iou_of(a[i], b[j])
        near = iou >= least
        out.append((i[near], j[near], iou[near]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _take(i: np.ndarray, j: np.ndarray, bits: np.ndarray, n: int, m: int) -> np.ndarray:
    """For each pair (i, j), in the order in which they are tried, the bits in which both were free.  Pairs that share no end need no turn."""
    got = bits.copy()
    turns = np.flatnonzero((np.bincount(i, minlength=n)[i] > 1) | (np.bincount(j, minlength=m)[j] > 1))
    used_i: dict[int, int] = {}
    used_j: dict[int, int] = {}
    taken = []
    for x, y, b in zip(i[turns].tolist(), j[turns].tolist(), bits[turns].tolist()):
        u, v = used_i.get(x, 0), used_j.get(y, 0)
        b &= ~(u | v)
        taken.append(b)
        if b:
            used_i[x], used_j[y] = u | b, v | b
    got[turns] = taken
    return got


def match_detections(preds: DataFrame, truths: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(image_id, class_id, pos, confidence, hits): by confidence, each takes its best free truth of its class.

    Bit k of ``hits`` says whether it takes one at the k-th threshold.
    Columns: image_id, class_id, pos, x1, y1, x2, y2 (+ confidence).
    """
    steps = np.sort(np.asarray(thresholds, float))
    place = np.argsort(np.asarray(thresholds, float), kind="stable")
    masks = np.cumsum([0, *(1 << int(k) for k in place)])  # bits of the thresholds that an overlap reaches

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        image, cls, pred = np.cumsum(rows["first"].to_numpy(bool)), rows["class_id"].to_numpy(), rows["pred"].to_numpy(bool)
        group, boxes = _changes(image, cls), rows[BOX].to_numpy(float)
        p, t = np.flatnonzero(pred), np.flatnonzero(~pred)
        hits = np.zeros(len(p), np.int64)
        if len(p) and len(t):
            i, j, iou = _overlaps(boxes[p], group[p], boxes[t], group[t], steps[0])
            order = np.lexsort((j, -iou, i))
            i, j, iou = i[order], j[order], iou[order]
            np.bitwise_or.at(hits, i, _take(i, j, masks[np.searchsorted(steps, iou, "right")], len(p), len(t)))
        return rows.iloc[p].assign(hits=hits)[names]

    names = ["image_id", "class_id", "pos", "confidence", "hits"]
    both = _both(preds, truths, ["image_id", "class_id", "pos", *BOX], "confidence")
    order = [F.col("class_id"), F.col("pred").desc(), F.nanvl("confidence", F.lit(None)).desc_nulls_last(), F.col("pos").asc_nulls_last()]
    return by_groups(both, ["image_id"], order, match, "image_id string, class_id int, pos long, confidence double, hits long")


def running_counts(rows: DataFrame, group: str, order: list[Column], flags: list[Column]) -> DataFrame:
    """``rows`` with ``n`` and ``counts``: rows of the group, and true ``flags``, up to and with each row in the order.

    A group may hold all rows: they are dealt by ranges of the order and counted range by range; the
    totals of the ranges (a row for each range and group) are summed up and added.
    """
    part = write_once(rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()))
    ones = [f.cast("long") for f in flags]
    totals = part.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n_part"), *(F.sum(f).alias(f"f{k}") for k, f in enumerate(ones)))
    before = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    n_before = F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("n_before")
    offsets = totals.select(group, "part", n_before, F.array(*(F.coalesce(F.sum(f"f{k}").over(before), F.lit(0)) for k in range(len(flags)))).alias("before"))
    here = W.partitionBy(group, "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = part.withColumns({"n": F.count(F.lit(1)).over(here), "counts": F.array(*(F.sum(f).over(here) for f in ones))})
    both = local.join(offsets, [group, "part"])
    return both.withColumns({"n": F.col("n") + F.col("n_before"), "counts": F.zip_with("counts", "before", lambda a, b: a + b)}).drop("part", "n_before", "before")


def average_precision(preds: DataFrame, truths: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(class_id, threshold, ap): mean precision at the true positives, not interpolated; a class without truth has 0."""
    m = match_detections(preds, truths, thresholds)
    flags = [F.shiftright("hits", k).bitwiseAND(F.lit(1)) == 1 for k in range(len(thresholds))]
    m = running_counts(m, "class_id", [F.col("confidence").desc(), F.col("pos").asc(), F.col("image_id").asc()], flags)
    sums = m.groupBy("class_id").agg(*(F.sum(F.when(f, F.col("counts")[k] / F.col("n")).otherwise(0.0)).alias(f"s{k}") for k, f in enumerate(flags)))
    gt = truths.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_gt"))
    every = F.array(*(F.struct(F.lit(th).alias("threshold"), F.coalesce(F.col(f"s{k}"), F.lit(0.0)).alias("s")) for k, th in enumerate(thresholds)))
    out = sums.join(gt, "class_id", "full").select("class_id", "n_gt", F.explode(every).alias("x"))
    return out.select("class_id", "x.threshold", F.when(F.col("n_gt") > 0, F.col("x.s") / F.col("n_gt")).otherwise(0.0).alias("ap"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    """One row: map_50 and map_50_95."""
    return ap.agg(F.coalesce(F.avg(F.when(F.col("threshold") == 0.5, F.col("ap"))), F.lit(0.0)).alias("map_50"), F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map_50_95"))


def match_tracks(preds: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(sequence_id, frame_id, gt_track, pred_track, iou): greedy by IoU; ties prefer later prediction, then later truth."""

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        group, pred, boxes, track = np.cumsum(rows["first"].to_numpy(bool)), rows["pred"].to_numpy(bool), rows[BOX].to_numpy(float), rows["track_id"].to_numpy()
        p, t = np.flatnonzero(pred), np.flatnonzero(~pred)
        i, j, iou = _overlaps(boxes[p], group[p], boxes[t], group[t], threshold)
        order = np.lexsort((j, i, iou))[::-1]
        i, j, iou = i[order], j[order], iou[order]
        got = _take(i, j, np.ones(len(i), np.int64), len(p), len(t)) > 0
        truth = rows[["sequence_id", "frame_id", "track_id"]].iloc[t[j[got]]].reset_index(drop=True)
        return truth.assign(pred_track=track[p[i[got]]], iou=iou[got]).set_axis(["sequence_id", "frame_id", "gt_track", "pred_track", "iou"], axis=1)

    keys = ["sequence_id", "frame_id"]
    both = _both(preds, truths, [*keys, "track_id", "pos", *BOX])
    return by_groups(both, keys, [F.col("pred").desc(), F.col("pos").asc_nulls_last()], match, "sequence_id string, frame_id int, gt_track long, pred_track long, iou double")


def tracking_metrics(preds: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: matches, misses, false positives, switches, mota, motp, switch_rate."""
    m = match_tracks(preds, truths, threshold)
    seen = W.partitionBy("sequence_id", "gt_track").orderBy("frame_id")
    m = m.withColumn("switch", (F.lag("pred_track").over(seen) != F.col("pred_track")).cast("int"))
    a = m.agg(F.count(F.lit(1)).alias("matches"), F.coalesce(F.sum("switch"), F.lit(0)).alias("id_switches"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("motp"))
    p = preds.agg(F.count(F.lit(1)).alias("n_pred"))
    t = truths.agg(F.count(F.lit(1)).alias("n_gt"), F.countDistinct("sequence_id", "track_id").alias("n_tracks"))
    one = a.crossJoin(p).crossJoin(t)  # three single rows
    fn, fp = F.col("n_gt") - F.col("matches"), F.col("n_pred") - F.col("matches")
    mota = F.when(F.col("n_gt") > 0, 1 - (fn + fp + F.col("id_switches")) / F.col("n_gt")).otherwise(0.0)
    return one.select("matches", fn.alias("misses"), fp.alias("false_positives"), "id_switches", mota.alias("mota"), "motp", (F.col("id_switches") / F.greatest(F.lit(1), F.col("n_tracks"))).alias("switch_rate"))


def match_events(preds: DataFrame, truths: DataFrame, tolerance: int = 0) -> DataFrame:
    """(event_type, pred_pos, truth_pos): each prediction, in order, takes the first free truth within the tolerance."""
    keys = ["event_type", "sequence_id", "primary_track_id", "second"]
    second = F.coalesce(F.col("secondary_track_id").cast("long"), F.lit(-(1 << 62)))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(group=np.cumsum(rows["first"].to_numpy(bool)))[rows["frame_id"].notna()]
        group, pred, frame, pos = rows["group"].to_numpy(), rows["pred"].to_numpy(bool), rows["frame_id"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64)
        p, t = np.flatnonzero(pred), np.flatnonzero(~pred)
        out = rows.iloc[p[:0]][["event_type"]].assign(pred_pos=pos[:0], truth_pos=pos[:0])
        if not len(p) or not len(t):
            return out
        # truths by group and frame, as one number, so that each prediction looks up those within the tolerance only
        line = group * (int(frame.max() - frame.min()) + 2 * tolerance + 1) + frame - frame.min()
        by_line = t[np.argsort(line[t], kind="stable")]
        start, stop = np.searchsorted(line[by_line], line[p] - tolerance, "left"), np.searchsorted(line[by_line], line[p] + tolerance, "right")
        n = stop - start
        i = np.repeat(np.arange(len(p)), n)
        place = by_line[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[i]]
        order = np.lexsort((place, i))
        i, place = i[order], place[order]
        got = _take(i, place, np.ones(len(i), np.int64), len(p), len(rows)) > 0
        return rows.iloc[p[i[got]]][["event_type"]].assign(pred_pos=pos[p[i[got]]], truth_pos=pos[place[got]])

    cols = (*keys[:3], "frame_id", "pos")
    a, b = (x.select(*cols, second.alias("second")) for x in (preds, truths))
    return by_groups(_both(a, b, [*cols, "second"]), keys, [F.col("pred").desc(), F.col("pos").asc_nulls_last()], match, "event_type string, pred_pos long, truth_pos long")


def event_metrics(preds: DataFrame, truths: DataFrame, tolerance: int = 0) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1, with zero guards."""
    one = match_events(preds, truths, tolerance).agg(F.count(F.lit(1)).alias("tp")).crossJoin(preds.agg(F.count(F.lit(1)).alias("np"))).crossJoin(truths.agg(F.count(F.lit(1)).alias("nt")))
    return prf(one.select("tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn")))


def prf(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r))


def query_metrics(cases: DataFrame) -> DataFrame:
    """One row over (first_valid, final_valid, results_equal, retried): rates of generated queries."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return cases.agg(
        rate("first_valid").alias("first_attempt_validity"), rate("final_valid").alias("final_validity"), rate("results_equal").alias("semantic_correctness"), rate("retried").alias("retry_rate"), F.count(F.lit(1)).alias("cases")
    )


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (missing, extra, equal): rows that ``b`` lacks and has too many, as multisets, whatever their order; one aggregation by row."""
    rows = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1))).groupBy(*a.columns).agg(F.sum("side").alias("side"))
    n = lambda c: F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0)).cast("long")
    out = rows.agg(n(F.col("side")).alias("missing"), n(-F.col("side")).alias("extra"))
    return out.withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows."""
    return difference(a, b).head()["equal"]


def calibrate(scored: DataFrame) -> DataFrame:
    """The threshold with the best (f1, precision, recall); ties go to the earliest candidate; none raises ValueError."""
    best = scored.orderBy(F.col("f1").desc(), F.col("precision").desc(), F.col("recall").desc(), "pos").limit(1)
    if best.isEmpty():
        raise ValueError("no threshold candidates")
    return best
