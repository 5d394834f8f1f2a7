"""Detections to tracks: formatting, suppression and a two-pass association of predicted boxes per sequence.

Association depends on every earlier frame, so a sequence is one group; sequences are
independent and run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import DEFAULT, Config
from .evaluation import _iou, _iou_of

BOX = ["x1", "y1", "x2", "y2"]


def format_detections(raw: DataFrame, names: dict[int, str], min_confidence: float | None = None) -> DataFrame:
    """Rows of parallel arrays (frame_id, xyxy, conf, cls) to one row per detection; the shortest array decides, occlusion is 0."""
    n = F.least(F.size("xyxy"), F.size("conf"), F.size("cls"))
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    each = raw.select(*[c for c in raw.columns if c not in ("xyxy", "conf", "cls")], F.posexplode(F.arrays_zip(*(F.slice(c, F.lit(1), n).alias(c) for c in ("xyxy", "conf", "cls")))).alias("pos", "d"))
    keep = [c for c in each.columns if c != "d"]
    out = each.select(*keep, F.col("d.cls").cast("int").alias("class_id"), F.col("d.conf").cast("double").alias("confidence"), *(F.col("d.xyxy")[i].alias(c) for i, c in enumerate(BOX)))
    out = out.withColumn("class_name", F.coalesce(F.try_element_at(table, F.col("class_id")), F.col("class_id").cast("string"))).withColumn("occlusion", F.lit(0))
    return out if min_confidence is None else out.where(F.col("confidence") >= min_confidence)


def suppress(detections: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Greedy non-maximum suppression per image and class.

    Rows come in order, many images in a batch; of a group that goes on in the next batch only the
    boxes that stayed are held.
    """
    limit, schema = cfg.inference.iou, detections.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            p = b.assign(old=False) if held is None else pd.concat([held, b.assign(old=False)], ignore_index=True)
            p = p[survivors(np.cumsum(p["first"].to_numpy(bool)), p[BOX].to_numpy(float), limit)]
            yield p[~p["old"]][schema.names]
            held = p.iloc[np.flatnonzero(p["first"])[-1] :].assign(old=True) if len(p) else None

    order = W.partitionBy("image_id", "class_name").orderBy(F.nanvl("confidence", F.lit(None)).desc_nulls_last(), F.col("pos").asc_nulls_last())
    return detections.withColumn("first", F.row_number().over(order) == 1).mapInPandas(run, schema)


def survivors(group: np.ndarray, boxes: np.ndarray, limit: float) -> np.ndarray:
    """Greedy suppression in all groups at once: in each round the first open box of every group stays and closes those that overlap it more than ``limit``."""
    stays, still = np.zeros(len(group), bool), np.arange(len(group))
    while len(still):
        own = group[still]
        new = np.ones(len(still), bool)
        new[1:] = own[1:] != own[:-1]
        stays[still[new]] = True
        best = still[new][np.cumsum(new) - 1]
        still = still[~new & ~(_iou_of(boxes[still], boxes[best]) > limit)]
    return stays


def infer(frames: DataFrame, factory: Callable[[], Callable[[bytes], tuple]], keys: tuple[str, ...] = ("sequence_id", "frame_id")) -> DataFrame:
    """Rows of parallel arrays (keys, xyxy, conf, cls) from a model over frames with ``content``: the hook for inference.

    ``factory`` is called once in each task and gives a function from a frame's bytes to three arrays;
    frames without ``content`` raise KeyError.  What it returns goes through ``format_detections``.
    """
    if "content" not in frames.columns:
        raise KeyError("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            found = [model(bytes(x)) for x in b["content"]]
            yield b[list(keys)].assign(**{name: [list(f[i]) for f in found] for i, name in enumerate(("xyxy", "conf", "cls"))})

    kept = frames.select(*keys)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema), "xyxy array<array<double>>, conf array<double>, cls array<int>"])
    return frames.select(*keys, "content").mapInPandas(run, schema)


#: Standard deviations of a box's place and speed, as shares of its height.
PLACE, SPEED = 1 / 20, 1 / 160


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of the cheapest assignment in which a row may stay alone at the price ``limit``.

    Shortest augmenting paths with potentials: each row in turn searches the cheapest path of
    alternating pairs to a free column, its own place to stay alone included.
    """
    allowed = cost <= limit
    if (allowed.sum(axis=0) <= 1).all() and (allowed.sum(axis=1) <= 1).all():
        return list(zip(*(x.tolist() for x in np.nonzero(allowed))))
    n, m = cost.shape
    alone = np.full((n, n), np.inf)
    np.fill_diagonal(alone, limit)
    c = np.hstack([np.where(allowed, cost, np.inf), alone])
    u, v = np.zeros(n), np.zeros(m + n)
    row_of, col_of = np.full(m + n, -1), np.full(n, -1)
    for start in range(n):
        dist, via, done = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, bool)
        row, lowest = start, 0.0
        while True:
            reach = lowest + c[row] - u[row] - v
            nearer = ~done & (reach < dist)
            dist[nearer], via[nearer] = reach[nearer], row
            j = int(np.where(done, np.inf, dist).argmin())
            lowest = dist[j]
            if row_of[j] < 0:
                break
            done[j] = True
            row = row_of[j]
        inner = np.flatnonzero(done)
        u[start] += lowest
        u[row_of[inner]] += lowest - dist[inner]
        v[inner] -= lowest - dist[inner]
        while True:  # turn the pairs of the path over
            row = via[j]
            row_of[j], col_of[row], j = row, j, col_of[row]
            if row == start:
                break
    return [(i, int(j)) for i, j in enumerate(col_of) if j < m]


def _greedy(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs by cost, each row and column once."""
    used_i, used_j, out = set(), set(), []
    for _, i, j in sorted((cost[i, j], i, j) for i, j in zip(*np.nonzero(cost <= limit))):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((int(i), int(j)))
    return out


class Motion:
    """Constant-velocity filters of all tracks: centre, width and height with their speeds and 2 x 2 covariances.

    The four coordinates are filtered apart; noise is a share of the box's height.
    """

    def __init__(self):
        self.mean, self.cov, self.at = np.zeros((0, 4, 2)), np.zeros((0, 4, 2, 2)), np.zeros(0)

    @staticmethod
    def measured(boxes: np.ndarray) -> np.ndarray:
        return np.column_stack([(boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2, boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]])

    def predict(self, frame: int) -> np.ndarray:
        """Move all tracks on to the frame; their boxes there."""
        dt = frame - self.at
        step = np.zeros((len(dt), 1, 2, 2))
        step[:, 0, 0, 0] = step[:, 0, 1, 1] = 1
        step[:, 0, 0, 1] = dt
        h = np.abs(self.mean[:, 3, 0])[:, None]
        self.mean = np.einsum("nkij,nkj->nki", np.broadcast_to(step, self.cov.shape), self.mean)
        self.cov = step @ self.cov @ step.transpose(0, 1, 3, 2)
        self.cov[:, :, 0, 0] += dt[:, None] * (PLACE * h) ** 2
        self.cov[:, :, 1, 1] += dt[:, None] * (SPEED * h) ** 2
        self.at = np.full(len(dt), float(frame))
        x, y, w, t = self.mean[:, :, 0].T
        return np.column_stack([x - w / 2, y - t / 2, x + w / 2, y + t / 2])

    def correct(self, rows: list[int], boxes: np.ndarray) -> None:
        """Take sightings of the given tracks into account."""
        z, cov = self.measured(boxes), self.cov[rows]
        spread = cov[:, :, 0, 0] + (PLACE * z[:, 3:4]) ** 2
        gain = cov[:, :, :, 0] / np.maximum(spread, 1e-12)[:, :, None]
        self.mean[rows] += gain * (z - self.mean[rows][:, :, 0])[:, :, None]
        self.cov[rows] = cov - gain[:, :, :, None] * cov[:, :, 0:1, :]

    def add(self, boxes: np.ndarray, frame: int) -> None:
        z = self.measured(boxes)
        mean = np.stack([z, np.zeros_like(z)], axis=2)
        cov = np.zeros((len(z), 4, 2, 2))
        cov[:, :, 0, 0], cov[:, :, 1, 1] = (2 * PLACE * z[:, 3:4]) ** 2, (20 * SPEED * z[:, 3:4]) ** 2
        self.mean, self.cov = np.concatenate([self.mean, mean]), np.concatenate([self.cov, cov])
        self.at = np.append(self.at, np.full(len(z), float(frame)))

    def keep(self, which: np.ndarray) -> None:
        self.mean, self.cov, self.at = self.mean[which], self.cov[which], self.at[which]


class Associator:
    """Two passes of assignment on predicted boxes: sure detections by overlap times confidence, then unsure ones by overlap.

    ``matcher`` assigns rows (tracks) to columns (detections) by cost up to a limit.
    """

    def __init__(self, cfg: Config = DEFAULT, matcher: Callable[[np.ndarray, float], list[tuple[int, int]]] = assign):
        self.cfg, self.matcher, self.next_id, self.motion = cfg.tracker, matcher, 1, Motion()
        self.ids: list[int] = []
        self.seen, self.reported = {}, set()

    def update(self, frame: int, boxes: np.ndarray, confidence: np.ndarray) -> tuple[dict[int, int], list[int], list[int]]:
        """(detection -> track, new tracks, newly lost tracks).  A frame without detections changes nothing."""
        if not len(boxes):
            return {}, [], []
        c = self.cfg
        high, low = np.flatnonzero(confidence >= c.high), np.flatnonzero((confidence >= c.low) & (confidence < c.high))
        iou = _iou(self.motion.predict(frame), boxes)
        row_of: dict[int, int] = {}
        for i, j in self.matcher(1 - iou[:, high] * confidence[high], c.match):
            row_of[int(high[j])] = i
        free = np.setdiff1d(np.arange(len(self.ids)), list(row_of.values()))
        for i, j in self.matcher(1 - iou[np.ix_(free, low)], 0.5):
            row_of[int(low[j])] = int(free[i])
        if row_of:
            self.motion.correct(list(row_of.values()), boxes[list(row_of)])
        got = {j: self.ids[i] for j, i in row_of.items()}
        fresh = [j for j in high.tolist() if j not in got and confidence[j] >= c.new]
        new = list(range(self.next_id, self.next_id + len(fresh)))
        self.next_id += len(fresh)
        got |= dict(zip(fresh, new))
        self.ids += new
        self.motion.add(boxes[fresh], frame)
        for t in got.values():
            self.seen[t] = frame
            self.reported.discard(t)
        lost = sorted(t for t in self.ids if self.seen[t] < frame and t not in self.reported)
        self.reported.update(lost)
        stays = np.array([frame - self.seen[t] <= c.buffer for t in self.ids], bool)
        for t in np.array(self.ids)[~stays].tolist():
            del self.seen[t]
            self.reported.discard(t)
        self.ids = np.array(self.ids)[stays].tolist()
        self.motion.keep(stays)
        return got, new, lost


def track(detections: DataFrame, cfg: Config = DEFAULT, tracker: Callable[[Config], Associator] = Associator) -> DataFrame:
    """Tracked detections with is_new and is_lost; a lost track gives one row with its last box when it is first missed.

    ``tracker`` makes the tracker of a sequence; any object with the method ``update`` of ``Associator`` will do.

    detections: (sequence_id, frame_id, pos, class_name, x1, y1, x2, y2, confidence).
    """
    cols = ["sequence_id", "frame_id", "pos", "class_name", *BOX, "confidence"]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, last, out = tracker(cfg), {}, []
        for frame, f in p.sort_values(["frame_id", "pos"]).groupby("frame_id", sort=True):
            rows = f.to_dict("records")
            got, new, lost = a.update(int(frame), f[BOX].to_numpy(float), f["confidence"].to_numpy(float))
            for j, t in sorted(got.items()):
                last[t] = rows[j]
                out.append({**rows[j], "track_id": t, "is_new": t in new, "is_lost": False})
            out += [{**last[t], "frame_id": int(frame), "track_id": t, "is_new": False, "is_lost": True} for t in lost]
        return pd.DataFrame(out, columns=[*cols, "track_id", "is_new", "is_lost"])

    schema = "sequence_id string, frame_id int, pos long, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double, track_id long, is_new boolean, is_lost boolean"
    return detections.select(*cols).groupBy("sequence_id").applyInPandas(run, schema)


def active(tracked: DataFrame) -> DataFrame:
    return tracked.where(~F.col("is_lost"))
