"""Embedding near-dedup by sorted projection passes.

1. Equal vectors collapse to one representative with a count, so copies are never
   compared with each other.
2. A pass orders the representatives lexicographically by concatenated random hashes
   (sign bits of random projections).  The order is cut into blocks of ``BLOCK`` rows; each
   block also gets the ``WINDOW`` rows before it, and all pairs in that bounded window are
   compared in double precision.  The number of passes follows from the number of vectors,
   the window and the recall wanted for a pair just at the threshold that agrees in the
   first ``bits_for`` bits of a pass.
3. Each block gives a spanning forest of its verified pairs; the union over all passes
   gives components.  Where vectors crowd together more rows than the window share those
   first bits: such a group is compared whole, tile against tile, without the pairs of tiles
   that lie in one component.  So a pair that agrees in these bits always meets, however
   dense its surroundings; the price is quadratic in the size of such a group.
4. The links of a vector are then counted exactly inside its component, tile against tile,
   as a table of counts; pairs are never listed.  A component that was found whole so has
   exact counts, however many near copies it holds.

No join is dealt by a key that may hold a large share of the rows (classes of many copies,
large components, crowded prefixes): see ``common.join_one``.

Vectors that are null, zero, or hold null or non-finite components link with nothing, not
even with their copies; vectors of another length than the first are never compared
with it.  A null id keeps its row; its component is null unless it has links.  Repeated rows are
copies.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut, join_one, release, ship
from .graph import components

THRESHOLD = 0.9
WINDOW = 256
BLOCK = 1024
TILE = 256
HASHES = 60
RECALL = 0.995
SEED = 7


def bits_for(n: int, window: int = WINDOW) -> int:
    """Hash bits after which evenly spread vectors leave at most half a window of rows with one prefix."""
    return min(HASHES, math.ceil(max(0.0, math.log2(max(1, n) / window)) + 1))


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes so that a pair at the threshold shares the first ``bits_for`` bits in one with the given probability.

    It agrees in m bits with probability (1 - angle / pi)**m.  Rows that share these bits
    meet at any density: in a window if they are few, else in ``_crowds``.
    """
    meet = (1 - math.acos(threshold) / math.pi) ** bits_for(n, window)
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - min(meet, 0.999))))


def _matrix(col: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(rows, -1) if rows else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very large or small components neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(n_pass: int, seed: int):
    """(cid, emb) -> a row for each pass: (pass, hash, cid)."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = (np.uint64(1) << np.arange(HASHES - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(_matrix(b.column(1), b.num_rows))
            d = x.shape[1]
            for p in range(n_pass):
                if p not in planes:
                    planes[p] = np.random.default_rng([seed, p, d]).standard_normal((d, HASHES))
                h = ((x @ planes[p] > 0) * weights).sum(axis=1, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(h), b.column(0)], names=["pass", "hash", "cid"])

    return run


def _forest(pairs: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int]]:
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = [], []
    for i, j in pairs:
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            a.append(int(ids[i]))
            b.append(int(ids[j]))
    return a, b


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("cid").combine_chunks())
        x = _unit(_matrix(table.column("emb").combine_chunks(), len(ids)))
        i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        a, b = _forest(np.stack([i, j], axis=1).tolist(), ids)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _cross(threshold: float):
    """A spanning forest of the links of side 0 with side 1 between different components."""

    def run(table: pa.Table) -> pa.Table:
        side, ids, comp = (np.asarray(table.column(c).combine_chunks()) for c in ("side", "cid", "comp"))
        x = _unit(_matrix(table.column("emb").combine_chunks(), len(ids)))
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.nonzero((x[l] @ x[r].T >= threshold) & (comp[l][:, None] != comp[r][None, :]))
        a, b = _forest(np.stack([l[i], r[j]], axis=1).tolist(), ids)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _crowds(ordered: DataFrame, comps: DataFrame, vectors: DataFrame, bits: int, window: int, tile: int, threshold: float) -> DataFrame | None:
    """(a, b): links between components in the groups of equal first ``bits`` that hold more rows than the window."""
    keys = ["pass", "prefix"]
    rows = ordered.select("pass", F.shiftrightunsigned("hash", HASHES - bits).alias("prefix"), "cid")
    full = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > window))
    if not full.head(1):
        return None
    rows = join_one(rows, full, keys, "n").join(comps, F.col("cid") == F.col("v"), "left").select(*keys, "n", "cid", F.coalesce("component", "cid").alias("comp"))
    rows = cut(rows)
    sizes = cut(rows.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("size")))
    # a component lies in as few tiles as its size allows, without a sort of the group
    slot = F.xxhash64("comp") + F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / tile))
    rows = cut(join_one(rows, sizes, [*keys, "comp"], "size").select(*keys, "cid", "comp", F.pmod(slot, F.ceil(F.col("n") / tile)).cast("int").alias("t")))
    tiles = cut(rows.groupBy(*keys, "t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    a, b = (tiles.select(*keys, F.col("t").alias(t), F.col("lo").alias("lo" + k), F.col("hi").alias("hi" + k)) for t, k in (("i", ""), ("j", "2")))
    pairs = a.join(b, keys).where("i <= j and (lo <> hi or lo <> lo2 or hi <> hi2)").select(*keys, "i", "j")  # not both within one component
    sides = [rows.join(pairs.withColumn("t", F.col(t)), [*keys, "t"]).select(*keys, "i", "j", F.lit(k).alias("side"), "cid", "comp") for k, t in enumerate("ij")]
    placed = sides[0].unionByName(sides[1]).join(vectors, "cid")
    return placed.groupBy(*keys, "i", "j").applyInArrow(_cross(threshold), "a long, b long")


def _count(threshold: float):
    """Links of the rows of side 0 with those of side 1, weighted by copies."""

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side").combine_chunks())
        ids = np.asarray(table.column("cid").combine_chunks())
        copies = np.asarray(table.column("copies").combine_chunks())
        x = _unit(_matrix(table.column("emb").combine_chunks(), len(ids)))
        l, r = side == 0, side == 1
        links = ((x[l] @ x[r].T >= threshold) & (ids[l][:, None] != ids[r][None, :])) @ copies[r]
        return pa.table({"cid": pa.array(ids[l], pa.int64()), "n": pa.array(links.astype(np.int64))})

    return run


def link(vectors: DataFrame, *, threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK, tile: int = TILE, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of ``vectors``."""
    ship(vectors.sparkSession)
    e = F.col("embedding").cast("array<double>")
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, F.transform(e, lambda x: x + 0.0)).alias("emb"))
    rows = rows.withColumn("key", F.md5(F.concat_ws(",", F.transform("emb", lambda x: x.cast("string")))))
    rows = rows.withColumn("key", F.when(F.col("emb").isNotNull(), F.col("key")))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("emb").alias("emb"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    one = classes.select("cid", "copies", "emb")
    n = one.count()
    n_pass, bits = passes_for(n, threshold, window, recall), bits_for(n, window)

    links = None
    sizes = [x[0] for x in one.select(F.size("emb").alias("d")).distinct().collect()]  # one, as a rule
    for d in sizes:
        same = one.where(F.size("emb") == d)
        hashed = same.select("cid", "emb").mapInArrow(_hash(n_pass, seed), "pass int, hash long, cid long")
        blocks, ordered = _blocks(hashed, block, window)
        placed = blocks.join(same.select("cid", "emb"), "cid")
        near = components(placed.groupBy("pass", "block").applyInArrow(_compare(threshold), "a long, b long"))
        found = near.select(F.col("v").alias("a"), F.col("component").alias("b"))
        crowds = _crowds(ordered, near, same.select("cid", "emb"), bits, window, tile, threshold)
        found = found if crowds is None else found.unionByName(crowds)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = one.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    comps = components(links)

    of = one.join(comps, F.col("cid") == F.col("v")).select("cid", "copies", "emb", F.col("component").alias("comp"))
    of = cut(of)
    members = cut(of.groupBy("comp").agg(F.count(F.lit(1)).alias("m")))
    tiles = F.ceil(F.col("m") / tile).cast("int")
    dealt = join_one(of, members, ["comp"], "m").withColumn("t", tiles).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("t")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("t") - 1))
    left = dealt.select("comp", F.col("mine").alias("i"), others.alias("j"), F.lit(0).alias("side"), "cid", "copies", "emb")
    right = dealt.select("comp", others.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side"), "cid", "copies", "emb")
    part = left.unionByName(right).groupBy("comp", "i", "j").applyInArrow(_count(threshold), "cid long, n long")
    counts = part.groupBy("cid").agg(F.sum("n").alias("n"))
    found = classes.select("cid", "least").join(comps, F.col("cid") == F.col("v"))
    least = cut(found.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m")))
    where = join_one(comps, least, ["component"], "m").select("v", "component_id")
    labels = classes.alias("c").join(where.alias("p"), F.col("c.cid") == F.col("p.v"), "left").join(counts.alias("n"), F.col("c.cid") == F.col("n.cid"), "left")
    labels = labels.select("c.key", "c.copies", (F.col("c.copies") - 1 + F.coalesce("n.n", F.lit(0))).alias("n_links"), F.coalesce("p.component_id", "c.least").alias("component_id"))
    labels = cut(labels)
    release(classes, of, members, least)
    out = join_one(rows.where("key is not null").select("vec_id", "key"), labels, ["key"], "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)


def _blocks(hashed: DataFrame, block: int, window: int) -> tuple[DataFrame, DataFrame]:
    """(pass, block, cid): the sorted order of each pass cut into blocks, each with the window before it; and that order.

    The rank comes from a range sort and the partitions' counts; the order is checkpointed
    first, so it cannot change between the two.
    """
    ordered = hashed.repartitionByRange("pass", "hash", "cid").sortWithinPartitions("pass", "hash", "cid")
    ordered = cut(ordered.withColumn("row", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("row", 33))
    counts = ordered.groupBy("pass", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = W.partitionBy("pass").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    starts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    ranked = ordered.join(starts.select("pass", "part", "base"), ["pass", "part"]).withColumn("rank", F.col("row") + F.col("base"))
    own = F.floor(F.col("rank") / block)
    into_next = F.col("rank") % block >= block - window
    return ranked.select("pass", "cid", F.explode(F.when(into_next, F.array(own, own + 1)).otherwise(F.array(own))).alias("block")), ordered


def near_duplicates(vectors: DataFrame, **options) -> DataFrame:
    """``link`` with ``kept``: the vector with the smallest id of its component."""
    return link(vectors, **options).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS r, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
edges AS (SELECT a.r AS a, b.r AS b FROM good AS a JOIN good AS b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r AS v, vec_id AS c FROM v UNION SELECT edges.b, reach.c FROM reach JOIN edges ON edges.a = reach.v),
comp AS (SELECT v, min(c) AS c FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN comp ON comp.v = v.r LEFT JOIN n ON n.a = v.r
"""
