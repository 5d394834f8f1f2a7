"""MinHash near-dedup: bottom-k sketches from one hash function.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes), a 128-bit
   key of that set, and the k smallest hashes: its sketch.
2. Equal sets collapse to one class, so copies are never compared with each other.
3. Inverted lists of retained values give candidates.  Two sets at the threshold share
   about 3/4 of their sketches; at least ``SHARED`` of them is demanded (over five
   standard deviations below).  So each class lists itself only under its rarest
   values, all but the ``SHARED - 1`` commonest (prefix filter): a passage that a third
   of all documents share makes no list of a third of all documents.
4. In each list every member is held against the list's most central one, whose values
   are the most common (a star, not all pairs); the estimate from the union sketch filters, exact Jaccard on full sets
   verifies.
5. Lists that still hold more than one component are compared exactly across components,
   tile by tile; a tile gives a spanning forest of its links, not all of them.

No join is dealt by a key that may hold a large share of the rows: classes of many copies,
common values and central classes are hot keys (``common.join_one``), and the full set of a
class that is compared with many others goes to several tasks (``common.join_spread``).
The pointers of ``graph.components`` are pairs of numbers; a star's join there is left to
Spark's own splitting of skewed partitions.

Nulls and texts without words have an empty set, are linked with nothing, and are their
own component.  A null id never is a component's smallest; a row with a null id outside all
components has a null component.  Repeated rows are copies.  Rows are told apart by their
place in the input, not by id.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_batches, cut, fresh, join_one, join_spread, keyed, release, scanned, ship
from .graph import components
from .shingles import shingle_sets

K = 40
SHARED = 0.375
LEAST_ESTIMATE = 0.44
THRESHOLD = (75, 100)
TILE = 512
BATCH = 1000


def _sign(sets: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(sets).view(np.int64)), int(((sets * np.uint64(0x9E3779B97F4A7C15)) ^ (sets >> np.uint64(17))).sum(dtype=np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


SIGNED = "doc_id long, ka long, kb long, n_shingles long, k1 long, k2 long, sketch array<long>"


def _signatures(k: int):
    def run(batches):
        for b in batches:
            for lo, sets in shingle_sets(b.column(3)):
                keys = [_sign(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).slice(lo, len(sets)) for c in range(3)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()),
                        # hashes of a sorted set are in order; one bit less keeps the order as signed longs
                        _lists([(s[:k] >> np.uint64(1)).view(np.int64) for s in sets]),
                    ],
                    names=["doc_id", "ka", "kb", "n_shingles", "k1", "k2", "sketch"],
                )

    return run


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, ka, kb, n_shingles, k1, k2, sketch) of rows (doc_id, ka, kb, text); k1, k2 are null for an empty set."""
    return docs.select("doc_id", "ka", "kb", "text").mapInArrow(_signatures(k), SIGNED)


def _sets_of(batches):
    """(cid, text) -> (cid, set)."""
    for b in batches:
        for lo, sets in shingle_sets(b.column(1)):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(sets)), _lists([s.view(np.int64) for s in sets])], names=["cid", "elems"])


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, elems): full shingle sets of the given classes (cid, ka, kb), each from its one row of ``docs``."""
    return docs.select("ka", "kb", "text").join(classes, ["ka", "kb"]).select("cid", "text").mapInArrow(_sets_of, "cid long, elems array<long>")


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.asarray(col.offsets)
    return np.asarray(col.values), off


def _verify(num: int, den: int):
    def run(batches):
        for b in batches:
            (av, ao), (bv, bo) = _flat(b.column(2)), _flat(b.column(3))
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                if den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])

    return run


def _across(num: int, den: int):
    """Links across components among the rows of one pair of tiles; a forest of them."""

    def run(table: pa.Table) -> pa.Table:
        cid, comp, side = (np.asarray(table.column(n).combine_chunks()) for n in ("cid", "comp", "side"))
        v, o = _flat(table.column("elems").combine_chunks())
        size = np.diff(o)
        owner = np.repeat(np.arange(len(cid)), size)
        v = v[o[0] : o[-1]]
        order = np.argsort(v, kind="stable")
        vs, os_ = v[order], owner[order]
        roots = {int(c): int(c) for c in comp}

        def find(c):
            while roots[c] != c:
                roots[c] = roots[roots[c]]
                c = roots[c]
            return c

        out = []
        for i in np.flatnonzero(side == 0):
            mine = v[o[i] - o[0] : o[i + 1] - o[0]]
            lo, hi = np.searchsorted(vs, mine, "left"), np.searchsorted(vs, mine, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(os_[at], minlength=len(cid))
            hit = np.flatnonzero(den * both >= num * (size + size[i] - both))
            for j in hit:
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y:
                    roots[max(x, y)] = min(x, y)
                    out.append((int(cid[i]), int(cid[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def estimate(a: Column, b: Column, k: int = K) -> Column:
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def link(docs: DataFrame, *, k: int = K, threshold: tuple[int, int] = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id, stays) for every row of ``docs``.

    stays: of each component one row, that with the smallest id (the first one of repeated rows; null
    ids last), and every row with an empty set.
    """
    ship(docs.sparkSession)
    rows = keyed(docs, key_a := fresh(docs, "ka"), key_b := fresh(docs, "kb"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key_a).alias("ka"), F.col(key_b).alias("kb"), "text")
    with arrow_batches(docs.sparkSession, BATCH):
        return _link(rows, k, threshold, tile)


def _link(docs: DataFrame, k: int, threshold: tuple[int, int], tile: int) -> DataFrame:
    signed = cut(signatures(docs, k))
    who = F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "ka", "kb")
    classes = signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min(who).alias("who"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    sketches = classes.select("cid", "sketch")

    values = sketches.select("cid", F.greatest(F.lit(1), F.floor(F.size("sketch") * SHARED)).cast("int").alias("t"), F.explode("sketch").alias("v"))
    often = cut(values.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1"))
    shared = join_one(values, often, ["v"], "f").groupBy("cid").agg(
        F.max("t").alias("t"), F.sum("f").alias("score"), F.sort_array(F.collect_list(F.struct("f", "v"))).alias("vs")
    )
    shared = shared.where(F.size("vs") >= F.col("t"))
    listed = shared.select("cid", "score", F.explode(F.slice("vs", F.lit(1), F.size("vs") - F.col("t") + 1)).alias("x"))
    listed = cut(listed.select("cid", "score", "x.v"))

    heads = cut(listed.groupBy("v").agg(F.max(F.struct("score", "cid"))["cid"].alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    pairs = join_one(listed, heads, ["v"], "m").where("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
    pairs = cut(pairs.join(sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("sb")), "b"))
    met = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    met = cut(met.join(sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("sa")), "a"))
    near = join_one(pairs, met, ["a"], "n").where(estimate(F.col("sa"), F.col("sb"), k) >= LEAST_ESTIMATE)
    near = cut(near.select("a", "b"))

    needed = listed.join(heads.select("v"), "v", "left_semi").select("cid").distinct()
    sets = cut(full_sets(docs, classes.join(needed, "cid", "left_semi").select("cid", "who.ka", "who.kb")))
    rows = near.join(sets.select(F.col("cid").alias("b"), F.col("elems").alias("eb")), "b")
    rows = join_spread(rows, sets.select(F.col("cid").alias("a"), F.col("elems").alias("ea")), "a", "b").select("a", "b", "ea", "eb")
    links = cut(rows.mapInArrow(_verify(*threshold), "a long, b long"))
    comps = components(links)

    # lists that still hold several components: compare across, exactly
    by_class = listed.alias("l").join(comps.alias("p"), F.col("l.cid") == F.col("p.v"), "left")
    placed = cut(by_class.select("l.v", "l.cid", F.coalesce("p.component", "l.cid").alias("comp")))
    of = placed.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_ = of.groupBy("v").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("m")).where("parts > 1 and m > 2")
    open_ = cut(open_.select("v", "m", F.col("top.comp").alias("top"), F.col("top.n").alias("mains")))
    rest = join_one(placed, open_, ["v"], "m").select("v", "cid", "comp", (F.col("comp") == F.col("top")).cast("int").alias("major"), "m", "mains")
    more = cut(_tiles(rest, sets, tile, threshold))
    if more.head(1):
        comps = components(links.unionByName(more))
    labels = classes.alias("c").join(comps.alias("p"), F.col("c.cid") == F.col("p.v"), "left").select("c.k1", "c.k2", "c.who", "c.copies", F.coalesce("p.component", "c.cid").alias("comp"))
    labels = cut(labels)
    least = cut(labels.groupBy("comp").agg(F.min("who").alias("least"), F.count(F.lit(1)).alias("n")))
    labels = join_one(labels, least, ["comp"], "n").select("k1", "k2", "copies", F.col("least.doc_id").alias("component_id"), F.col("least.ka").alias("la"), F.col("least.kb").alias("lb"))
    labels = cut(labels)
    release(classes, often, listed, heads, pairs, met, near, sets, placed, open_, least)
    full = signed.where("k1 is not null").select("doc_id", "ka", "kb", "n_shingles", "k1", "k2")
    full = join_one(full, labels, ["k1", "k2"], "copies")
    out = full.select("doc_id", "ka", "kb", "n_shingles", "component_id", ((F.col("ka") == F.col("la")) & (F.col("kb") == F.col("lb"))).alias("stays"))
    empty = signed.where("k1 is null").select("doc_id", "ka", "kb", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return out.unionByName(empty)


def _tiles(rest: DataFrame, sets: DataFrame, tile: int, threshold: tuple[int, int]) -> DataFrame:
    """Links across components within each list.  rest: (v, cid, comp, major, m, mains).

    Members of the list's main component and the others are dealt into tiles apart, so
    two tiles of the main component never meet; a list of n members is worked off by
    tasks of two tiles each.
    """
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / tile)).cast("int")
    rest = rest.withColumn("n0", tiles(F.col("m") - F.col("mains"))).withColumn("n1", tiles(F.col("mains")))
    mine = F.pmod(F.xxhash64("cid"), F.when(F.col("major") == 1, F.col("n1")).otherwise(F.col("n0"))).cast("int") * 2 + F.col("major")
    rest = rest.withColumn("tile", mine)
    # even tiles hold others, odd ones the main component; every even tile meets every tile, its own kind only once
    even = F.transform(F.sequence(F.lit(0), F.col("n0") - 1), lambda x: x * 2)
    odd = F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda x: x * 2 + 1)
    as_left = rest.where("major = 0").select("v", "cid", "comp", F.col("tile").alias("i"), F.explode(F.concat(even, odd)).alias("j"), F.lit(0).alias("side"))
    as_right = rest.select("v", "cid", "comp", F.explode(even).alias("i"), F.col("tile").alias("j"), F.lit(1).alias("side"))
    placed = as_left.where("i <= j or j % 2 = 1").unionByName(as_right.where("i <= j or j % 2 = 1"))
    placed = placed.join(sets, "cid")
    return placed.groupBy("v", "i", "j").applyInArrow(_across(*threshold), "a long, b long")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept); kept: the document with the smallest id of its component."""
    out = link(docs, **options).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and all with an empty set."""
    docs = scanned(docs)  # once: the keys must be the same in both plans
    rows = keyed(docs, key_a := fresh(docs, "ka"), key_b := fresh(docs, "kb"))
    gone = link(docs, **options).where("not stays").select(F.col("ka").alias(key_a), F.col("kb").alias(key_b))
    return rows.join(gone, [key_a, key_b], "left_anti").select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh FROM w),
cls AS (SELECT sh, min(doc_id) AS id, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT id, n, unnest(sh) AS x FROM cls),
pairs AS (SELECT a.id AS a, b.id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.id < b.id
          GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT id AS v, id AS r FROM cls UNION SELECT edges.b, reach.r FROM reach JOIN edges ON edges.a = reach.v),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c, s.doc_id) AS component_id, s.doc_id = coalesce(c, s.doc_id) AS kept
FROM s LEFT JOIN cls ON s.sh = cls.sh LEFT JOIN comp ON comp.v = cls.id
"""
