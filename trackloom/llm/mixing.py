"""Mixing sources to target weights by Sainte-Lague apportionment (native).

1. Sizes: words per document; sources in code-point order (null last) get the
   weights in turn; the target total is shared by weight, no source above
   ``max_copies`` times its size, the excess reshared (water level, solved in
   closed form over the small source table).
2. The Sainte-Lague rule gives the blocks of the whole mix (``block`` words each, one by
   default) to sources by highest quotient ``t / (2k + 1)``.
3. Documents are dealt by a hash of id and text into shards of about ``rows_per_shard`` rows,
   so a source that holds a third of all rows is spread over all shards and no task ever
   holds a whole source.  The same rule gives each source's blocks to its shards, top down
   through groups of at most ``FAN`` shards: the integer quota of every cell (shard, source).
   A source's quotas sum to its blocks whatever the number of shards, so a rare source of
   short texts meets its target too.  Only seats near the margin are ranked; seats below the
   margin are certain (a divisor method with rounding misses a quota by at most half a seat
   and half the share of the cells).
4. Within a cell documents stand in a seeded order; whole copies are taken as
   often as the quota allows, the rest as a run of blocks at the start of the order.

Everything is DataFrame expressions.  Nulls: null text has size 0, null source
is a source of its own, a null id is hashed as the text ``null``.  Repeated rows
count as separate documents; which of two with one id and size comes first is arbitrary, so
name further columns in ``order_by`` where that matters.  Extra columns are ignored.  An
empty table gives no rows; a corpus without words takes nothing.  The windows over sources
run over the table of sources, which must fit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, cut, md5_long

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
BLOCK = 1
FAN = 1024
ROWS_PER_SHARD = 1000
SEED = "mix-1"


def source_targets(cells: DataFrame, weights=WEIGHTS, share=SHARE, max_copies=MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row per source.

    The windows here run over the table of sources, not over documents.
    """
    by_source = cells.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    s = by_source.withColumn("weight", weight)
    s = s.withColumn("cap", F.col("source_size") * float(max_copies)).withColumn("level", F.col("cap") / F.col("weight"))
    upto = W.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(all_rows) * share)
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        # the level that holds if this source and all with a higher cap level stay below their caps
        .withColumn("water", (F.col("total") - F.col("cap_before")) / F.col("weight_from"))
    )
    # sources whose cap level is reached are capped; the first that is not fixes the water level
    level = F.min(F.when(F.col("water") < F.col("level"), F.struct("level", F.col("source").isNull().alias("nul"), "source", "water"))).over(all_rows)
    s = s.withColumn("final", level["water"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return s.select("source", "source_size", F.round(target, 6).alias("target"))


def seats(cells: DataFrame, group: list[str], name: str) -> DataFrame:
    """Sainte-Lague: ``cells`` (group, name, want, open) with ``got``, the seats of each cell of its group's ``open``."""
    g = W.partitionBy(*group) if group else W.partitionBy()
    c = cells.withColumn("all", F.sum(F.round("want", 3).cast("decimal(38,3)")).over(g).cast("double")).withColumn("n", F.count(F.lit(1)).over(g))
    near = F.ceil(F.when(F.col("all") > 0, F.col("n") * F.col("want") / F.col("all") / 2).otherwise(0.0)) + 2
    c = c.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.floor("want") - near)).withColumn("last", F.floor("want") + near)
    c = c.withColumn("left", F.col("open") - F.sum("sure").over(g))
    seat = c.withColumn("k", F.explode(F.sequence("sure", "last")))
    rank = g.orderBy((F.col("want") / (2 * F.col("k") + 1)).desc(), F.col(name).asc_nulls_last(), "k")
    won = seat.withColumn("won", ((F.row_number().over(rank) <= F.col("left")) & (F.col("want") > 0)).cast("long"))
    keys = list(dict.fromkeys([*group, name]))
    return won.groupBy(*keys, *[x for x in cells.columns if x not in (*keys, "want", "open")]).agg((F.first("sure") + F.sum("won")).alias("got"))


def source_blocks(targets: DataFrame, block: int) -> DataFrame:
    """``targets`` with ``got``: the blocks of each source."""
    total = F.floor(F.sum(F.round(F.col("target") / block, 3).cast("decimal(38,3)")).over(W.partitionBy()).cast("double") + 0.5)
    return seats(targets.withColumn("want", F.col("target") / block).withColumn("open", total), [], "source")


def quotas(cells: DataFrame, blocks: DataFrame, n_shards: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(shard, source, cell_size, source_size, target, take): words of each cell (shard, source, size); few cells a group at every level."""
    levels = [fan**k for k in range(1, 8) if fan**k < n_shards]
    parents = blocks.select(F.col("source").alias("from"), "source_size", "target", F.col("source_size").alias("of"), "got", F.lit(0).cast("long").alias("up"))
    for step in [*reversed(levels), 1]:  # groups of so many shards inside the groups above
        above = step * fan if step * fan < n_shards else n_shards
        below = cells.groupBy(F.floor(F.col("shard") / step).alias("at"), "source").agg(F.sum("size").alias("size"))
        below = below.withColumn("in", F.floor(F.col("at") * step / above))
        same = F.col("source").eqNullSafe(F.col("from")) & (F.col("in") == F.col("up"))
        want = F.when(F.col("of") > 0, F.col("got") * F.col("size") / F.col("of")).otherwise(0.0)
        c = below.join(parents, same).select("source", "source_size", "target", "in", "at", "size", want.alias("want"), F.col("got").alias("open"))
        done = seats(c, ["source", "in"], "at")
        parents = done.select(F.col("source").alias("from"), "source_size", "target", F.col("size").alias("of"), "got", F.col("at").alias("up"))
    return done.select(F.col("at").alias("shard"), "source", F.col("size").alias("cell_size"), "source_size", "target", F.least(F.col("got") * block, F.col("size") * MAX_COPIES).alias("take"))


def mix(docs: DataFrame, *, weights=WEIGHTS, share=SHARE, block=BLOCK, rows_per_shard=ROWS_PER_SHARD, seed=SEED, order_by: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) and the ``order_by`` columns for every document."""
    more = [F.col(c).alias(f"more_{k}") for k, c in enumerate(order_by)]
    # the text counts too, so rows of one id, or without, are spread
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit(""))))
    sized = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), md5_long(F.concat(F.lit(f"{seed}:"), name)).alias("turn"), *more
    )
    sized = cut(sized)
    n_shards = max(1, -(-sized.count() // rows_per_shard))
    sized = sized.withColumn("shard", F.col("turn") % n_shards)
    cells = sized.groupBy("shard", "source").agg(F.sum("size").alias("size"))
    cells = cut(cells)
    plan = quotas(cells, source_blocks(source_targets(cells, weights, share), block), n_shards, block)

    names = [f"more_{k}" for k in range(len(order_by))]
    before = W.partitionBy("shard", "source").orderBy("turn", "doc_id", "size", *names).rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    d, q = placed.alias("d"), plan.alias("q")
    both = d.join(q, (F.col("d.shard") == F.col("q.shard")) & F.col("d.source").eqNullSafe(F.col("q.source")))
    copies = F.when(F.col("q.cell_size") > 0, F.expr("q.take div q.cell_size")).otherwise(0)
    rest = F.col("q.take") - copies * F.col("q.cell_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("d.size"), rest - F.col("d.start")))
    carried = [F.col(f"d.{n}").alias(c) for n, c in zip(names, order_by)]
    return both.select("d.doc_id", "d.source", "d.size", "q.source_size", "q.target", (copies * F.col("d.size") + part).cast("long").alias("taken"), *carried)


ORACLE = f"""
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / {ROWS_PER_SHARD}.0) AS BIGINT)) AS shards FROM documents),
sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS turn
  FROM documents),
dealt AS (SELECT *, turn % (SELECT shards FROM n) AS shard FROM sized),
cells AS (SELECT shard, source, CAST(sum(size) AS BIGINT) AS size FROM dealt GROUP BY ALL),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM cells GROUP BY ALL),
s1 AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s0),
s2 AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS level FROM s1),
s3 AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(cap) OVER w, 0) AS cap_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_from
  FROM s2 WINDOW w AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT (total - cap_before) / weight_from AS water FROM s3 WHERE (total - cap_before) / weight_from < level
        ORDER BY level, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, round(CASE WHEN (SELECT water FROM lvl) IS NULL THEN cap
         ELSE least(cap, (SELECT water FROM lvl) * weight) END, 6) AS target FROM s3),
seat AS (SELECT source, source_size, target, floor(CAST(sum(CAST(round(target / {BLOCK}, 3) AS DECIMAL(38,3))) OVER () AS DOUBLE) + 0.5) AS open FROM targets),
blocks AS (
  SELECT source, source_size, target, count(*) FILTER (WHERE rank <= open AND target > 0) AS got FROM (
    SELECT *, row_number() OVER (ORDER BY target / {BLOCK} / (2 * k + 1) DESC, source NULLS LAST, k) AS rank
    FROM seat, LATERAL (SELECT unnest(range(0, CAST(floor(target / {BLOCK}) + 40 AS BIGINT))) AS k)) GROUP BY ALL),
want AS (
  SELECT c.shard, c.source, c.size, source_size, target, got, CASE WHEN source_size > 0 THEN got * c.size / source_size ELSE 0 END AS want
  FROM cells c JOIN blocks b ON c.source IS NOT DISTINCT FROM b.source),
plan AS (
  SELECT shard, source, size AS cell_size, source_size, target, least({BLOCK} * count(*) FILTER (WHERE rank <= got AND want > 0), any_value(size) * 2) AS take FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY want / (2 * k + 1) DESC, shard, k) AS rank
    FROM want, LATERAL (SELECT unnest(range(0, CAST(floor(want) + 40 AS BIGINT))) AS k)) GROUP BY ALL),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY shard, source ORDER BY turn, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM dealt)
SELECT d.doc_id, d.size, source_size, target,
       CAST(CASE WHEN cell_size > 0 THEN (take // cell_size) * d.size ELSE 0 END
         + greatest(0, least(d.size, take - CASE WHEN cell_size > 0 THEN (take // cell_size) * cell_size ELSE 0 END - d.start)) AS BIGINT) AS taken
FROM placed d JOIN plan p ON d.shard = p.shard AND d.source IS NOT DISTINCT FROM p.source
"""
