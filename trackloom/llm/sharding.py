"""Sharding into near-equal byte sizes by histogram sort (native).

Documents are ordered by the hash of their text.  Splitters for the ``shards - 1`` target
positions are found by counting exact bytes below probe keys over all partitions: a first
histogram over the leading bits of the hash, then finer ones only inside the brackets that
hold a target, until each bracket holds at most ``TOLERANCE`` of a shard or one hash.  The
splitter is the nearer edge of its bracket.  Then one exchange deals the rows.

Equal texts have equal hashes, so a group of equal texts stays together as long as a shard
can hold it.  A group larger than a shard (one may hold a third of all rows) is split at the
targets inside it, in the same way, by a hash of the id, then of the place in the input, so rows of
one id and null ids are split as well.

Each round collects one histogram of bounded size (``2**FIRST_BITS`` rows for each shard's
share, later ``shards * 2**STEP_BITS``), whatever the number of documents.  Slots within a
shard are numbered through sub-buckets of about ``ROWS_PER_SUB`` rows, dealt by text and id (by
place where a group was split or an id is null), so no task sorts a whole shard.

Nulls: null text counts as zero bytes and CRC 0 and forms one group with its own
key; a null doc_id sorts before all others.  Repeated rows are rows of one group.  Extra
columns are kept; those named like a result are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, fresh, keyed, md5_long

SHARDS = 40
OVERHEAD = 16
TOLERANCE = 0.01
FIRST_BITS, STEP_BITS = 8, 6
HASH_BITS = 60
ROWS_PER_SUB = 1000
MIN_LONG = -(1 << 63)


def hash_key(text: Column) -> Column:
    return F.coalesce(md5_long(text), F.lit(0).cast("long"))


def id_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(MIN_LONG))


def shifts(shards: int) -> list[int]:
    """Bits left out of the probes, round by round: about 2**FIRST_BITS brackets for each shard at first."""
    first = HASH_BITS - FIRST_BITS - (shards - 1).bit_length()
    return [*range(first, 0, -STEP_BITS), 0]


def locate(rows: DataFrame, goals: dict[int, tuple[int, float]], shards: int, limit: float) -> dict[int, tuple]:
    """Goal -> (area, smallest key, largest key, bytes below in the area, bytes) of its last bracket.

    rows: (area, k, size); goals: (area, bytes from the area's start).
    """
    done, at, old = {}, {}, None
    for shift in shifts(shards):
        inside = rows
        if old is not None:  # at most one bracket for each goal
            wanted = [F.struct(F.lit(a).cast("long").alias("in_area"), F.lit(p).cast("long").alias("in_bracket")) for a, p in sorted({(a, lo >> old) for a, lo, *_ in at.values()})]
            brackets = rows.sparkSession.range(1).select(F.inline(F.array(*wanted)))
            inside = rows.join(F.broadcast(brackets), (F.col("area") == F.col("in_area")) & (F.shiftright("k", old) == F.col("in_bracket")))
        counts = inside.groupBy("area", F.shiftright("k", shift).alias("p")).agg(F.sum("size").alias("b"), F.min("k").alias("lo"), F.max("k").alias("hi"))
        found: dict = {}
        for r in sorted(counts.collect(), key=lambda r: (r.area, r.p)):
            found.setdefault((r.area, None if old is None else r.lo >> old), []).append((r.lo, r.hi, int(r.b)))
        todo, at_next = (goals if old is None else at), {}
        for i in todo:
            area, goal = goals[i]
            parts = found[area, None if old is None else at[i][1] >> old]
            ends = [0 if old is None else at[i][3]]
            for _, _, b in parts:
                ends.append(ends[-1] + b)
            j = min(bisect_right(ends, goal) - 1, len(parts) - 1)
            lo, hi, b = parts[j]
            (done if b <= limit or lo == hi or shift == 0 else at_next)[i] = (area, lo, hi, ends[j], b)
        at, old = at_next, shift
        if not at:
            break
    return done


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """``shards - 1`` keys (h, e): a row belongs to shard i or above if (h, e) >= splitter i.  keys: (h, e, size)."""
    total = int(keys.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0])
    if not total:
        return [(1 << 62, 0)] * (shards - 1)
    ideal = total / shards
    goals = {i: (0, total * i / shards) for i in range(1, shards)}
    near = lambda goal, lo, hi, below, b: lo if goal * 2 <= below * 2 + b else hi + 1
    done, split = {}, {}
    for i, (_, lo, hi, below, b) in locate(keys.select(F.lit(0).cast("long").alias("area"), F.col("h").alias("k"), "size"), goals, shards, tolerance * ideal).items():
        if lo == hi and b > ideal:
            split[i] = (lo, goals[i][1] - below)
        else:
            done[i] = (near(goals[i][1], lo, hi, below, b), MIN_LONG)
    if split:
        rows = keys.where(F.col("h").isin(sorted({h for h, _ in split.values()}))).select(F.col("h").alias("area"), F.col("e").alias("k"), "size")
        for i, (h, lo, hi, below, b) in locate(rows, split, shards, tolerance * ideal).items():
            done[i] = (h, near(split[i][1], lo, hi, below, b))
    return [done[i] for i in range(1, shards)]


def shard_of(h: Column, e: Column, splitters: list[tuple[int, int]]) -> Column:
    """Splitters at or below the key, counted."""
    n = F.lit(0)
    for sh, se in splitters:
        n = n + F.when((h > sh) if se == MIN_LONG else (h > sh) | ((h == sh) & (e >= se)), 1).otherwise(0) + (F.when(h == sh, 1).otherwise(0) if se == MIN_LONG else 0)
    return n


def shard(docs: DataFrame, shards: int = SHARDS, *, text: str = "text", doc_id: str = "doc_id", tolerance: float = TOLERANCE) -> DataFrame:
    """All rows and columns of ``docs`` with size, text_crc32, shard and slot added.

    Columns of ``docs`` with one of those names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "text_crc32", "shard", "slot")])
    h, d, e, sub, a, b = (fresh(docs, x) for x in ("sort_h", "sort_d", "sort_e", "sub", "ka", "kb"))
    rows = keyed(docs, a, b)
    body = F.coalesce(F.col(text), F.lit(""))
    # by id, and by place only among rows of one id
    by_id = md5_long(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    place = md5_long(F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string")))
    split_key = F.shiftleft(F.shiftright(by_id, 20), 20).bitwiseOR(place.bitwiseAND(F.lit((1 << 20) - 1)))
    rows = rows.withColumns({h: hash_key(F.col(text)), d: id_key(F.col(doc_id)), e: split_key, "size": F.octet_length(body).cast("long") + OVERHEAD})
    keys = cut(rows.select(F.col(h).alias("h"), F.col(d).alias("d"), F.col(e).alias("e"), "size"))
    splitters = find_splitters(keys, shards, tolerance)
    subs = max(1, -(-keys.count() // (shards * ROWS_PER_SUB)))
    split = sorted({sh for sh, se in splitters if se != MIN_LONG})

    def with_sub(df: DataFrame, hc: Column, dc: Column, ec: Column) -> DataFrame:
        by_place = (dc == MIN_LONG) | hc.isin(split) if split else dc == MIN_LONG
        turn = F.when(by_place, ec).otherwise(md5_long(F.concat_ws(":", dc.cast("string"), hc.cast("string"))))
        return df.withColumn("shard", shard_of(hc, ec, splitters)).withColumn(sub, (turn % subs).cast("int"))

    counts = with_sub(keys, F.col("h"), F.col("d"), F.col("e")).groupBy("shard", sub).count()
    before = W.partitionBy("shard").orderBy(sub).rowsBetween(W.unboundedPreceding, -1)
    base, first = fresh(docs, "base"), fresh(docs, "first_slot")
    starts = counts.select(F.col("shard").alias(base), F.col(sub).alias(base + "_sub"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first))
    out = with_sub(rows.withColumn("text_crc32", F.crc32(body.cast("binary"))), F.col(h), F.col(d), F.col(e))
    rank = F.row_number().over(W.partitionBy("shard", sub).orderBy(h, d, e))
    out = out.withColumn("slot", rank - 1)
    out = out.join(starts, (F.col("shard") == F.col(base)) & (F.col(sub) == F.col(base + "_sub")))
    return out.withColumn("slot", (F.col("slot") + F.col(first)).cast("long")).drop(h, d, e, sub, a, b, base, base + "_sub", first)


#: For tables without a group of equal texts larger than a shard, whose split depends on places in the files.
ORACLE = f"""
WITH docs AS (
  SELECT doc_id, text, coalesce(strlen(text), 0) + {OVERHEAD} AS size,
         coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, 0) AS h, coalesce(doc_id, {MIN_LONG}) AS d FROM documents),
total AS (SELECT sum(size)::DOUBLE AS t, greatest(1, CAST(ceil(count(*) / {SHARDS * ROWS_PER_SUB}.0) AS BIGINT)) AS subs FROM docs),
hist AS (
  SELECT shift, h >> shift AS p, sum(size) AS b, min(h) AS lo, max(h) AS hi
  FROM docs, (SELECT unnest({shifts(SHARDS)}) AS shift) GROUP BY ALL),
cum AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY shift ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hist),
goal AS (SELECT i, t, t * i / {SHARDS} AS g FROM total, range(1, {SHARDS}) AS r(i)),
bracket AS (
  SELECT * FROM goal JOIN cum ON below <= g AND g < below + b WHERE b <= {TOLERANCE} * t / {SHARDS} OR lo = hi OR shift = 0
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY shift DESC) = 1),
splitter AS (SELECT i, CASE WHEN g * 2 <= below * 2 + b THEN lo ELSE hi + 1 END AS k FROM bracket),
placed AS (
  SELECT h, count(k) AS shard FROM (SELECT DISTINCT h FROM docs) LEFT JOIN splitter ON k <= h GROUP BY h),
crc_table AS (
  SELECT list(v ORDER BY i) AS crc_of FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
hexed AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS x FROM documents),
crc AS (
  SELECT doc_id, text, xor(4294967295, list_reduce(
    [4294967295] || list_transform(range(1, CAST(length(x) // 2 + 1 AS BIGINT)), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM (SELECT DISTINCT * FROM hexed), crc_table),
out AS (
  SELECT g.doc_id, g.text, g.size, p.shard, g.h, g.d, ('0x' || substr(md5(g.d || ':' || g.h), 1, 15))::BIGINT % subs AS sub
  FROM docs g, total JOIN placed p ON p.h = g.h)
SELECT out.doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY sub, h, d) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM out JOIN crc ON out.doc_id IS NOT DISTINCT FROM crc.doc_id AND out.text IS NOT DISTINCT FROM crc.text
"""
