"""Difference of two snapshots, with rows that only changed their key found again.

Rows become narrow records: key, side, a digest of each compared column (16 bytes of sha256;
null is none), a digest of them all, the later row's hash.  Texts never leave the scan.

1. *Equal keys.*  Records of both sides are dealt by ranges of (key, content) and sorted
   within partitions (``repartitionAndSortWithinPartitions``), so each partition is the
   merge of the earlier and the later side.  A generator reads it with two cursors and gives
   a pair or a single record for each key.  Keys at the two ends of a partition, which may
   go on in the next one, and keys with several records of a side are passed on.
2. *Those keys, then equal contents,* both by ``pair_by_rank``: records are dealt by ranges of
   (group, side, directed order) and sorted, which ranks them within group and side (counts
   of the groups at the partitions' ends make ranks run on from one partition to the next);
   then (group, rank) deals them again, sorted by side, and a second generator pairs
   neighbours.  Content is paired with the earlier keys ascending, the later ones descending.

Ranges split a group anywhere, ranks deal it evenly: a key, or a content, with a third of all
rows is spread over a third of the partitions in every step, and generators hold two records.
The driver sees a sample of ``SAMPLE`` keys for each partition, as any sort by ranges does,
and two runs' counts of each partition.

Nulls: columns are equal if both are null; null keys equal null keys.  Repeated keys: of a
key's rows the i-th earlier one, by content digest, pairs with the i-th later one; what is
left over goes on to the contents.  Ties in all (repeated rows) are told apart by their place
and are interchangeable.  Empty tables give only inserts, only deletes, or nothing; texts of any
length are hashed whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import crc32_sql, cut, ensure_checkpoint_dir

COLUMNS = ("text", "lang", "source")
SAMPLE = 20
RECORD = "key long, side int, content binary, digests array<binary>, sha string, salt long"
FIELDS = [x.split()[0] for x in RECORD.split(", ")]
KEY, SIDE, CONTENT, DIGESTS, SHA, SALT = range(6)
RESULT = "key long, old_key long, op string, changed string, row_sha256 string"


def digest(c: Column) -> Column:
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def records(rows: DataFrame, side: int, key: str, columns: tuple[str, ...]) -> DataFrame:
    """RECORD of every row; a record without a digest at some place had a null there."""
    own = [F.col(c).cast("string") for c in columns]
    found = F.array(*(digest(c) for c in own))
    sha = F.sha2(F.concat_ws("\n", *(F.coalesce(c, F.lit("~")) for c in own)), 256) if side else F.lit(None).cast("string")
    rows = rows.select(F.col(key).cast("long").alias("key"), F.lit(side).alias("side"), found.alias("digests"), sha.alias("sha"), F.monotonically_increasing_id().alias("salt"))
    content = F.concat(*(F.coalesce(F.concat(F.lit(b"\x01"), F.col("digests")[k]), F.lit(b"\x00")) for k in range(len(columns))))
    content = F.substring(F.unhex(F.sha2(content, 256)), 1, 16)
    return rows.select("key", "side", content.alias("content"), "digests", "sha", "salt")


def _bytes(row: tuple) -> tuple:
    """A row of RECORD with plain bytes."""
    key, side, content, digests, sha, salt = row
    return key, side, bytes(content), tuple(None if d is None else bytes(d) for d in digests), sha, salt


def _ordered(key: int | None) -> tuple:
    return (0, 0) if key is None else (1, key)


def _by_key(r: tuple) -> tuple:
    """Sort key of the first step; ranges are told by all but the side."""
    return *_ordered(r[KEY]), r[SIDE], r[CONTENT], r[SALT]


def _key_range(k: tuple) -> tuple:
    return k[:2] + k[3:]


def _key_group(r: tuple) -> tuple:
    """(group, side, directed order ..., salt) for rows of one key."""
    return _ordered(r[KEY]), r[SIDE], r[CONTENT], r[SALT]


def _content_group(r: tuple) -> tuple:
    """Later keys descend, null keys are the smallest."""
    there, key = _ordered(r[KEY])
    return (r[CONTENT], r[SIDE], -there, ~key, r[SALT]) if r[SIDE] else (r[CONTENT], r[SIDE], there, key, r[SALT])


def _same(k: tuple) -> tuple:
    return k


def _range_of(k: tuple, splitters: list[tuple], told_by: Callable[[tuple], tuple]) -> int:
    return bisect_right(splitters, told_by(k))


def dealt(rows: RDD, n: int, total: int, by: Callable[[tuple], tuple], told_by: Callable[[tuple], tuple] = _same) -> RDD:
    """Pairs (sort key, record) in ``n`` sorted partitions of about equal size, ordered by ``told_by`` of the sort key."""
    if n == 1 or not total:
        splitters: list[tuple] = []
    else:
        share = min(1.0, SAMPLE * n / total)
        sample = sorted(told_by(by(r)) for r in rows.sample(False, share, 17).collect())
        splitters = [sample[len(sample) * k // n] for k in range(1, n)] if sample else []
    return rows.map(lambda r: (by(r), r)).repartitionAndSortWithinPartitions(n, partial(_range_of, splitters=splitters, told_by=told_by))


def merge(rows: Iterator[tuple]) -> Iterator[tuple]:
    """('pair', earlier, later), ('one', record, None) or ('again', record, None) from one partition sorted by key and side.

    ``held`` has the earlier and the later cursor's record of the current key.
    """
    held: list = [None, None]
    current, sure, started = None, False, False

    def close(sure: bool) -> Iterator[tuple]:
        if held[0] is not None and held[1] is not None and sure:
            yield "pair", held[0], held[1]
        else:
            for r in held:
                if r is not None:
                    yield "one" if sure else "again", r, None

    for k, r in rows:
        if not started or k[:2] != current:
            if started:
                yield from close(sure)
            current, sure, started, held = k[:2], started, True, [None, None]  # the first key may have begun before
        if held[r[SIDE]] is None:
            held[r[SIDE]] = r
        else:
            sure = False
            yield "again", r, None
    yield from close(False)  # the last key may go on


def _runs(number: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(partition, first run, its rows, last run, its rows) of (group, side)."""
    first = last = None
    n = n_first = 0
    for k, _ in rows:
        if k[:2] != last:
            if last is not None and n_first == 0:
                n_first = n
            last, n = k[:2], 0
            first = first or last
        n += 1
    if last is not None:
        yield number, first, n_first or n, last, n


def _ranked(number: int, rows: Iterator[tuple], before: dict[int, int]) -> Iterator[tuple]:
    """((group, rank, side), record); ranks of the first run go on from the partitions before."""
    last, rank = None, before.get(number, 0)
    for k, r in rows:
        if k[:2] != last:
            if last is not None:
                rank = 0
            last = k[:2]
        yield (k[0], rank, k[1]), r
        rank += 1


def _rank_hash(k: tuple) -> int:
    return hash((k[0] if isinstance(k[0], bytes) else str(k[0]), k[1]))


def _neighbours(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Pairs from a partition sorted by (group, rank, side): two cursors, an earlier and the next record."""
    held = None
    for k, r in rows:
        if held is not None and held[0] == k[:2] and r[SIDE] != held[1][SIDE]:
            yield "pair", held[1], r
            held = None
        else:
            if held is not None:
                yield "one", held[1], None
            held = k[:2], r
    if held is not None:
        yield "one", held[1], None


def pair_by_rank(rows: RDD, n: int, total: int, by: Callable[[tuple], tuple]) -> RDD:
    """('pair', earlier, later) of the i-th records of both sides of each group, else ('one', record, None).

    ``by`` gives a record's (group, side, order ...); orders are distinct within group and side.
    """
    placed = dealt(rows, n, total, by)
    before, run, count = {}, None, 0
    for number, first, n_first, last, n_last in sorted(placed.mapPartitionsWithIndex(_runs).collect()):
        if first == run:
            before[number] = count
            n_first += count
        run, count = last, n_first if first == last else n_last
    ranked = placed.mapPartitionsWithIndex(partial(_ranked, before=before))
    return ranked.repartitionAndSortWithinPartitions(n, _rank_hash).mapPartitions(_neighbours)


def _verdict(found: tuple, columns: tuple[str, ...], rekey: bool) -> tuple:
    kind, a, b = found
    if kind == "pair":
        changed = ",".join(c for c, x, y in zip(columns, a[DIGESTS], b[DIGESTS]) if x != y)
        return b[KEY], a[KEY], "rekey" if rekey else "update" if changed else "same", changed, b[SHA]
    return (a[KEY], None, "insert", "", a[SHA]) if a[SIDE] else (a[KEY], a[KEY], "delete", "", None)


def _table(spark: SparkSession, found: RDD, columns: tuple[str, ...], rekey: bool, last: bool = False) -> DataFrame:
    """Results of the pairs, and the records that go on: a table of ``step`` (pair, one, again), RESULT and RECORD."""

    def row(x: tuple) -> tuple:
        if x[0] == "pair" or last:
            return "pair", *_verdict(x, columns, rekey), *(None,) * len(FIELDS)
        return x[0], *(None,) * 5, *x[1]

    mine = ", ".join(f"r_{f}" for f in RECORD.split(", "))
    return cut(spark.createDataFrame(found.map(row), f"step string, {RESULT}, {mine}", verifySchema=False))


def compare(earlier: DataFrame, later: DataFrame, *, key: str = "doc_id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """A row for each pair, insert and delete: key, old_key, op, changed, row_sha256.  ``key`` is a whole number."""
    spark = earlier.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"r_{f} AS {f}" for f in FIELDS]
    both = records(earlier, 0, key, columns).unionByName(records(later, 1, key, columns))
    both = cut(both)  # hashed once; read twice, by the sample and the sort
    rows, total = both.rdd.map(_bytes), both.count()
    first = _table(spark, dealt(rows, n, total, _by_key, _key_range).mapPartitions(merge), columns, False)
    steps = {r[0]: r[1] for r in first.groupBy("step").count().collect()}
    again = first.where("step = 'again'").selectExpr(*names).rdd.map(_bytes)
    second = _table(spark, pair_by_rank(again, n, steps.get("again", 0), _key_group), columns, False)
    single = first.where("step = 'one'").unionByName(second.where("step = 'one'")).selectExpr(*names)
    left = steps.get("one", 0) + second.where("step = 'one'").count()
    third = _table(spark, pair_by_rank(single.rdd.map(_bytes), n, left, _content_group), columns, True, last=True)
    result = [x.split()[0] for x in RESULT.split(", ")]
    done = lambda t: t.where("step = 'pair'").select(*result)
    return done(first).unionByName(done(second)).unionByName(done(third))


def later_snapshot(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, text, lang, source) of a made-up later snapshot; the crc32 of a row's key says what happens to it, a null key's row stays."""
    hit = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10, F.lit(9))
    new = -1 - F.col(key)
    rows = docs.select(F.col(key).alias("id"), "text", "lang", "source", hit.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text"))
    swap = F.col("hit") == 2
    lang, source = F.when(swap, F.col("source")).otherwise(F.col("lang")), F.when(swap, F.col("lang")).when(F.col("hit") != 4, F.col("source"))
    ids = F.when(F.col("hit").isin(3, 4), F.array(-1 - F.col("id"))).when(F.col("hit") == 5, F.array(F.col("id"), -1 - F.col("id"))).otherwise(F.array("id"))
    return rows.select(F.explode(ids).alias(key), text.alias("text"), lang.alias("lang"), source.alias("source"))


#: For tables without repeated ids.
ORACLE = f"""
WITH named AS (SELECT *, CAST(doc_id AS VARCHAR) AS crc_key FROM documents),
{crc32_sql("named", "crc_key")},
hit AS (SELECT doc_id, text, lang, source, coalesce(crc32 % 10, 9) AS hit FROM named LEFT JOIN crc USING (crc_key)),
later AS (
  SELECT CASE WHEN hit IN (3, 4) OR copy = 1 THEN -1 - doc_id ELSE doc_id END AS key, CASE hit WHEN 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
         CASE hit WHEN 2 THEN source ELSE lang END AS lang, CASE hit WHEN 2 THEN lang WHEN 4 THEN NULL ELSE source END AS source
  FROM hit, range(CASE hit WHEN 0 THEN 0 WHEN 5 THEN 2 ELSE 1 END) AS copies(copy)),
earlier AS (SELECT doc_id AS key, text, lang, source FROM documents),
by_key AS (
  SELECT b.key, a.key AS old_key, a.text IS DISTINCT FROM b.text AS t, a.lang IS DISTINCT FROM b.lang AS l, a.source IS DISTINCT FROM b.source AS s, b.text, b.lang, b.source
  FROM earlier a JOIN later b ON a.key IS NOT DISTINCT FROM b.key),
gone AS (
  SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY key NULLS FIRST) AS i
  FROM earlier a WHERE NOT EXISTS (SELECT 1 FROM later b WHERE a.key IS NOT DISTINCT FROM b.key)),
come AS (
  SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY key DESC NULLS LAST) AS i
  FROM later b WHERE NOT EXISTS (SELECT 1 FROM earlier a WHERE a.key IS NOT DISTINCT FROM b.key)),
by_content AS (
  SELECT a.key AS old_key, b.key, a.i IS NOT NULL AS was, b.i IS NOT NULL AS is_now, b.text, b.lang, b.source
  FROM gone a FULL JOIN come b ON a.i = b.i AND a.text IS NOT DISTINCT FROM b.text AND a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source),
found AS (
  SELECT key, old_key, CASE WHEN t OR l OR s THEN 'update' ELSE 'same' END AS op,
         concat_ws(',', CASE WHEN t THEN 'text' END, CASE WHEN l THEN 'lang' END, CASE WHEN s THEN 'source' END) AS changed, text, lang, source FROM by_key
  UNION ALL
  SELECT CASE WHEN is_now THEN key ELSE old_key END, old_key, CASE WHEN NOT is_now THEN 'delete' WHEN was THEN 'rekey' ELSE 'insert' END, '', text, lang, source FROM by_content)
SELECT key, old_key, op, changed,
       CASE WHEN op <> 'delete' THEN sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) END AS row_sha256
FROM found
"""
