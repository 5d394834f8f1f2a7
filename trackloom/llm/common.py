"""Shared Spark helpers: checkpoint folder, safe column names, hashing keys."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters that separate words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so they need no shared folder to import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="trackloom-zip-")) / "trackloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(to))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; a local master may make one of its own, a cluster may not."""
    ship(spark)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="trackloom-ckpt-")
    spark.sparkContext.setCheckpointDir(named)


_tables: list[tuple[SparkSession, str]] = []


@contextmanager
def _setting(spark: SparkSession, key: str, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    Lineage is cut and the data survive the loss of any executor; unlike checkpoint() the
    plan runs once only.  Spark drops the shuffle files behind a written table when its
    query ends.  ``release`` drops such a table early; the rest go when the driver ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows while tables are cut inside: wide rows keep the workers' memory small."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    for df in tables:
        dirs = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for item in [x for x in _tables if any(d.endswith(x[1].rsplit("/", 1)[-1]) for d in dirs)]:
            _tables.remove(item)
            _delete(*item)


@atexit.register
def _clean() -> None:
    for spark, path in _tables:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, for helper columns."""
    taken = {c.lower() for c in df.columns}
    return stem if stem not in taken else f"{stem}_{uuid.uuid4().hex[:8]}"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def md5_long(c: Column) -> Column:
    """The first 60 bits of md5 as a non-negative long; any SQL engine can compute it."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


#: A key with more than a ``MOST_HOT``-th of all rows is hot; there are fewer than ``MOST_HOT`` of them, whatever the input.
MOST_HOT = 200


def join_one(rows: DataFrame, one: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, a small row for each key; its column ``n`` counts the rows of ``rows`` with that key.

    Rows of a hot key are never dealt by that key: its row of ``one`` is broadcast.  Fewer than
    ``MOST_HOT`` keys can hold a ``MOST_HOT``-th of the rows each, so the broadcast has a fixed bound; every
    other key's rows are a small share of a task.  Without a hot key this is a plain join.
    Neither side is dropped or sampled.  ``one`` is read once more, so it should be a table.
    """
    total, most = one.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).head()
    if most * MOST_HOT <= total:
        return rows.join(one, keys, how)
    is_hot = F.col(n) * MOST_HOT > F.lit(total)
    hot, cold = one.where(is_hot), one.where(~is_hot)
    dealt = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(dealt)


def join_spread(rows: DataFrame, one: DataFrame, key: str, by: str, most: int = 4096) -> DataFrame:
    """``rows`` joined with ``one``, a row of any size for each ``key``: a key of more than ``most`` rows is dealt to several tasks.

    Its row of ``one`` goes to each of them, so copies number at most (rows / ``most``) more than the keys.
    ``by`` deals the rows; ``rows`` is read twice.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("spread_n")).withColumn("spread", F.ceil(F.col("spread_n") / most).cast("int"))
    counts = cut(counts.select(key, "spread_n", "spread"))
    rows = join_one(rows, counts, [key], "spread_n").withColumn("spread", F.pmod(F.xxhash64(by), F.col("spread")).cast("int")).drop("spread_n")
    copies = one.join(counts.select(key, F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("spread")), key)
    return rows.join(copies, [key, "spread"]).drop("spread")


def scanned(df: DataFrame) -> DataFrame:
    """``df`` if it is a scan of files, at most with columns computed and rows filtered; else a table of it."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.child()
    return df if plan.getClass().getSimpleName() == "LogicalRelation" else cut(df)


def keyed(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with two long columns that tell its rows apart and stay the same in every plan over it.

    They are the hash of a row's file and its place in it; what is no plain scan of files is written first.
    """
    df = scanned(df)
    try:
        meta = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(meta["file_path"]).alias(a), meta["row_index"].alias(b))
    except AnalysisException:  # files of a format without row numbers
        return keyed(cut(df.select("*")), a, b)


def crc32_sql(source: str, column: str) -> str:
    """Common table expressions for DuckDB, which has no such function: ``crc`` holds each distinct string of ``column`` with its crc32."""
    return f"""crc_table AS (
  SELECT list(v ORDER BY i) AS crc_of FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
crc AS (
  SELECT {column}, xor(4294967295, list_reduce(
    [4294967295] || list_transform(range(1, CAST(length(x) // 2 + 1 AS BIGINT)), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]))) AS crc32
  FROM (SELECT DISTINCT {column}, hex(encode({column})) AS x FROM {source} WHERE {column} IS NOT NULL), crc_table)"""
