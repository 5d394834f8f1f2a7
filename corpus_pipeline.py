"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame; all but the last return the columns of ``documents``.  ``run`` writes
each stage's result to the shared checkpoint folder and reads it back for the next one.

1. language_id keeps texts that are in a known language (``langid.accepted``).
2. minhash_neardup keeps one document of each near-duplicate group.
3. decontamination drops documents that hold a benchmark item.
4. mixing repeats each document as often as the mix takes it: ``taken`` words of a document
   of ``size`` words make taken // size copies, plus one more, with probability equal to
   the remaining share, by a seeded hash of its columns, so that the same rows give the same
   copies however they lie in files.  Documents without words stay once.
5. sharding deals all rows into shards of near-equal bytes and numbers them.

Every decision is made and carried out row by row: rows are told apart by their place in the
stage's input (``common.keyed``), never by id, so null and repeated ids lose nothing.

Nulls: a row with a null text is rejected by the first stage; null ids and sources are
handled as in the operators.  Repeated rows are copies: the second stage keeps one.  Extra
columns, whatever their names, are carried along; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.llm import decontam, langid, mixing, neardup, sharding
from trackloom.llm.common import cut, fresh, keyed, md5_long, read, scanned

LEAST_SCORE = 0.5
SEED = "pipeline-mix-1"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language; null, letterless and foreign texts go."""
    return langid.accepted(docs, least=LEAST_SCORE)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest id, the first of repeated rows; null ids come last."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, which can be never."""
    docs = scanned(docs)
    a, b, what, times, copy = (fresh(docs, x) for x in ("ka", "kb", "what", "times", "copy"))
    # rows with equal contents are interchangeable; their places only tell them apart
    contents = F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if "map<" not in kind))
    rows = keyed(docs, a, b)
    plan = mixing.mix(rows.withColumn(what, contents), order_by=(what, a, b))
    # at most one row of each source and shard of the mix has a share left, so equal rows need no further number
    turn = md5_long(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(what).cast("string")))
    more = (turn % F.col("size") < F.col("taken") % F.col("size")).cast("long")
    n = F.when(F.col("size") > 0, F.expr("taken div size") + more).otherwise(1).cast("int")
    plan = plan.select(F.col(a), F.col(b), n.alias(times))
    both = rows.join(plan, [a, b]).where(F.col(times) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, text_crc32, shard and slot."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_neardup", minhash_neardup),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the language model and the fingerprints; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
