"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local master may make one of its own, a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trackloom-"))
    return jsc.getCheckpointDir().get()


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_once(df: DataFrame) -> DataFrame:
    """``df`` as a table, computed once however many plans read it; it survives the loss of any executor.

    ``release`` drops it early; otherwise it goes when the driver ends.
    """
    path = f"{folder(df.sparkSession)}/once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables of ``write_once`` that no later plan reads."""
    for df in tables:
        folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        for item in [x for x in _written if x[1].rsplit("/", 1)[-1] in folders]:
            _written.remove(item)
            _delete(*item)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return
