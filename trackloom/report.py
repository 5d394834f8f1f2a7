"""Evaluation reports from the command line.

    python -m trackloom.report detection payload.json
    python -m trackloom.report events payloads/ --lines --tolerance 1 --out report.json

Payloads hold ``predictions`` and ``ground_truths`` (queries: ``cases``) and lie on any storage that
Spark reads; with ``--lines`` there is one a line, in any number of files.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.text import query_problem
from .operators import evaluation as V
from .sources import sequences as S, sinks

EVENT = "event_type string, sequence_id string, frame_id int, primary_track_id long, secondary_track_id long"


def _boxes(rows: DataFrame) -> DataFrame:
    return rows.select("*", *(F.col("bbox")[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2")))).drop("bbox")


def detection(spark: SparkSession, path: str, lines: bool = False) -> dict:
    """map_50, map_50_95 and the average precision of every class and threshold."""
    preds, truths = (_boxes(x) for x in S.evaluation(spark, path, "image_id string, class_id int, bbox array<double>, confidence double", lines))
    ap = V.average_precision(preds, truths.drop("confidence"))
    each = {f"{r.class_id}@{r.threshold:.2f}": r.ap for r in ap.orderBy("class_id", "threshold").collect()}  # a few for each class
    return {**V.mean_average_precision(ap).head().asDict(), "ap": each}


def tracking(spark: SparkSession, path: str, lines: bool = False, threshold: float = 0.5) -> dict:
    fields = "sequence_id string, frame_id int, track_id long, bbox array<double>"
    preds, truths = (_boxes(x).fillna("", ["sequence_id"]) for x in S.evaluation(spark, path, fields, lines))
    return V.tracking_metrics(preds, truths, threshold).head().asDict()


def events(spark: SparkSession, path: str, lines: bool = False, tolerance: int = 0) -> dict:
    return V.event_metrics(*S.evaluation(spark, path, EVENT, lines), tolerance).head().asDict()


def queries(spark: SparkSession, path: str) -> dict:
    fine = lambda c: query_problem(F.col(c)).isNull()
    same: Column = F.array_sort("expected_results") == F.array_sort("actual_results")
    cases = S.evaluation_cases(spark, path).select(
        fine("first_attempt_cypher").alias("first_valid"), fine("final_cypher").alias("final_valid"), F.coalesce(same, F.lit(False)).alias("results_equal"),
        (~F.col("first_attempt_cypher").eqNullSafe(F.col("final_cypher"))).alias("retried"),
    )
    return V.query_metrics(cases).head().asDict()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(prog="python -m trackloom.report", description="Metrics of an evaluation payload as JSON.")
    p.add_argument("kind", choices=("detection", "tracking", "events", "queries"))
    p.add_argument("path")
    p.add_argument("--lines", action="store_true", help="a payload a line")
    p.add_argument("--tolerance", type=int, default=0, help="frames between an event and its truth")
    p.add_argument("--threshold", type=float, default=0.5, help="least overlap of a track and its truth")
    p.add_argument("--out", help="also write the report to this file")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.kind == "detection":
        found = detection(spark, a.path, a.lines)
    elif a.kind == "tracking":
        found = tracking(spark, a.path, a.lines, a.threshold)
    elif a.kind == "events":
        found = events(spark, a.path, a.lines, a.tolerance)
    else:
        found = queries(spark, a.path)
    return sinks.report(found, a.out)


if __name__ == "__main__":
    print(main())
