"""Result digests: bounded summaries of any DataFrame for a reader or a language model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

VALUES, SAMPLES = 10, 3


def numeric(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, min_value, max_value, avg_value) of the numeric columns, rounded to 4; booleans count as numbers."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    kind = {f.name: f.dataType for f in df.schema}
    value = {n: F.col(n).cast("int") if isinstance(kind[n], T.BooleanType) else F.col(n) for n in names}
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.struct(*(F.round(f(value[n]).cast("double"), 4).alias(k) for k, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg)))).alias(f"c_{i}") for i, n in enumerate(names)))
    parts = [one.select(F.lit(n).alias("column_name"), "n_rows", F.col(f"c_{i}.lo").alias("min_value"), F.col(f"c_{i}.hi").alias("max_value"), F.col(f"c_{i}.mean").alias("avg_value")) for i, n in enumerate(names)]
    return reduce(DataFrame.unionByName, parts)


def values(df: DataFrame, columns: list[str], most: int = VALUES) -> DataFrame:
    """(column_name, n_values, shown): the distinct values of columns as texts, the first ones in order, with "+n more" behind them.

    Each column is one top-k of its distinct values; no column's values come together in one task.
    """
    parts = []
    for c in columns:
        d = df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct()
        first = d.orderBy("v").limit(most).agg(F.sort_array(F.collect_list("v")).alias("vs"))  # at most ``most`` values
        n = d.agg(F.count(F.lit(1)).alias("n_values"))
        more = F.when(F.col("n_values") > most, F.array(F.concat(F.lit("+"), (F.col("n_values") - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
        parts.append(n.crossJoin(first).select(F.lit(c).alias("column_name"), "n_values", F.concat_ws(", ", F.concat("vs", more)).alias("shown")))  # two single rows
    return reduce(DataFrame.unionByName, parts)


def summary(df: DataFrame, values: int = VALUES, columns: int = 5) -> dict:
    """Row count, sorted columns, distinct values of the first columns (as strings, capped with "+n more"), numbers, samples.

    Only distinct values up to the cap and a few samples reach the driver.
    """
    names = sorted(df.columns)
    distinct = {}
    for n in names[:columns]:
        d = df.select(F.col(n).cast("string").alias("v")).where("v is not null").distinct()
        more = d.count() - values
        distinct[n] = [r[0] for r in d.orderBy("v").limit(values).collect()] + ([f"+{more} more"] if more > 0 else [])
    numbers = {r["column_name"]: (r["min_value"], r["max_value"], r["avg_value"]) for r in numeric(df).collect()} if any(isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in df.schema) else {}
    return {"rows": df.count(), "columns": names, "values": distinct, "numbers": numbers, "samples": [r.asDict() for r in df.limit(SAMPLES).collect()]}
