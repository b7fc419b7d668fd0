"""Table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from finlake.operators.ordered import exact_quantiles


def profile(df: DataFrame, n: int = 5) -> dict:
    """Row and column count, schema and a few rows."""
    return {"rows": df.count(), "columns": len(df.columns), "schema": df.schema, "sample": df.limit(n)}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def describe_all(df: DataFrame) -> DataFrame:
    """One row per column: count, unique, top and its frequency, mean, deviation, quartiles.

    Text columns have the first group of measures, numbers the second. Values
    are counted per (column, value) first; that table is spread over all
    tasks and everything else is read off it, so no column is held in one
    place, as exact distinct, mode and percentile aggregates would.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    text = [f.name for f in df.schema.fields if f.name not in numeric]
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 (F.col(c).cast("string") if c in text else F.lit(None).cast("string")).alias("word"),
                 (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"))
        for c in df.columns
    ])).alias("c")).select("c.*").where(F.col("word").isNotNull() | F.col("number").isNotNull())

    words = cells.where(F.col("word").isNotNull()).groupBy("column", "word").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct(F.col("n"), F.col("word")))
    texts = words.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), top["word"].alias("top"), top["n"].alias("freq"))

    figures = cells.where(F.col("number").isNotNull())
    moments = figures.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("number").alias("mean"),
        F.stddev_samp("number").alias("std"),
        F.min("number").alias("min"), F.max("number").alias("max"))
    q = exact_quantiles(figures, ["column"], "number", (0.25, 0.5, 0.75))
    quartiles = q.groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
        for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
    ])
    return texts.unionByName(moments.join(quartiles, "column"), allowMissingColumns=True).select(
        "column", "count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max")
