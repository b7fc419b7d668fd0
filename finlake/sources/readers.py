"""File sources."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from finlake.functions.parsing import NA_VALUES, snake
from finlake.operators.adhoc import VIEW

# File types of the router.
TABULAR = (".csv",)
DIRECT = {".json": "json", ".parquet": "parquet"}
TEXT = (".txt", ".md")


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with inferred types: the untouched bronze input. Inference costs one more pass."""
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path)


def read_csv_strings(spark: SparkSession, path: str, cols: Sequence[str],
                     na_values: Sequence[str] = NA_VALUES) -> DataFrame:
    """Header CSV with every column as text; missing-value tokens become null before any trimming."""
    schema = StructType([StructField(c, StringType(), True) for c in cols])
    raw = spark.read.option("header", "true").option("enforceSchema", "false").schema(schema).csv(path)
    return raw.select(*[F.when(~F.col(c).isin(*na_values), F.col(c)).alias(c) for c in cols])


def read_staged_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header line, optional double quotes and a given schema."""
    return spark.read.option("header", "true").option("quote", '"').option("escape", '"').schema(schema).csv(path)


def load_upload(spark: SparkSession, path: str, view: str = VIEW) -> tuple[list[str], int]:
    """Register a Latin-1 CSV upload under ``view``, replacing the one before; returns columns and row count."""
    if os.path.splitext(path)[1].lower() not in TABULAR:
        raise ValueError(f"Unsupported file type: {os.path.splitext(path)[1]}")
    raw = (
        spark.read.option("header", "true").option("inferSchema", "true").option("encoding", "ISO-8859-1").csv(path)
    )
    df = raw.toDF(*[snake(c) for c in raw.columns])
    df.createOrReplaceTempView(view)
    return df.columns, df.count()


def route_source(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """Pick the reader by extension: ("sql", table) or ("rag", documents)."""
    ext = os.path.splitext(path)[1].lower()
    if ext in TABULAR:
        load_upload(spark, path)
        return "sql", spark.table(VIEW)
    if ext in DIRECT:
        return "sql", spark.read.format(DIRECT[ext]).load(path)
    if ext in TEXT:
        docs = spark.read.text(path, wholetext=True)
        return "rag", docs.select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    raise ValueError(f"Unsupported file type: {ext}")
