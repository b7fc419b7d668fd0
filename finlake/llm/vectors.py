"""What both vector searches share: valid vectors, blocks of them, and the merge of partial results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block and queries of a batch, on average.
BLOCK_VECTORS, BATCH_QUERIES = 8_192, 1_024

RESULT = "query_id long, vec_id long, score {kind}"


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str, no_zero: bool) -> DataFrame:
    """(``vec_id``, ``vec`` of doubles, ``dim``) of rows with an id whose vector has only finite components."""
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    keep = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad
    if no_zero:
        keep &= F.exists(F.col(vector_col), lambda x: x != 0)
    return rows.where(keep).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"),
        F.size(vector_col).alias("dim"))


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """An Arrow list column of equally long vectors as one matrix."""
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def search_blocks(entries: DataFrame, queries: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], kind: str,
                  k: int) -> DataFrame:
    """The ``k`` best of ``run`` over every (block, batch) of ``entries`` and ``queries``.

    Both sides carry ``block`` and ``batch``; ``run`` gets the two tables of one pair of
    them and returns its best few rows (``query_id``, ``vec_id``, ``score``).
    Ties go to the smaller ``vec_id``.
    """
    found = entries.groupBy("block", "batch").cogroup(queries.groupBy("block", "batch")).applyInArrow(
        run, RESULT.format(kind=kind))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def batch_of(id_col: str, batches: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(batches)).cast("int")


def best_rows(query_ids: np.ndarray, vec_ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best rows of every query, ties to the smaller vector id."""
    order = np.lexsort((vec_ids, -scores, query_ids))
    q = query_ids[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def as_table(query_ids: np.ndarray, vec_ids: np.ndarray, scores: np.ndarray, kind: pa.DataType) -> pa.Table:
    return pa.table({"query_id": pa.array(query_ids, pa.int64()), "vec_id": pa.array(vec_ids, pa.int64()),
                     "score": pa.array(scores, kind)})
