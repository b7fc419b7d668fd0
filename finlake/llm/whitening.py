"""Embedding whitening (12) with MLlib's BlockMatrix.

Centred rows get dense indices and become distributed blocks. The transposed
matrix times the matrix is the scatter, whose eigenvectors are found locally
(its size is the dimension, not the rows). The blocks times the whitening
matrix are the projected rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.session import stage_table

#: Rows of a block. Blocks that meet in one task of the scatter, on average.
ROWS_PER_BLOCK, BLOCKS_PER_SPLIT = 4_096, 8
#: Eigenvalues below this share of the largest are taken for zero: their components cannot be scaled to 1.
LEAST_SHARE = 1e-12
SCALE, OFFSET = 1024, 100_000
EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Whitening:
    """``components`` (dimensions, k) of unit columns, their ``eigenvalues``, and the trace of the covariance."""

    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def quantised(vector_col: str) -> Column:
    """floor(1024 * c) + 100000 of every component, as longs; an error where a long cannot hold it."""
    def whole(c: Column) -> Column:
        v = F.lit(float(SCALE)) * c.cast("double")
        return F.when(F.abs(v) < F.lit(2.0**62), F.floor(v) + F.lit(OFFSET).cast("long")).otherwise(
            F.raise_error(F.lit("a component is too large for a long")).cast("long"))

    return F.transform(F.col(vector_col), whole)


def fit_list(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(``vec_id``, ``x``) of the rows whose vector has only finite components and the usual length.

    The usual length is that of most such vectors, of equally frequent ones
    the largest: a shorter vector lacks entries of some dimension, as one with
    null entries does.
    """
    bad = F.exists(F.col(vector_col), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    good = rows.where(F.col(vector_col).isNotNull() & ~bad & (F.size(vector_col) > 0))
    usual = good.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size(vector_col) == (usual["d"] if usual else 0)).select(
        F.col(id_col).alias("vec_id"), quantised(vector_col).alias("x"))


def with_dense_index(rows: DataFrame) -> DataFrame:
    """``rows`` written once, with ``index`` from 0 without gaps: the offset of the writing task and the place in it."""
    placed = stage_table(rows.withColumn("_place", F.monotonically_increasing_id()), "rows")
    task, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(task.alias("_task")).agg(F.max(place).alias("_last"))
    # One row a task that wrote.
    offsets, total = [], 0
    for r in sizes.orderBy("_task").collect():
        offsets.append((r["_task"], total))
        total += r["_last"] + 1
    starts = rows.sparkSession.createDataFrame(offsets, "_task long, _start long")
    return placed.withColumn("_task", task).join(F.broadcast(starts), "_task").withColumn(
        "index", F.col("_start") + place).drop("_task", "_start", "_place")


def column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension of ``x``; combined before they are shuffled."""
    sums = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(
        F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).orderBy("d").collect()
    return (sums[0]["n"], [int(r["s"]) for r in sums]) if sums else (0, [])


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """Blocks of the rows (``index``, ``centred``): full rows, ROWS_PER_BLOCK of them."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(ROWS_PER_BLOCK, d)


def covariance(blocks: BlockMatrix) -> np.ndarray:
    """Transposed matrix times matrix, over the rows.

    The product is one block, whose sum would be one task. MLlib can cut the
    inner dimension and add the parts up; the Python class lacks the argument,
    so it is passed to the method behind it.
    """
    n = blocks.numRows()
    splits = max(1, -(-n // (ROWS_PER_BLOCK * BLOCKS_PER_SPLIT)))
    left = blocks.transpose()
    product = left._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    scatter = BlockMatrix(product, left.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()
    return (scatter + scatter.T) / 2 / n


def fit(blocks: BlockMatrix, k: int) -> Whitening:
    """The ``k`` leading components of centred rows; fewer where the covariance has a smaller rank."""
    v = covariance(blocks)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:k]
    order = order[values[order] > max(0.0, LEAST_SHARE * values.max())]
    chosen = vectors[:, order]
    # One sign whatever the routine gives: the largest entry is positive.
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    return Whitening(chosen * signs, values[order], float(np.trace(v)))


def indexed_rows(blocks: BlockMatrix) -> DataFrame:
    """(``index``, ``whitened``) of a matrix whose blocks are full rows."""
    height = blocks.rowsPerBlock

    def rows_of(block: tuple) -> Iterator[tuple[int, list[float]]]:
        (i, _), values = block
        for r, row in enumerate(values.toArray().tolist()):
            yield i * height + r, row

    return blocks.blocks.flatMap(rows_of).toDF("index long, whitened array<double>")


def whiten(rows: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining row of ``rows`` and component.

    ``vec_id``, ``component`` (from 1), ``n``, ``deviation`` (decimal, exact:
    the sum over the dimensions of (n * x - S) ** 2), ``whitened``,
    ``explained`` and ``identity_error``. Rows with a null vector, null or
    non-finite entries, no entries, or another length than most vectors are
    dropped; so the result is empty for an empty table, and where all vectors
    are equal, as no component has a variance then. A null id stays null, and
    rows that repeat an id or a vector are rows of their own. Other columns
    are not read. A component or deviation too large for a long or 38 digits is an error.
    """
    spark = rows.sparkSession
    kept = with_dense_index(fit_list(rows, id_col, vector_col))
    n, sums = column_sums(kept)
    result = f"vec_id {dict(kept.dtypes)['vec_id']}, component int, n long, deviation {EXACT}, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], result)
    # A row for each dimension: small, and of the same size for any number of rows.
    total = F.array(*(F.lit(s).cast(EXACT) for s in sums))
    away = F.zip_with("x", total, lambda x, s: (x.cast(EXACT) * F.lit(n).cast(EXACT) - s).cast(EXACT))
    squared = F.aggregate("away", F.lit(0).cast(EXACT), lambda t, a: (t + (a * a).cast(EXACT)).cast(EXACT))
    centred = stage_table(kept.withColumn("away", away).select(
        "index", "vec_id", squared.alias("deviation"),
        F.transform("away", lambda a: a.cast("double") / F.lit(float(n))).alias("centred")), "centred")

    # Both products read the same shuffle of the rows into blocks.
    blocks = block_matrix(centred, n, len(sums))
    model = fit(blocks, k)
    width = len(model.eigenvalues)
    if not width:
        return spark.createDataFrame([], result)
    right = Matrices.dense(len(sums), width, model.matrix.ravel(order="F").tolist())
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), right)], 1), len(sums), width, len(sums), width)
    values = stage_table(indexed_rows(blocks.multiply(whitening)), "whitened")

    error = _identity_error(values, n, width)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues))
    named = centred.select("index", "vec_id", "deviation").join(values, "index")
    return named.select("vec_id", "deviation", F.posexplode("whitened").alias("c", "whitened")).select(
        "vec_id", (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("c")].alias("explained"), F.lit(error).alias("identity_error"))


def _identity_error(values: DataFrame, n: int, width: int) -> float:
    """Largest absolute entry of the measured covariance of the whitened rows minus the identity."""
    means = values.select(*(F.avg(F.col("whitened")[i]) for i in range(width))).first()
    shift = F.array(*(F.lit(float(m)) for m in means))
    centred = values.select("index", F.zip_with("whitened", shift, lambda w, m: w - m).alias("centred"))
    return float(np.abs(covariance(block_matrix(centred, n, width)) - np.eye(width)).max())
