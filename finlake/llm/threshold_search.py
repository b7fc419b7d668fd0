"""Exact top-k search (4): no-random-access aggregation over sorted lists.

A block of candidates has a list for each dimension, sorted by component. A
query reads the lists of its non-zero dimensions in lockstep from the end that
its sign prefers. What was read bounds every candidate: below, by the
products seen and the worst value of each unread list; above, by the
products seen and the last value read. Reading stops when few candidates can
still reach the k-th best lower bound; only their scores are resolved.
All queries of a batch share the reading; bounds are matrix products.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from fractions import Fraction
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm.vectors import (
    BATCH_QUERIES, BLOCK_VECTORS, as_table, batch_of, best_rows, matrix, search_blocks, valid_vectors,
)
from finlake.session import stage_table

#: Depths of the lists, as shares of their length, at which bounds are compared.
DEPTHS = (0.4, 0.6, 0.75, 0.9, 1.0)
#: Candidates of a query, as a share of the block, that are few enough to resolve.
FEW = 0.05
#: Queries whose bounds are held at once: FEW_QUERIES x BLOCK_VECTORS doubles.
FEW_QUERIES = 256


def _levels(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each component after reading ``depth`` of its list from the top: upper and lower, then from the bottom."""
    n = len(x)
    ordered = np.sort(x, axis=0)
    high, low = ordered[n - depth], ordered[depth - 1]
    seen_top, seen_low = x >= high, x <= low
    return (np.where(seen_top, x, high), np.where(seen_top, x, ordered[0]),
            np.where(seen_low, x, low), np.where(seen_low, x, ordered[-1]))


def search_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector id, score) of the ``k`` best of a block for each query; exact, ties to the smaller id."""
    n = len(x)
    q_of: list[np.ndarray] = []
    x_of: list[np.ndarray] = []
    alive = np.ones((len(q), n), dtype=bool)
    alive &= q_ids[:, None] != ids[None, :]
    open_ = np.arange(len(q))
    positive, negative = np.maximum(q, 0), np.minimum(q, 0)
    both = np.hstack([positive, negative])
    for share in DEPTHS:
        if not len(open_):
            break
        depth = max(1, int(np.ceil(share * n)))
        if depth < n and n > k:
            top_upper, top_lower, low_upper, low_lower = _levels(x, depth)
            some = both[open_]
            lower = some @ np.hstack([top_lower, low_lower]).T
            upper = some @ np.hstack([top_upper, low_upper]).T
            candidates = alive[open_]
            # The k-th best lower bound among those that may be returned.
            reach = np.partition(np.where(candidates, lower, -np.inf), n - k, axis=1)[:, n - k]
            candidates &= upper >= reach[:, None]
            alive[open_] = candidates
            done = candidates.sum(axis=1) <= max(k, FEW * n)
        else:
            done = np.ones(len(open_), dtype=bool)
        a, b = np.nonzero(alive[open_[done]])
        q_of.append(open_[done][a])
        x_of.append(b)
        open_ = open_[~done]
    who, at = np.concatenate(q_of), np.concatenate(x_of)
    scores = np.empty(len(who))
    for i in range(0, len(who), 1 << 17):
        scores[i:i + (1 << 17)] = np.einsum("nd,nd->n", q[who[i:i + (1 << 17)]], x[at[i:i + (1 << 17)]])
    best = best_rows(who, ids[at], scores, k)
    return who[best], ids[at[best]], scores[best]


def whole(x: np.ndarray, scale: float) -> list[list[int]]:
    """floor(scale * x) of every component as integers of any size; a product beyond doubles is taken exactly."""
    return [[math.floor(p) if math.isfinite(p := scale * c) else math.floor(Fraction(scale) * Fraction(c)) for c in row] for row in x.tolist()]


def exact_top(x: list[list[int]], ids: np.ndarray, q: list[int], q_id: int, k: int) -> list[tuple[int, int]]:
    """The ``k`` best (score, vector id) of a query, in integers of any size."""
    scores = ((sum(map(mul, q, v)), i) for i, v in zip(ids.tolist(), x) if i != q_id)
    return heapq.nsmallest(k, scores, key=lambda s: (-s[0], s[1]))


def as_long(score: int) -> int:
    if not -2**63 <= score < 2**63:
        raise OverflowError(f"the inner product {score} is beyond a long")
    return score


def _searcher(k: int, scale: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries.num_rows or not queries.num_rows:
            return as_table([], [], [], pa.int64())
        raw_x, ids = matrix(entries, "vec"), entries.column("vec_id").to_numpy()
        raw_q, q_ids = matrix(queries, "vec"), queries.column("query_id").to_numpy()
        with np.errstate(over="ignore"):
            x, q = np.floor(scale * raw_x), np.floor(scale * raw_q)
        parts = []
        if x.shape[1] * max(1.0, float(np.abs(x).max(initial=0))) * max(1.0, float(np.abs(q).max(initial=0))) < 2**52:
            for i in range(0, len(q), FEW_QUERIES):
                who, found, scores = search_block(x, ids, q[i:i + FEW_QUERIES], q_ids[i:i + FEW_QUERIES], k)
                parts.append((q_ids[i + who], found, scores.astype(np.int64)))
        else:  # beyond the integers of a double, all are resolved
            candidates = whole(raw_x, scale)
            for q_id, own in zip(q_ids.tolist(), whole(raw_q, scale)):
                best = exact_top(candidates, ids, own, q_id, k)
                parts.append((np.full(len(best), q_id), np.array([i for _, i in best], dtype=np.int64),
                              np.array([as_long(s) for s, _ in best], dtype=np.int64)))
        return as_table(*(np.concatenate([p[i] for p in parts]) for i in range(3)), pa.int64())

    return search


def exact_top_k(rows: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id",
                vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of floor(scale * x) for each query.

    Queries are the rows whose id is divisible by ``every``; a query never
    finds rows with its own id. Vectors that are null or hold a null or
    non-finite component take no part, nor do rows without an id; vectors of
    different lengths are not compared, zero vectors score 0. Components of any
    size are exact; where a block's best scores are beyond a long, which the
    result cannot hold, the query fails. Ties go to the smaller id,
    repeated rows are repeated candidates; fewer candidates than ``k`` are all
    returned, an empty table gives no rows; other columns are not read.

    Candidates are dealt to blocks by a hash of the id, so equal vectors are
    spread; each block returns its ``k`` best, which are merged.
    """
    table = stage_table(valid_vectors(rows, id_col, vector_col, no_zero=False), "vectors")
    found = None
    for dim, n, asked in sorted(table.groupBy("dim").agg(
            F.count("*"), F.count_if(F.col("vec_id") % every == 0)).collect()):
        if not asked:
            continue
        same = table.where(F.col("dim") == dim)
        blocks, batches = -(-n // BLOCK_VECTORS), -(-asked // BATCH_QUERIES)
        entries = same.select(
            "vec_id", "vec", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(blocks)).alias("block"),
            F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
        queries = same.where(F.col("vec_id") % every == 0).select(
            F.col("vec_id").alias("query_id"), "vec",
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
            batch_of("vec_id", batches).alias("batch"))
        part = search_blocks(entries, queries, _searcher(k, scale), "long", k)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else rows.sparkSession.createDataFrame(
        [], "query_id long, rank int, vec_id long, score long")


def oracle(k: int = 20, every: int = 20, scale: int = 64) -> str:
    """DuckDB SQL for :func:`exact_top_k` of ``embeddings``, whose sums stay within the integers of a double."""
    return f"""
WITH vectors AS (
  SELECT vec_id, [floor({scale} * c::DOUBLE) FOR c IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
  FROM vectors q JOIN vectors v ON q.vec_id % {every} = 0 AND q.vec_id <> v.vec_id AND len(q.x) = len(v.x))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= {k}"""
