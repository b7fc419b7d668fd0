"""Approximate nearest neighbours (1): inverted multi-index.

Both halves of the vectors are quantised separately, which makes one cell for
every pair of centroids. A query visits the cells in the order of the summed
scores of its halves with the centroids, from a heap, until they hold a
share of all entries; those are reranked with the original vectors. The share
is calibrated on the fitted sample: the smallest that finds the wanted part of
the sample's true neighbours there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm.vectors import (
    BATCH_QUERIES, BLOCK_VECTORS, as_table, batch_of, best_rows, matrix, search_blocks, valid_vectors,
)
from finlake.session import stage_table

#: Vectors the quantisers are fitted on, chosen by a hash of the id: the bound of the sample.
SAMPLE = 12_288
#: Centroids of each half, at most; about the fourth root of what one cell may hold would do for huge tables.
CENTROIDS = 64
#: Part of the true neighbours that the calibrated share finds in the sample.
RECALL = 0.94
#: Queries of the calibration.
TRIALS = 192
#: Pairs that are multiplied at once.
PAIRS = 1 << 15


@dataclass
class MultiIndex:
    split: int
    first: np.ndarray
    second: np.ndarray
    share: float

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Cell number of each vector: its nearest centroid of either half."""
        return (_nearest(vectors[:, :self.split], self.first) * len(self.second)
                + _nearest(vectors[:, self.split:], self.second))

    def visit(self, query: np.ndarray, sizes: np.ndarray, wanted: float) -> list[int]:
        """Cells in falling order of summed scores, until they hold ``wanted`` entries; empty ones are left out."""
        a, b = self.first @ query[:self.split], self.second @ query[self.split:]
        i_of, j_of = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b = a[i_of].tolist(), b[j_of].tolist()
        n = len(j_of)
        sizes = sizes.tolist()
        heap, out, held = [(-a[0] - b[0], 0, 0)], [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = i_of[i] * n + j_of[j]
            if sizes[cell]:
                held += sizes[cell]
                out.append(cell)
            if j + 1 < n:
                heapq.heappush(heap, (-a[i] - b[j + 1], i, j + 1))
            # A row of the grid opens when its left neighbour was taken first.
            if j == 0 and i + 1 < len(i_of):
                heapq.heappush(heap, (-a[i + 1] - b[0], i + 1, 0))
        return out


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1), axis=1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centroids = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, centroids)
        order = np.argsort(at, kind="stable")
        used, first = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centroids[used] = sums / np.diff(np.r_[first, len(x)])[:, None]
    return centroids


def fit(sample: np.ndarray, k: int, centroids: int = CENTROIDS, recall: float = RECALL, seed: int = 3) -> MultiIndex:
    """Quantisers of both halves, and the share of entries to visit for the wanted recall of ``k`` neighbours."""
    rng = np.random.default_rng(seed)
    split = (sample.shape[1] + 1) // 2
    n = max(1, min(centroids, int(np.sqrt(len(sample)))))
    index = MultiIndex(split, _k_means(sample[:, :split], n, rng), _k_means(sample[:, split:], n, rng), 1.0)
    if len(sample) <= 2 * k:
        return index
    cells = index.cells(sample)
    sizes = np.bincount(cells, minlength=len(index.first) * len(index.second))
    trials = rng.permutation(len(sample))[:TRIALS]
    needed = []
    for t in trials:
        scores = sample @ sample[t]
        scores[t] = -np.inf
        best = cells[np.argpartition(-scores, k - 1)[:k]]
        order = index.visit(sample[t], sizes, len(sample))
        before = dict(zip(order, np.r_[0, np.cumsum(sizes[order])[:-1]]))
        needed += [before[c] for c in best]
    index.share = min(1.0, (float(np.quantile(needed, recall)) + 1) / len(sample))
    return index


def nearest_neighbours(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id",
                       vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` nearest found, by inner product in doubles.

    Queries are the rows whose id is divisible by ``every``; a query never
    finds rows with its own id. Vectors that are null, empty, zero, or hold a null or
    non-finite component take no part, nor do rows without an id; vectors of
    different lengths are not compared. Equal scores are ordered by id,
    repeated rows are repeated candidates. Fewer candidates than ``k`` are all
    returned, an empty table gives no rows; other columns are not read.

    The index is a table of (cell, vector). A cell larger than a block is
    dealt to several by a hash of the id, so many equal vectors never meet in
    one task; queries come in batches.
    """
    valid = valid_vectors(rows, id_col, vector_col, no_zero=True)
    found = None
    for (dim,) in sorted(valid.select("dim").distinct().collect()):
        part = _search(valid.where(F.col("dim") == dim), k, every)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else rows.sparkSession.createDataFrame(
        [], "query_id long, rank int, vec_id long, score double")


def _search(valid: DataFrame, k: int, every: int) -> DataFrame:
    sample = valid.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow()
    index = fit(matrix(sample, "vec"), k)
    n_cells = len(index.first) * len(index.second)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(pa.Table.from_batches([batch]), "vec")
            cells = index.cells(x) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.int32())],
                                             names=["vec_id", "vec", "cell"])

    table = stage_table(valid.select("vec_id", "vec").mapInArrow(assign, "vec_id long, vec array<double>, cell int"), "cells")
    sizes = np.zeros(n_cells, dtype=np.int64)
    for cell, n in table.groupBy("cell").count().collect():  # a row for each cell at most
        sizes[cell] = n
    total = int(sizes.sum())
    batches_n = max(1, -(-table.where(F.col("vec_id") % every == 0).count() // BATCH_QUERIES))

    # Small cells share a block, a large cell has several.
    parts = -(-sizes // BLOCK_VECTORS)
    block_of, used, held = np.zeros(n_cells, dtype=np.int64), 0, 0
    for cell in range(n_cells):
        if parts[cell] > 1:
            used += 1 if held else 0
            block_of[cell], used, held = used, used + int(parts[cell]), 0
        else:
            if held + sizes[cell] > BLOCK_VECTORS:
                used, held = used + 1, 0
            block_of[cell] = used
            held += sizes[cell]
    layout = table.sparkSession.createDataFrame(
        [(c, int(block_of[c]), max(1, int(parts[c]))) for c in range(n_cells) if sizes[c]], "cell int, first long, parts int")
    entries = table.join(F.broadcast(layout), "cell").select(  # a row for each cell at most
        "vec_id", "vec", "cell", (F.col("first") + F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.col("parts"))).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(batches_n - 1))).alias("batch"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(pa.Table.from_batches([batch]), "vec")
            owner, blocks, lists = [], [], []
            for i in range(len(x)):
                cells = np.asarray(index.visit(x[i], sizes, index.share * total), dtype=np.int64)
                first = block_of[cells]
                for b in np.unique(first):
                    mine = cells[first == b]
                    for part in range(max(1, int(parts[mine].max()))):
                        owner.append(i)
                        blocks.append(int(b) + part)
                        lists.append(mine.astype(np.int32))
            owner = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(blocks, pa.int64()),
                 pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "vec", "block", "cells"])

    asked = table.where(F.col("vec_id") % every == 0).select("vec_id", "vec").mapInArrow(
        probe, "query_id long, vec array<double>, block long, cells array<int>")
    asked = asked.withColumn("batch", batch_of("query_id", batches_n))
    return search_blocks(entries, asked, _reranker(k), "double", k)


def row_scores(q: np.ndarray, x: np.ndarray, who: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, each summed in one order: equal vectors have equal scores in any block."""
    out = np.empty(len(who))
    for i in range(0, len(who), PAIRS):
        here = slice(i, i + PAIRS)
        out[here] = (q[who[here]] * x[at[here]]).sum(axis=1)
    return out


def _reranker(k: int):
    def rerank(entries: pa.Table, queries: pa.Table) -> pa.Table:
        """Inner products of every query with the entries of the cells it visits, cell by cell.

        A matrix product, whose digits depend on the shape of the block,
        chooses the candidates, with a margin for its rounding; their scores
        come from :func:`row_scores`.
        """
        none = as_table([], [], [], pa.float64())
        if not entries.num_rows or not queries.num_rows:
            return none
        ids, cells = entries.column("vec_id").to_numpy(), entries.column("cell").to_numpy()
        order = np.argsort(cells, kind="stable")
        x, ids = matrix(entries, "vec")[order], ids[order]
        used, first = np.unique(cells[order], return_index=True)
        stops = np.r_[first[1:], len(ids)]
        q, q_ids = matrix(queries, "vec"), queries.column("query_id").to_numpy()
        lists = queries.column("cells").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = lists.offsets.to_numpy()
        visited = lists.flatten().to_numpy()
        visitor = np.repeat(np.arange(len(q)), np.diff(offsets))
        by_cell = np.argsort(visited, kind="stable")
        begin = np.searchsorted(visited[by_cell], used)
        end = np.searchsorted(visited[by_cell], used, side="right")
        # Twice what either way of summing may be off.
        lengths = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
        margin = 4 * x.shape[1] * np.finfo(float).eps * lengths
        least = np.full(len(q), -np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for i in range(len(used)):
            who = visitor[by_cell[begin[i]:end[i]]]
            if not len(who):
                continue
            here = slice(first[i], stops[i])
            rough = q[who] @ x[here].T
            a, b = np.nonzero((rough >= (least - margin)[who][:, None]) & (q_ids[who][:, None] != ids[here][None, :]))
            kept.append((who[a], ids[here][b], row_scores(q, x, who[a], first[i] + b)))
            waiting += len(a)
            if waiting > 40 * k * len(q):
                kept = [_top(kept, k)]
                waiting = len(kept[0][0])
                _raise(least, kept[0], k)
        if not kept:
            return none
        who, found, scores = _top(kept, k)
        return as_table(q_ids[who], found, scores, pa.float64())

    return rerank


def _top(kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    who, ids, scores = (np.concatenate([t[i] for t in kept]) for i in range(3))
    best = best_rows(who, ids, scores, k)
    return who[best], ids[best], scores[best]


def _raise(least: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> None:
    """Queries that have ``k`` rows need no score below their last one."""
    counts = np.bincount(top[0], minlength=len(least))
    lowest = np.full(len(least), np.inf)
    np.minimum.at(lowest, top[0], top[2])
    full = counts >= k
    least[full] = lowest[full]
