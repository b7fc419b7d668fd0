"""Gradient-boosted regression trees, several models grown side by side.

MLlib's regressor runs one job for each level of each tree of each model and
spends about a microsecond on a row in it. Here rows are cut into at most BINS
quantile bins once. Rows with the same bins end in the same leaf of every tree,
so Spark adds them up to one with their number and the sum of their labels.
These lie in blocks that the executors keep; a job reads each block once and
adds up the histograms of the next level of every model, two features in one
count. Spark sums them per node and picks the splits; the driver sees one row
per open node.

The trees are those of MLlib: squared loss, splits by gain in variance, the
first tree with weight one, all others with the step size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.session import checkpointed, drop_checkpoint

# Bins of a feature and their bits, features in a packed long (an even number), rows of a block and of
# the pieces it is put together from, trees after which the residuals in the blocks are brought up to date, how often that
# is done between two checkpoints, and histograms that a task adds up.
BINS, BITS = 32, 5
PACKED = 12
BLOCK, PIECE = 32768, 4096
FRESH = 1
ROUNDS = 20
MERGED = 512


@dataclass
class Tree:
    """Nodes in heap order, the children of i being 2i+1 and 2i+2; feature -1 marks a leaf."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.cut, self.value = np.full(size, -1), np.zeros(size, np.uint8), np.zeros(size)

    def place(self, keys: np.ndarray, level: int) -> np.ndarray:
        """The place in ``level`` that every column of :func:`_packed` keys gets to; below a leaf it keeps to the left."""
        at = np.zeros(keys.shape[1], np.int64)
        for i in range(level):
            nodes = slice(2**i - 1, 2 ** (i + 1) - 1)
            leaf = self.feature[nodes] < 0
            word, shift = np.divmod(np.where(leaf, 0, self.feature[nodes]), PACKED)
            shift, cut = BITS * shift, np.where(leaf, BINS, self.cut[nodes])
            key = keys[0] if len(keys) == 1 else keys[word[at], np.arange(len(at))]
            if i:
                shift, cut = shift[at], cut[at]
            at = 2 * at + ((key >> shift) & (BINS - 1) > cut)
        return at

    def added(self, keys: np.ndarray) -> np.ndarray:
        """The value of the leaf every column of ``keys`` ends in."""
        value = self.value.copy()
        for i in range(2**self.depth - 1):
            if self.feature[i] < 0:
                value[2 * i + 1 : 2 * i + 3] = value[i]
        return value[2**self.depth - 1 :][self.place(keys, self.depth)]


@dataclass
class Model:
    """Boosted trees over the bins that ``cuts`` make of each feature."""

    cuts: list[np.ndarray]
    depth: int
    step: float
    limit: int = 0
    trees: list[Tree] = field(default_factory=list)

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - the name MLlib's models have
        return len(self.trees)

    def first(self, n: int) -> Model:
        """The model of the first ``n`` trees."""
        return Model(self.cuts, self.depth, self.step, self.limit, self.trees[:n])

    def weighted(self, start: int = 0, end: int | None = None) -> list[tuple[float, Tree]]:
        """The trees from ``start`` to ``end`` with what they weigh."""
        return [(self.step if i else 1.0, tree) for i, tree in enumerate(self.trees[start:end], start)]

    def added(self, keys: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
        """What the trees from ``start`` to ``end`` add to the prediction."""
        return _added(self.weighted(start, end), keys)


def _added(trees: list[tuple[float, Tree]], keys: np.ndarray) -> np.ndarray:
    out = np.zeros(keys.shape[1])
    for weight, tree in trees:
        out += weight * tree.added(keys)
    return out


def binned(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers (feature, row); bin i ends with the i-th cut."""
    if any(np.isnan(c).any() for c in columns):
        raise ValueError("features must not be null or NaN")
    return np.stack([np.searchsorted(c, x).astype(np.uint8) for x, c in zip(columns, cuts)])


def _cuts(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Quantiles of each feature over all rows."""
    parts = [i / BINS for i in range(1, BINS)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), parts).alias(f) for f in features]).first()
    return [np.unique(np.array(row[f] or [], dtype=float)) for f in features]


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]


def _rows(df: DataFrame, features: Sequence[str], label: str, part: Column) -> DataFrame:
    return df.select(*[F.col(f).cast("double").alias(f) for f in features],
                     F.col(label).cast("double").alias("_y"), part.cast("double").alias("_part"))


def _cut(batch: pa.RecordBatch, features: Sequence[str], cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, parts and labels of a batch of :func:`_rows`."""
    bins = binned(_columns(batch, features), cuts)
    y, part = _columns(batch, ["_y", "_part"])
    if np.isnan(y).any():
        raise ValueError("labels must not be null or NaN")
    return bins, part.astype(np.uint8), y


def _packed(bins: np.ndarray) -> np.ndarray:
    """Bins (feature, row) as longs of PACKED features each, the first in the lowest bits."""
    out = np.zeros((-(-len(bins) // PACKED), bins.shape[1]), np.int64)
    for f, b in enumerate(bins):
        out[f // PACKED] |= b.astype(np.int64) << (BITS * (f % PACKED))
    return out


def _blocks(df: DataFrame, features: Sequence[str], label: str, part: Column, cuts: list[np.ndarray], most: int) -> DataFrame:
    """Distinct bins and parts up to ``most``, how many rows have them, and the sum of their labels: one row for each PIECE of them."""
    names = [f"_key{i}" for i in range(-(-len(features) // PACKED))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, where, y = _cut(batch, features, cuts)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(k) for k in _packed(bins)), pa.array(where.astype(np.int32)), pa.array(y)], [*names, "_part", "_y"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                rows = batch.slice(start, PIECE)
                keys = np.stack([rows.column(k).to_numpy() for k in names])
                where, count, y = (rows.column(c).to_numpy() for c in ("_part", "_n", "_y"))
                # Most numbers take one byte.
                count = count.astype(np.min_scalar_type(count.max()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.tobytes()], pa.binary()) for a in (keys, where.astype(np.uint8), count, y)], ["keys", "part", "n", "y"])

    rows = _rows(df, features, label, part).where(F.col("_part") <= most)
    binned_rows = rows.mapInArrow(cut, ", ".join([*(f"{k} long" for k in names), "_part int, _y double"]))
    same = binned_rows.groupBy(*names, "_part").agg(F.count("*").alias("_n"), F.sum("_y").alias("_y"))
    return same.mapInArrow(pieces, "keys binary, part binary, n binary, y binary")


def _kept(pieces: DataFrame, limits: list[int]) -> RDD:
    """Blocks: keys, numbers of rows and, for each model, what is left of the labels of its rows, which come first.

    Pieces are dealt out to all cores, ten at a time; a block has about BLOCK rows.
    """
    def block(rows: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
        part = np.concatenate([np.frombuffer(r["part"], np.uint8) for r in rows])
        order = np.argsort(part, kind="stable")
        keys = np.concatenate([np.frombuffer(r["keys"], np.int64).reshape(-1, len(r["part"])) for r in rows], axis=1)
        count = np.concatenate([np.frombuffer(r["n"], f"u{len(r['n']) // len(r['part'])}") for r in rows])
        y = np.concatenate([np.frombuffer(r["y"]) for r in rows])[order]
        return keys[:, order], count[order], [y[:end] for end in np.searchsorted(part[order], limits, "right")]

    def blocks(rows: Iterator) -> Iterator[tuple]:
        held, n = [], 0
        for row in rows:
            held, n = [*held, row], n + len(row["part"])
            if n > BLOCK - PIECE:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    cores = pieces.sparkSession.sparkContext.defaultParallelism
    rows = pieces.rdd
    rows = rows.repartition(max(rows.getNumPartitions() // cores, 1) * cores)
    return rows.mapPartitions(blocks).persist(StorageLevel.MEMORY_AND_DISK_DESER)


def _refreshed(blocks: RDD, models: list[Model], since: list[int], growing: list[Tree | None]) -> RDD:
    """The blocks without what the trees made so far explain; those of finished models are left out."""
    trees = [None if tree is None else model.weighted(a) for model, a, tree in zip(models, since, growing)]

    def run(block: tuple) -> tuple:
        keys, count, rest = block
        new = [None if t is None else r - count[:len(r)] * _added(t, keys[:, :len(r)]) if t else r for r, t in zip(rest, trees)]
        return keys, count, new

    return blocks.map(run, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK_DESER)


class Split(NamedTuple):
    """Best split of an open node; feature -1: none. The means are those of both sides and of all."""

    model: int
    node: int
    feature: int
    cut: int
    low: float
    high: float
    mean: float


def _split(model: int, node: int, n: np.ndarray, s: np.ndarray) -> Split:
    """From numbers and sums by feature and bin."""
    all_n, all_s = n[0].sum(), s[0].sum()
    left_n, left_s = n.cumsum(axis=1)[:, :-1], s.cumsum(axis=1)[:, :-1]
    right_n, right_s = all_n - left_n, all_s - left_s
    usable = (left_n > 0) & (right_n > 0)
    gain = np.where(usable, left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1), -np.inf)
    f, cut = np.unravel_index(gain.argmax(), gain.shape)
    mean = float(all_s / max(all_n, 1))
    found = usable[f, cut] and gain[f, cut] > all_s * mean
    sides = (float(left_s[f, cut] / left_n[f, cut]), float(right_s[f, cut] / right_n[f, cut])) if found else (mean, mean)
    return Split(model, node, int(f) if found else -1, int(cut), *sides, mean)


def _splits(blocks: RDD, models: list[Model], since: list[int], growing: list[Tree | None],
            opened: list[list[int]], n_features: int) -> list[Split]:
    """Best split of each open node."""
    nodes = [(i, node) for i, o in enumerate(opened) for node in o]
    # Of every growing model: trees not yet in the blocks, the one that grows, its level, open places in it, the factor of the negative gradient.
    todo = [(i, m.weighted(a), t, (o[0] + 1).bit_length() - 1, o, 2 if m.trees else 1)
            for i, (m, a, t, o) in enumerate(zip(models, since, growing, opened)) if t is not None]
    pairs = [(f, min(2, n_features - f)) for f in range(0, n_features, 2)]

    def histograms(task: int, part: Iterator[tuple]) -> Iterator[tuple]:
        # By model and pair of features: numbers and sums by place and bins. Rows in no open node go to one more place.
        held = [[np.zeros((2, (len(o) + 1) * BINS**wide)) for _, wide in pairs] for *_, o, _ in todo]
        for keys, count, rest in part:
            times = count.astype(float)
            values = [(keys[f // PACKED] >> (BITS * (f % PACKED))) & (BINS**wide - 1) for f, wide in pairs]
            for (i, trees, tree, level, o, _), sums in zip(todo, held):
                left, rows = rest[i], len(rest[i])
                if trees:
                    left = left - times[:rows] * _added(trees, keys[:, :rows])
                slot = np.full(2**level, len(o))
                slot[np.array(o) + 1 - 2**level] = range(len(o))
                at = slot[tree.place(keys[:, :rows], level)] if level else None
                for (_, wide), value, total in zip(pairs, values, sums):
                    key = value[:rows] if at is None else at * BINS**wide + value[:rows]
                    total[0] += np.bincount(key, times[:rows], total.shape[1])
                    total[1] += np.bincount(key, left, total.shape[1])
        number = 0
        for (*_, o, factor), sums in zip(todo, held):
            out = np.empty((len(o), 2, n_features, BINS))
            for (f, wide), total in zip(pairs, sums):
                cells = total.reshape(2, len(o) + 1, -1, BINS)[:, :-1].swapaxes(0, 1)
                out[:, :, f] = cells.sum(axis=2)
                if wide == 2:
                    out[:, :, f + 1] = cells.sum(axis=3)
            out[:, 1] *= factor
            for h in out:
                yield number, (task, h)
                number += 1

    def choose(part: Iterator[tuple]) -> Iterator[Split]:
        found: dict[int, list] = {}
        for number, sums in part:
            found.setdefault(number, []).append(sums)
        for number, sums in found.items():
            # Summed in the order of the tasks, so that reruns agree.
            n, s = sum(h for _, h in sorted(sums, key=lambda x: x[0]))
            yield _split(*nodes[number], n, s)

    sums = blocks.mapPartitionsWithIndex(histograms)
    tasks = min(blocks.ctx.defaultParallelism, -(-len(nodes) * blocks.getNumPartitions() // MERGED))
    return sums.partitionBy(tasks, lambda number: number).mapPartitions(choose).collect()


def fit(df: DataFrame, features: Sequence[str], label: str, n: int, shapes: Sequence[tuple[int, int, float]],
        part: Column | None = None) -> list[Model]:
    """A model of ``n`` trees for each of ``shapes``, (limit, depth, step), from the rows whose ``part`` is at most its limit.

    Bins are quantiles of all rows of ``df``. Every model takes one level
    further with each job, so as many jobs as the deepest needs serve all.
    """
    cuts = _cuts(df, features)
    models = [Model(cuts, depth, step, limit) for limit, depth, step in shapes]
    limits = [m.limit for m in models]
    # An RDD, as a job on it is not planned anew for each level; it stays with the executors, only its last state.
    blocks = _kept(_blocks(df, features, label, part if part is not None else F.lit(0), cuts, max(limits)), limits)
    stale: list[RDD] = []
    saved: list[RDD] = []
    since, rounds = [0] * len(models), 0
    growing: list[Tree | None] = [Tree(m.depth) for m in models]
    opened = [[0] for _ in models]
    while any(t is not None for t in growing):
        for s in _splits(blocks, models, since, growing, opened, len(features)):
            tree = growing[s.model]
            tree.value[s.node] = s.mean
            if s.feature >= 0:
                low = 2 * s.node + 1
                tree.feature[s.node], tree.cut[s.node] = s.feature, s.cut
                tree.value[low], tree.value[low + 1] = s.low, s.high
        while stale:
            stale.pop().unpersist()
        while len(saved) > 1:
            drop_checkpoint(saved.pop(0))
        for i, (model, tree) in enumerate(zip(models, growing)):
            if tree is None:
                continue
            below = [c for o in opened[i] if tree.feature[o] >= 0 for c in (2 * o + 1, 2 * o + 2)]
            opened[i] = [c for c in below if 2 * c + 2 < len(tree.feature)]
            if not opened[i]:
                model.trees.append(tree)
                growing[i], opened[i] = (Tree(model.depth), [0]) if len(model.trees) < n else (None, [])
        behind = [len(m.trees) - a for m, a, t in zip(models, since, growing) if t is not None]
        if behind and max(behind) >= FRESH:
            # Worked out by the next level's job, which reads it.
            stale.append(blocks)
            blocks, rounds = _refreshed(blocks, models, since, growing), rounds + 1
            since = [len(m.trees) for m in models]
            if rounds % ROUNDS == 0:
                saved.append(checkpointed(blocks))
    blocks.unpersist()
    for rdd in saved:
        drop_checkpoint(rdd)
    return models


def predict(model: Model, df: DataFrame, features: Sequence[str], name: str = "prediction") -> DataFrame:
    """``df`` with the model's prediction."""
    @F.pandas_udf("double")
    def made(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.added(_packed(binned([c.to_numpy(dtype=float, na_value=np.nan) for c in columns], model.cuts))))

    return df.withColumn(name, made(*[F.col(f).cast("double") for f in features]))


def losses(models: list[Model], sizes: Sequence[int], df: DataFrame, features: Sequence[str], label: str, part: Column) -> DataFrame:
    """Mean squared error of the first trees of each model over the part that follows its own: model, size, mse.

    One scan for all models and sizes.
    """
    cuts = models[0].cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every, parts, y = _cut(batch, features, cuts)
                keys, rows = _packed(every), []
                for i, model in enumerate(models):
                    inside = parts == model.limit + 1
                    own, made = np.ascontiguousarray(keys[:, inside]), 0.0
                    for start, end in zip((0, *sizes), sizes):
                        made = made + model.added(own, start, end)
                        rows.append((i, end, int(inside.sum()), float(((y[inside] - made) ** 2).sum())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.float64()))],
                    ["model", "size", "n", "squares"])

    parts = _rows(df, features, label, part).mapInArrow(run, "model int, size int, n long, squares double")
    return parts.groupBy("model", "size").agg((F.sum("squares") / F.sum("n")).alias("mse"))
