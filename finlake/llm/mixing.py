"""Mixing sources to target weights (7) by cube-method balanced sampling.

Every document of a source with target/size ratio r is taken floor(r) times
for sure and once more with probability r - floor(r). Which documents get the
extra copy is a balanced sample: inclusion probabilities move, up and down
at random, only in directions that keep both the expected number of documents
and the expected number of tokens of the sample, until they reach 0 or 1. Each
block of a source leaves at most two undecided documents; these meet in fewer,
larger groups, round by round, until a source has one group, whatever rounds
other sources still need. The last two documents of that group, with its few
largest, which waited for them, are the landing problem.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finlake.session import stage_table

#: Documents of a block, on average; a bound of what meets in one group, nothing is left out.
BLOCK = 1024
#: Largest documents of a source's last block, which wait for the landing; all their outcomes and those of the last two are compared.
LANDING = 10
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = min(total, most * sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: at most two are strictly between 0 and 1, sums of p and p*x are kept.

    Three undecided documents with sizes a, b, c have one direction that keeps
    both sums, (c - b, a - c, b - a); with equal sizes, (1, -1, 0). The step
    up or down ends where the first of them is decided, and is chosen with the
    odds that leave the expectation of each p unchanged.
    """
    p = np.clip(p.astype(np.float64), 0, 1)
    waiting = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))][::-1]
    draws = iter(rng.random(2 * len(waiting) + 2).tolist())
    active: list[int] = []
    while True:
        while waiting and len(active) < 3:
            active.append(waiting.pop())
        if len(active) == 3:
            i, j, k = active
            u = (x[k] - x[j], x[i] - x[k], x[j] - x[i])
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(active) == 2 and x[active[0]] == x[active[1]]:
            u = (1.0, -1.0)
        else:
            return p
        moves = [(a, d) for a, d in zip(active, u) if d]
        up = min((1 - p[a]) / d if d > 0 else p[a] / -d for a, d in moves)
        down = min(p[a] / d if d > 0 else (1 - p[a]) / -d for a, d in moves)
        step = up if next(draws) * (up + down) < down else -down
        for a, d in moves:
            p[a] = min(1.0, max(0.0, p[a] + step * d))
            p[a] = 0.0 if p[a] < 1e-9 else 1.0 if p[a] > 1 - 1e-9 else p[a]
        still = [a for a in active if 0 < p[a] < 1]
        if len(still) == len(active):  # rounding kept the nearest from its border
            a = min(active, key=lambda i: min(p[i], 1 - p[i]))
            p[a] = round(p[a])
            still.remove(a)
        active = still


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Decide the few documents left: of all outcomes, the one nearest to the expected tokens, then documents."""
    at = np.flatnonzero((p > 0) & (p < 1))
    if not len(at):
        return p
    picks = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    off = picks - p[at]
    cost = np.abs(off @ x[at]) / max(1.0, x[at].mean()) + 0.05 * np.abs(off.sum(axis=1))
    out = p.copy()
    out[at] = picks[int(np.argmin(cost))]
    return out


def _decider(id_col: str, salt: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def decide(part: pd.DataFrame) -> pd.DataFrame:
        last = int(part["_blocks"].iloc[0]) == 1
        part = part.drop(columns=["_block", "_blocks"]).sort_values([id_col, "size"], kind="stable", ignore_index=True)
        rng = np.random.default_rng([salt, len(part), int(part["size"].sum() % 2**31)])
        order = rng.permutation(len(part))
        if last:
            # A flight ends with its largest documents; all outcomes of the largest few come near any total.
            order = order[np.argsort(-part["size"].to_numpy()[order], kind="stable")]
            order[LANDING:] = rng.permutation(order[LANDING:])
        p, x = part["picked"].to_numpy(np.float64)[order], part["size"].to_numpy(np.float64)[order]
        aside = LANDING if last else 0
        p[aside:] = flight(p[aside:], x[aside:], rng)
        part.loc[order, "picked"] = land(p, x) if last else p
        return part

    return decide


def balanced_sample(units: DataFrame, id_col: str = "doc_id", block: int = BLOCK, seed: int = 17) -> DataFrame:
    """``units`` (group, id, size, p) with ``picked`` (0 or 1), balanced within each group for documents and sizes.

    Groups of any size are dealt to blocks by a hash of the id, so no group
    meets in one task; every round decides all but two documents of a block.
    A group lands in the round in which it has one block. The same rows give
    the same sample, whatever the partitioning and the other groups.
    """
    spark = units.sparkSession
    kept = units.columns
    schema = T.StructType([*units.schema.fields, T.StructField("picked", T.DoubleType())])
    rows = units.withColumn("picked", F.col("p").cast("double"))
    salt, done = seed, []
    while True:
        counts = rows.where((F.col("picked") > 0) & (F.col("picked") < 1)).groupBy("group").count()
        blocks = counts.select("group", F.ceil(F.col("count") / F.lit(float(block))).cast("long").alias("_blocks"))
        largest = blocks.agg(F.max("_blocks")).first()[0]
        if largest is None:
            done.append(rows)
            break
        decided = rows.where((F.col("picked") <= 0) | (F.col("picked") >= 1))
        done.append(decided)
        # null groups are groups too
        dealt = rows.where((F.col("picked") > 0) & (F.col("picked") < 1)).alias("r").join(
            blocks.alias("b"), F.expr("r.group <=> b.group"))
        dealt = dealt.select("r.*", "_blocks", F.pmod(F.xxhash64(F.lit(salt), id_col), F.col("_blocks")).alias("_block"))

        rows = stage_table(dealt.groupBy("group", "_block").applyInPandas(_decider(id_col, salt), schema), "flight")
        if largest == 1:
            done.append(rows)
            break
        salt += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*kept, F.col("picked").cast("long").alias("picked"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``.

    Sources in order of their code points, null last, weigh ``weights`` in
    turn and share ``share`` times all sizes; no target is above ``most`` times
    its source's size. ``copies`` is how often the mix takes the document,
    ``taken`` copies times size. Null and empty texts have size 0; a source
    without words has target 0 and takes nothing; an empty table gives no rows. Repeated rows
    are separate documents, null ids allowed. The totals of the sources, one
    row each as the weights are, are the only thing the driver sees.
    """
    sized = stage_table(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("group"), word_count(F.col(text_col)).alias("size")), "sizes")
    totals = sized.groupBy("group").agg(F.sum("size").alias("n")).collect()
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1]) for r in totals]
    wanted = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(totals))], share * sum(sizes), most)
    plan = docs.sparkSession.createDataFrame(
        [(r[0], s, float(t), t / s if s else 0.0) for r, s, t in zip(totals, sizes, wanted)],
        "source string, source_size long, target double, ratio double")
    # One row per source: no larger than the list of weights that the caller would give.
    rows = sized.join(F.broadcast(plan), F.expr("group <=> source")).drop("source")
    rows = rows.withColumn("base", F.floor("ratio").cast("long")).withColumn("p", F.col("ratio") - F.col("base"))
    picked = balanced_sample(rows, block=block)
    copies = F.col("base") + F.col("picked")
    return picked.select("doc_id", F.col("group").alias("source"), "size", "source_size", "target",
                         copies.alias("copies"), (F.col("size") * copies).alias("taken"))
