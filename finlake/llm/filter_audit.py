"""Filter interaction audit (11): contingency tensors of five text filters, contracted for every order and step.

Spark computes the five verdicts of each document and counts documents for
each part and combination of verdicts: at most 32 cells a part. A part's cells
are a 2x2x2x2x2 tensor, one axis a filter, 0 for pass and 1 for fail. One
einsum with the selectors pass, fail and all along every axis turns it into
3x3x3x3x3 sums, of which each figure of each step of each order is one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.llm.base import slices

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Entries of a contracted axis.
PASS, FAIL, ALL = 0, 1, 2
SELECTORS = np.array([[1, 0], [0, 1], [1, 1]], dtype=np.int64)

FEWEST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITAL_PERCENT = 5
SYMBOLS = "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"

FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES)


def verdicts(text: Column) -> dict[str, Column]:
    """Whether a text fails the filters A to D, as columns; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < FEWEST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > MOST_CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
          quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(``part``, ``cell``, ``n``, ``good``, ``toxic``): documents of each part and combination of verdicts.

    ``cell`` has the verdict of A as its highest bit. Texts are compared by
    their SHA-256, and only digests and ids are shuffled. A row fails E when
    the smallest id of its text is smaller than its own: copies that repeat an
    id and rows with a null id pass. Several labels of a document count as one
    that holds what any of them says.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((v.cast("int") * (1 << 4 - i) for i, v in enumerate(verdicts(F.col(text_col)).values())), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        bits.alias("bits"), F.sha2(text.cast("binary"), 256).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    rows = rows.join(firsts.where("copies > 1").select("digest", "first"), "digest", "left")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
        F.max((F.col(quality_col) == 1).cast("int")).alias("good"), F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic"))
    rows = rows.select("doc_id", "part", (F.col("bits") + F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")).alias("cell"))
    # A third of all ids may be null or one id: counted before they meet their label.
    counted = rows.groupBy("doc_id", "part", "cell").agg(F.count("*").alias("n"))
    return counted.join(marks, "doc_id", "left").groupBy("part", "cell").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))


@dataclass(frozen=True)
class Steps:
    """Where the figures of every (order, step) lie in the contracted tensor: flat positions, one an order and step."""

    order: list[str]
    step: list[int]
    filter: np.ndarray
    kept: np.ndarray
    removed: np.ndarray
    failing: np.ndarray
    unique: np.ndarray


def _steps() -> Steps:
    def flat(choice: dict[str, int], rest: int) -> int:
        return int(np.ravel_multi_index([choice.get(f, rest) for f in FILTERS], (3,) * 5))

    found = []
    for order in ORDERS:
        for i, f in enumerate(order):
            before = dict.fromkeys(order[:i], PASS)
            found.append((order, i + 1, FILTERS.index(f), flat(before | {f: PASS}, ALL), flat(before | {f: FAIL}, ALL),
                          flat({f: FAIL}, ALL), flat({f: FAIL}, PASS)))
    order, step, *rest = zip(*found)
    return Steps(list(order), list(step), *(np.array(r) for r in rest))


STEPS = _steps()


def contract(tensors: np.ndarray) -> np.ndarray:
    """Sums over pass, fail and all along each of the last five axes: (parts, kinds, 2, 2, 2, 2, 2) to (parts, kinds, 243)."""
    sums = np.einsum("pkabcde,va,wb,xc,yd,ze->pkvwxyz", tensors, *[SELECTORS] * 5, optimize="greedy")
    return sums.reshape(*tensors.shape[:2], 3**5)


def figures(tensors: np.ndarray) -> np.ndarray:
    """(parts, 600, 7): the figures of every order and step, from the counts of all, good and toxic documents."""
    sums = contract(tensors)
    all_, good, toxic = sums[:, 0], sums[:, 1], sums[:, 2]
    removed = all_[:, STEPS.removed]
    by_filter = np.stack([removed[:, STEPS.filter == f].sum(axis=1) for f in range(5)], axis=1)
    return np.stack([
        all_[:, STEPS.kept], removed, all_[:, STEPS.failing] - removed, all_[:, STEPS.unique],
        good[:, STEPS.removed], toxic[:, STEPS.removed], by_filter[:, STEPS.filter]], axis=2)


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, filter order and step, zeros included.

    ``columns`` names the columns as for :func:`cells`. A null part is the
    empty string. Null and empty texts fail A alone, beside E for copies.
    Labels of unknown ids count nowhere; null labels count as 0. An empty
    ``docs`` gives no rows. Other columns are not read. Rows that repeat an id
    are separate documents.
    """
    per_part = cells(docs, labels, **columns).groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            parts, found = batch.column(0), batch.column(1)
            tensors = np.zeros((len(parts), 3, 32), dtype=np.int64)
            entries = found.flatten()
            owner = np.repeat(np.arange(len(parts)), np.diff(found.offsets.to_numpy()))
            at = entries.field("cell").to_numpy()
            for k, name in enumerate(("n", "good", "toxic")):
                tensors[owner, k, at] = entries.field(name).to_numpy()
            out = figures(tensors.reshape(-1, 3, 2, 2, 2, 2, 2)).reshape(-1, len(FIGURES))
            n = len(STEPS.order)
            yield pa.RecordBatch.from_arrays(
                [parts.take(pa.array(np.repeat(np.arange(len(parts)), n))), pa.array(STEPS.order * len(parts)),
                 pa.array(STEPS.step * len(parts), pa.int32()), *(pa.array(c, pa.int64()) for c in out.T)],
                names=["part", "filter_order", "step", *FIGURES])

    return per_part.mapInArrow(run, RESULT)


def oracle() -> str:
    """DuckDB SQL for :func:`audit` of ``documents`` and ``labels``."""
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         [w FOR w IN regexp_split_to_array(coalesce(text, ''), '{BLANKS}') IF w <> ''] AS words FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [f FOR f IN [
    CASE WHEN len(words) < {FEWEST_WORDS} THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT_PERCENT} * len(words) THEN 'B' END,
    CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITAL_PERCENT} * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 'D' END,
    CASE WHEN doc_id > first THEN 'E' END] IF f IS NOT NULL] AS failed
  FROM docs JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS f, string_split(filter_order[:step - 1], '') AS before
  FROM orders, range(1, 6) r(step)),
figures AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT list_has_any(failed, before) AND NOT list_contains(failed, f) THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT list_has_any(failed, before) AND list_contains(failed, f) THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN list_has_any(failed, before) AND list_contains(failed, f) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = [f] THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT list_has_any(failed, before) AND list_contains(failed, f) THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT list_has_any(failed, before) AND list_contains(failed, f) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM figures"""
