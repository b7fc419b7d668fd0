"""Both vector searches against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from finlake.llm import multi_index, threshold_search, vectors
from finlake.llm.queries import ORACLE, QUERIES
from tests.oracle import SF_DIR, compare

NAN, INF = float("nan"), float("inf")


def brute(rows, k, every, scale=None, no_zero=False):
    good = []
    for i, v, *_ in rows:
        if i is None or v is None or any(c is None or not np.isfinite(c) for c in v) or no_zero and not any(v):
            continue
        good.append((i, np.floor(scale * np.array(v)) if scale else np.array(v, dtype=float)))
    out = {}
    for q, x in good:
        if q % every == 0:
            scored = sorted(((-(x @ y), i) for i, y in good if i != q and len(y) == len(x)))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def check(got, want):
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    for q, v in found.items():
        assert np.allclose([s for _, s in v], [s for _, s in want[q]], rtol=1e-12)


@pytest.fixture
def rows():
    rng = np.random.default_rng(4)
    out = [(i, rng.normal(0, 0.2, 8).tolist(), "x") for i in range(60)]
    out += [(i, [0.5] * 8, "copy") for i in range(60, 100)]
    return out + [(100, None, ""), (101, [0.1, None] * 4, ""), (102, [NAN] * 8, ""), (103, [INF] * 8, ""), (104, [0.0] * 8, ""),
                  (None, [0.1] * 8, ""), (120, [1.0, 2.0, 3.0], ""), (121, [1.0, 0.0, 3.0], ""), (5, [0.5] * 8, "again"), (140, [], "")]


def test_exact_search(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    check(threshold_search.exact_top_k(df, 5, 20).collect(), brute(rows, 5, 20, 64.0))
    monkeypatch.setattr(threshold_search, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(threshold_search, "BATCH_QUERIES", 2)
    check(threshold_search.exact_top_k(df, 5, 20).collect(), brute(rows, 5, 20, 64.0))
    assert threshold_search.exact_top_k(df.limit(0)).count() == 0


def test_reading_stops_early_and_stays_exact():
    rng = np.random.default_rng(0)
    x = np.floor(64 * rng.normal(0, 0.13, (3000, 16)) * rng.choice([1, 4], (3000, 1), p=[0.95, 0.05]))
    q, ids = x[::100], np.arange(3000)
    who, found, scores = threshold_search.search_block(x, ids, q, ids[::100], 10)
    for i in range(len(q)):
        s = x @ q[i]
        s[i * 100] = -np.inf
        order = np.lexsort((ids, -s))[:10]
        assert found[who == i].tolist() == order.tolist() and scores[who == i].tolist() == s[order].tolist()


def test_large_components_are_exact(spark):
    """Beyond 2**23, which used to be cut, and beyond the integers of a double."""
    rows = [(i, [float(2**23 + i) + 0.5, 2.0**20 * i, -3.0 * 2.0**(i % 4)]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(threshold_search.exact_top_k(df, 3, 2).collect(), key=lambda r: (r.query_id, r.rank))
    whole = {i: [int(np.floor(64 * c)) for c in v] for i, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b]))
    want = [(q, r + 1, i, dot(q, i)) for q in range(0, 8, 2)
            for r, i in enumerate(sorted((i for i in whole if i != q), key=lambda i: (-dot(q, i), i))[:3])]
    assert [tuple(r) for r in got] == want


def test_integers_of_any_size():
    assert threshold_search.whole(np.array([[1e308, -0.01, 2.0**60 + 1]]), 64.0) == [[64 * int(1e308), -1, 64 * 2**60]]
    assert threshold_search.exact_top([[2**70, 1], [2**70, 2], [1, 1]], np.array([5, 6, 7]), [2**70, 1], 9, 2) == [
        (2**140 + 2, 6), (2**140 + 1, 5)]
    with pytest.raises(OverflowError):
        threshold_search.as_long(2**63)


def test_multi_index_takes_all_when_small(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string")
    rounded = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v, _ in rows]
    got = multi_index.nearest_neighbours(df, 200, 20).collect()
    check(got, brute(rounded, 200, 20, no_zero=True))
    assert multi_index.nearest_neighbours(df.limit(0)).count() == 0


def test_multi_index_recall(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_VECTORS", 500)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (40, 16))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.4, (4000, 16))
    x[1000:2300] = x[7]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.nearest_neighbours(df, 10, 20).collect()
    scores = {}
    for r in got:
        scores.setdefault(r.query_id, []).append(r.score)
    hits = 0
    for q, mine in scores.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += (np.array(mine) >= np.sort(s)[-10] - 1e-9).sum()
    assert hits / (10 * len(range(0, 4000, 20))) >= 0.9 and len(got) == 10 * 200


def test_visits_follow_summed_scores():
    rng = np.random.default_rng(2)
    index = multi_index.fit(rng.normal(size=(900, 6)), 5)
    q, sizes = rng.normal(size=6), np.ones(len(index.first) * len(index.second), dtype=np.int64)
    order = index.visit(q, sizes, len(sizes))
    sums = (index.first @ q[:3])[:, None] + (index.second @ q[3:])[None, :]
    assert sorted(order) == list(range(len(sizes))) and (np.diff(sums.ravel()[order]) <= 1e-12).all()


def test_best_rows():
    best = vectors.best_rows(np.array([1, 1, 0, 1]), np.array([9, 3, 5, 4]), np.array([2.0, 2.0, 1.0, 7.0]), 2)
    assert best.tolist() == [2, 3, 1]


def test_equal_vectors_score_alike_in_any_layout():
    """One vector many times, in blocks of many shapes: one score for a query, ties to the smaller ids."""
    rng = np.random.default_rng(6)
    one, q = rng.normal(size=64), rng.normal(size=(9, 64))
    seen = set()
    for n in (1, 3, 7, 64, 100, 257, 1000):
        for queries in (1, 4, 9):
            x = np.vstack([np.tile(one, (n, 1)), rng.normal(size=(n, 64)) / 100])
            cells = np.repeat([0, 1], n)
            ids = rng.permutation(2 * n) + 1000
            entries = pa.table({"vec_id": ids, "vec": pa.array(x.tolist()), "cell": cells})
            asked = pa.table({"query_id": np.arange(queries), "vec": pa.array(q[:queries].tolist()), "cells": pa.array([[0, 1]] * queries)})
            got = multi_index._reranker(5)(entries, asked).to_pandas()
            copies = set(ids[:n].tolist())
            for i, rows in got.groupby("query_id"):
                alike = rows[rows.vec_id.isin(copies)]
                seen |= {(i, s) for s in alike.score}
                if len(alike) and q[i] @ one > 1:
                    assert alike.vec_id.tolist() == sorted(copies)[:5]
    assert len(seen) == len({i for i, _ in seen})


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None]
    want = brute(rows, 20, 20, no_zero=True)
    got = multi_index.nearest_neighbours(df).collect()
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("name", ["op4_threshold_search", "op6_jaccard_join", "op8_chat_format"])
def test_queries_equal_their_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) is None
