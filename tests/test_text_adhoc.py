"""Chunks, vector search, chat windows, ad-hoc SQL."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import ParseException

from finlake.operators import adhoc, text
from finlake.operators.text import split_text
from finlake.plans.tables import table
from tests.oracle import SF_DIR


def test_split_text_rules():
    assert split_text("") == []
    assert split_text("  short  ") == ["short"]
    words = " ".join(f"w{i:03d}" for i in range(300))
    chunks = split_text(words)
    assert all(len(c) <= 500 for c in chunks)
    # Neighbours share whole words of at most the overlap.
    for a, b in zip(chunks, chunks[1:]):
        shared = b[: b.index(a.split()[-1]) + 4]
        assert a.endswith(shared) and 0 < len(shared) <= 50
    assert " ".join(dict.fromkeys(w for c in chunks for w in c.split())) == words
    # A paragraph that fits stays whole.
    assert split_text("a" * 300 + "\n\n" + "b" * 300) == ["a" * 300, "b" * 300]
    # Text without any separator is cut by characters.
    assert [len(c) for c in split_text("x" * 1200)] == [500, 500, 300]
    # A long paragraph is cut by its lines, the short one before it is kept apart.
    assert split_text("head\n\n" + "l" * 400 + "\n" + "m" * 400) == ["head", "l" * 400, "m" * 400]


def test_recursive_chunks_cover_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = text.chunk_recursive(docs).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], {})[r["chunk_no"]] = r["text"]
    for d in docs.collect():
        chunks = by_doc.get(d["doc_id"], {})
        assert sorted(chunks) == list(range(len(chunks)))
        at = 0
        for i in range(len(chunks)):
            assert 0 < len(chunks[i]) <= 500
            found = d["text"].find(chunks[i], max(at - 500, 0))
            assert found >= 0
            at = found + len(chunks[i])
        assert "".join(d["text"].split()) == "" or d["text"].rstrip().endswith(chunks[len(chunks) - 1])


def test_chunks_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(text, "CHARACTERS_AT_ONCE", 5000)
    texts = [" ".join(f"{i}w{j}" for j in range(200)) for i in range(50)] + ["", " "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"])
    out = list(text._chunked(batch, 500, 50))
    assert len(out) > 10 and max(sum(map(len, b.column("text").to_pylist())) for b in out) < 5000 + 2 * len(texts[49])
    rows = [(r["key"], r["chunk_no"], r["text"]) for b in out for r in b.to_pylist()]
    assert rows == [(i, n, c) for i, t in enumerate(texts) for n, c in enumerate(split_text(t))]


def test_fixed_chunks(spark):
    docs = spark.createDataFrame([(1, "a" * 500), (2, "b" * 501), (3, ""), (4, None), (5, "é" * 950)], "doc_id long, text string")
    sizes = {}
    for r in text.chunk_fixed(docs).collect():
        sizes.setdefault(r["doc_id"], []).append(len(r["text"]))
    assert sizes == {1: [500], 2: [500, 51], 5: [500, 500]}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(text, "QUERIES_PER_BATCH", 3)
    monkeypatch.setattr(text, "VECTORS_PER_BLOCK", 70)
    rnd = np.random.default_rng(5)
    vecs = rnd.integers(-3, 4, (300, 4)).astype(float) + 0.1  # few values: many ties
    qs = rnd.integers(-3, 4, (8, 4)).astype(float) + 0.1
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vecs)], "vec_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(qs)], "query_id string, embedding array<double>")
    got = {}
    for r in text.knn(q, v, k=4, metric=metric).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["dist"])
    for i, x in enumerate(qs):
        if metric == "l2":
            d = np.sqrt(((vecs - x) ** 2).sum(axis=1))
        else:
            d = 1 - vecs @ x / (np.linalg.norm(vecs, axis=1) * np.linalg.norm(x))
        best = sorted(d)[:4]
        mine = [got[f"q{i}"][n] for n in range(1, 5)]
        assert [m[1] for m in mine] == pytest.approx(best)
        if metric == "l2":
            assert [m[0] for m in mine] == [int(j) for j in sorted(range(300), key=lambda j: (d[j], j))[:4]]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_equal_vectors_have_equal_distances_in_any_layout(metric):
    rng = np.random.default_rng(4)
    one, query = rng.normal(size=48), rng.normal(size=48)
    seen = set()
    for others, asked in ((0, 1), (1, 1), (6, 3), (37, 9), (120, 40)):
        block = np.vstack([rng.normal(size=(others, 48)), np.tile(one, (5, 1))])
        batch = np.vstack([rng.normal(size=(asked - 1, 48)), query])
        tables = [pa.table({name: pa.array(range(len(m))), "embedding": pa.array(list(m))})
                  for name, m in (("query_id", batch), ("vec_id", block))]
        got = text._nearest(len(block), metric)(*tables).to_pandas()
        mine = got[got.query_id == asked - 1]
        copies = mine[mine.vec_id >= others]
        assert list(copies.vec_id) == sorted(copies.vec_id) and len(copies) == 5
        seen |= set(copies.dist)
    assert len(seen) == 1


def test_knn_leaves_out_what_has_no_distance(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([("a", [2.0, 0.1]), ("n", None)], "query_id string, embedding array<double>")
    assert [r["vec_id"] for r in text.knn(q, v, k=4, metric="cosine").orderBy("rank").collect()] == [1, 2]
    assert [r["vec_id"] for r in text.knn(q, v, k=4).orderBy("rank").collect()] == [1, 3, 4, 2]


def test_knn_of_many_queries_stays_on_the_executors(spark):
    v = spark.range(50).selectExpr("id AS vec_id", "array(double(id), 1D) AS embedding")
    q = spark.range(10_000).selectExpr("id AS query_id", "array(double(id % 50), 1D) AS embedding")
    got = text.knn(q, v, k=1)
    assert got.where("vec_id = query_id % 50").count() == 10_000


def test_knn_without_queries(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert text.knn(v.where("false").withColumnRenamed("vec_id", "query_id"), v).count() == 0
    with pytest.raises(ValueError, match="metric"):
        text.knn(v.withColumnRenamed("vec_id", "query_id"), v, metric="dot")


def test_chat_context(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(8)] + [(2, 0, "system", "s"), (2, 1, "user", "u")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: (r["messages"], r["context"]) for r in text.chat_context(df).collect()}
    assert got[2] == (2, "Previous conversation:\nAssistant: s\nUser: u\n")
    assert got[1] == (6, "Previous conversation:\nUser: m2\nAssistant: m3\nUser: m4\nAssistant: m5\nUser: m6\nAssistant: m7\n")


def test_ask_sql(spark):
    spark.range(100).createOrReplaceTempView(adhoc.VIEW)
    rows, cols = adhoc.ask_sql(spark, "```sql\nSELECT id, 'drop table' AS note FROM uploaded_data ORDER BY id;\n```")
    assert cols == ["id", "note"] and rows.count() == 20
    rows, _ = adhoc.ask_sql(spark, "with t as (select max(id) m from uploaded_data) select m from t")
    assert rows.first()[0] == 99
    spark.range(3).selectExpr("id AS load", "id AS set").createOrReplaceTempView(adhoc.VIEW)
    assert adhoc.ask_sql(spark, "SELECT load, set FROM uploaded_data")[1] == ["load", "set"]
    spark.range(3).createOrReplaceTempView("other_data")
    for bad in ("DROP TABLE x", "insert into uploaded_data values (1)", "set a=b", "alter table x rename to y", "use default",
                "cache table uploaded_data", "explain select 1", "merge into x using y on true when matched then delete"):
        with pytest.raises(ValueError, match="SELECT"):
            adhoc.ask_sql(spark, bad)
    for bad in ("SELECT * FROM other_data", "SELECT * FROM parquet.`/any/path`", "SELECT (SELECT max(id) FROM other_data) FROM uploaded_data",
                "WITH t AS (SELECT * FROM other_data) SELECT * FROM t", "SELECT * FROM uploaded_data WHERE EXISTS (SELECT 1 FROM other_data)"):
        with pytest.raises(ValueError, match="unknown table"):
            adhoc.ask_sql(spark, bad)
    with pytest.raises(ValueError, match="reflect"):
        adhoc.ask_sql(spark, "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM uploaded_data")
    with pytest.raises(ParseException):
        adhoc.ask_sql(spark, "with t as (select 1) insert into")


def test_chart_frame(spark):
    df = spark.createDataFrame([(1, "a", 2.0, "b")], "n int, s string, d double, t string")
    assert adhoc.chart_frame(df).columns == ["s", "n"]
    assert adhoc.chart_frame(df.select("n", "d")) is None
    assert adhoc.chart_frame(df.select("s")) is None
