"""Chunking, search, chat and ad-hoc queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from finlake.functions.numeric import portable_round
from finlake.operators import adhoc, text
from finlake.plans.oracle_views import pr
from finlake.plans.registry import query
from finlake.plans.tables import table

_CHUNKS = """SELECT doc_id, i::INTEGER AS chunk_no, substring(text, (i*450+1)::INTEGER, 500) AS text FROM (
  SELECT doc_id, text, unnest(generate_series(0, greatest(ceil((length(text)-500)/450e0)::INTEGER, 0))) AS i FROM documents WHERE length(text)>0)"""


@query("txt1_chunk_recursive")
def _(spark, d):
    return text.chunk_recursive(table(spark, d, "documents"))


@query("txt1_chunk_checks", """SELECT doc_id, 0::BIGINT AS too_long, 0::BIGINT AS not_in_text, 0::BIGINT AS out_of_order
    FROM documents WHERE trim(text, ' ' || chr(10)) <> ''""")
def _(spark, d):
    """Chunks are short and numbered parts of the text."""
    docs = table(spark, d, "documents")
    chunks = text.chunk_recursive(docs).join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    return chunks.groupBy("doc_id").agg(
        F.count_if(F.length("text") > text.CHUNK_SIZE).alias("too_long"),
        F.count_if(~F.expr("contains(whole, text)")).alias("not_in_text"),
        (F.max("chunk_no") + 1 - F.count_distinct("chunk_no")).cast("bigint").alias("out_of_order"))


@query("txt2_chunk_fixed", _CHUNKS)
def _(spark, d):
    return text.chunk_fixed(table(spark, d, "documents"))


@query("txt3_build_index", f"SELECT doc_id, count(*) AS chunks FROM ({_CHUNKS}) GROUP BY doc_id")
def _(spark, d):
    index, _ = text.build_index(text.chunk_fixed(table(spark, d, "documents")))
    return index.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


def _label_centres(vectors):
    """One query vector per label: the mean of its vectors, as long as they are."""
    parts = vectors.select(F.col("label").alias("query_id"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("query_id", "i").agg(portable_round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy("query_id").agg(F.transform(ordered, lambda p: p["m"]).alias("embedding"))


def _knn_sql(dist: str) -> str:
    return f"""WITH q AS (SELECT query_id, list(m ORDER BY i) AS v FROM (
    SELECT label AS query_id, i, {pr('avg(x)', 6)} AS m FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY query_id)
    SELECT query_id, rn::INTEGER AS rank, vec_id, {pr('dist', 6)} AS dist FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rn FROM (
        SELECT query_id, vec_id, {dist} AS dist FROM q, embeddings)) WHERE rn<=4"""


@query("vec1_joi6_knn", _knn_sql("list_distance(embedding::DOUBLE[], v)"))
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    return text.knn(_label_centres(vectors), vectors).withColumn("dist", portable_round("dist", 6))


@query("vec1_knn_cosine", _knn_sql("1e0-list_cosine_similarity(embedding::DOUBLE[], v)"))
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    return text.knn(_label_centres(vectors), vectors, metric="cosine").withColumn("dist", portable_round("dist", 6))


@query("win8_chat_context", """SELECT conv_id, count(*) AS messages,
    'Previous conversation:' || chr(10) || string_agg(CASE WHEN role='user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) || chr(10) AS context
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn<=6 GROUP BY conv_id""")
def _(spark, d):
    return text.chat_context(table(spark, d, "conversations"))


_ASK = "SELECT o_orderpriority, count(*) AS orders, max(o_totalprice) AS largest FROM {} GROUP BY o_orderpriority ORDER BY o_orderpriority"


@query("adh1_ask_sql", _ASK.format("orders") + " LIMIT 20")
def _(spark, d):
    table(spark, d, "orders").createOrReplaceTempView(adhoc.VIEW)
    rows, _ = adhoc.ask_sql(spark, f"```sql\n{_ASK.format(adhoc.VIEW)};\n```")
    return rows


@query("adh2_summarise", """SELECT 'conv_id, turn, role, text' AS columns, count(*) AS rows FROM conversations""")
def _(spark, d):
    df = table(spark, d, "conversations")
    rows, columns = adhoc.summarise(df)
    return df.agg(F.lit(", ".join(columns)).alias("columns"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") == rows)


@query("adh3_chart_frame", "SELECT o_orderpriority, count(*) AS orders FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    table(spark, d, "orders").createOrReplaceTempView(adhoc.VIEW)
    rows, _ = adhoc.ask_sql(spark, _ASK.format(adhoc.VIEW))
    return adhoc.chart_frame(rows)
