"""Registered queries of this folder, and reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from finlake.llm import (
    chat, filter_audit, jaccard, langid, lines, mixing, multi_index, packing, simhash, threshold_search, token_counts,
    toxicity, whitening,
)
from finlake.llm.base import table, vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, ~langid.held_out())
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"), limit=1024)


def op4_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.exact_top_k(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


#: Two rows whose text is full of control strings, which every run formats too.
AWKWARD = r"\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", AWKWARD), (-7, 1, "assistant", AWKWARD)], turns.schema)
    path = vocabulary("byte_bpe_50k.json")
    return chat.digests(chat.format_turns(turns.unionByName(extra), path), path)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.predict(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.tokenized_pieces(docs, vocabulary("word_bpe_49k.json"), end_id=1, with_ids=False)
    return packing.harmonic_pack(pieces, n_docs=docs.count())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_multi_index": op1_multi_index,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_threshold_search": op4_threshold_search,
    "op5_line_dedup": op5_line_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_source_mixing": op7_source_mixing,
    "op8_chat_format": op8_chat_format,
    "op9_toxicity": op9_toxicity,
    "op10_harmonic_packing": op10_harmonic_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_whitening": op12_whitening,
    "op13_simhash": op13_simhash,
}

ORACLE: dict[str, str] = {
    "op4_threshold_search": threshold_search.oracle(),
    "op5_line_dedup": lines.oracle(),
    "op6_jaccard_join": jaccard.oracle(words=4, percent=85),
    "op8_chat_format": chat.oracle(AWKWARD),
    "op11_filter_audit": filter_audit.oracle(),
}
