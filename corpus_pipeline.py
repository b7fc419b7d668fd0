"""Cleaning, mixing and packing of a corpus, in stages that are each written and read again.

Every stage takes the documents its predecessor kept and returns documents
with the same columns; the last one returns the packed pieces. Null texts are
rejected by the first stage. A document is an id and a text: different texts
under one id, or under none, are different documents. An empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.llm import jaccard, langid, lines, mixing, packing
from finlake.llm.base import table, vocabulary
from finlake.session import stage_table


def named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_document``, one value for each id and text, ordered by the id, a null id last."""
    return docs.withColumn("_document", F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the model rejects; the rest stays as it is."""
    model = langid.train(docs, ~langid.held_out())
    return langid.predict(docs, model).where(~F.col("lang_rejected")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that a large share of a source's documents have; every document stays."""
    kept = lines.drop_boilerplate(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near copies.

    Five-word shingles, similarity 0.8. Documents without words are no copies
    of each other and stay. Rows that repeat id and text are one document.
    """
    rows = named(docs)
    groups = jaccard.jaccard_components(rows, id_col="_document")
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_document")).distinct()
    return rows.join(first, "_document").dropDuplicates(["_document"]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources meet their targets; a document taken twice is two rows.

    Rows that repeat id and text are one document.
    """
    rows = named(docs).dropDuplicates(["_document"])
    rows = rows.withColumn("_document", F.concat_ws(":", "_document.doc_id", "_document.h", "_document.g"))
    copies = mixing.mix(rows, id_col="_document").where("copies > 0").select(
        F.col("doc_id").alias("_document"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return rows.join(copies, "_document").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids, sequence and place."""
    pieces = packing.tokenized_pieces(docs, vocabulary("word_bpe_49k.json"), end_id=1)
    return packing.harmonic_pack(pieces, n_docs=docs.count())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("source_mixing", mix_sources),
    ("packing", pack),
]

#: Training, sampling and tokenizing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
