"""Helpers shared by the operators of this folder: tables, tokenizers, batches."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that are worked on together; bounds the arrays of a task, drops nothing.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: Column | str, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; null ids give null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


def vocabulary(name: str) -> str:
    """Place of an installed public tokenizer file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def load_tokenizer(path: str, plain_specials: bool = False) -> Any:
    """One tokenizer per worker process. ``plain_specials``: special strings in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in order, a bounded number at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def hash_fraction(*cols: Column | str, salt: int = 0) -> Column:
    """A repeatable number in [0, 1) for each row, from a hash of ``cols``."""
    return F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(2**40)) / F.lit(float(2**40))
