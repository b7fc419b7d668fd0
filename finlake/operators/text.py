"""Document chunks, vector search, chat windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlake.session import new_path

# Chunk size, overlap, separators in order of preference, neighbours, window.
CHUNK_SIZE = 500
OVERLAP = 50
SEPARATORS = ("\n\n", "\n", " ", "")
NEIGHBOURS = 4
LAST_MESSAGES = 6
# Characters of chunks that a task holds at once; drops nothing.
CHARACTERS_AT_ONCE = 1_000_000
# Queries and vectors, on average, that one matrix product compares.
QUERIES_PER_BATCH = 1024
VECTORS_PER_BLOCK = 4096
# Pairs of a query and a candidate whose vectors are laid side by side.
PAIRS_AT_ONCE = 16_384


def chunk_fixed(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap`` characters, over the whole text."""
    stride = size - overlap
    n = F.char_length(text)
    last = F.greatest(F.ceil((n - size) / stride), F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text), i * stride + 1, F.lit(size)))
    return docs.where(n > 0).select(key, F.posexplode(pieces).alias("chunk_no", "text"))


def _pieces(text: str, separators: Sequence[str]) -> Iterator[tuple[str, Sequence[str]]]:
    """Parts of ``text`` at its first usable separator, each keeping the separator in front."""
    i = next(j for j, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[i], separators[i + 1:]
    if sep == "":
        parts = list(text)
    else:
        head, *tail = text.split(sep)
        parts = [head, *(sep + t for t in tail)]
    return ((p, finer) for p in parts if p)


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP,
               separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters cut at the coarsest separator that fits.

    Neighbouring small parts are joined; a chunk starts with the tail of the
    one before it, as far as whole parts fit into ``overlap``.
    """
    chunks: list[str] = []
    held: deque[str] = deque()
    total = 0

    def emit() -> None:
        chunk = "".join(held).strip()
        if chunk:
            chunks.append(chunk)

    for part, finer in _pieces(text, separators):
        if len(part) >= size and finer:
            if held:
                emit()
                held.clear()
                total = 0
            chunks.extend(split_text(part, size, overlap, finer))
            continue
        if held and total + len(part) > size:
            emit()
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.popleft())
        held.append(part)
        total += len(part)
    if held:
        emit()
    return chunks


def _chunked(batch: pa.RecordBatch, size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """The chunks of a batch of (key, text), in batches of about CHARACTERS_AT_ONCE characters."""
    keys, texts = batch.column("key"), batch.column("text")
    who, numbers, chunks, held = [], [], [], 0
    for i in range(batch.num_rows):
        parts = split_text(texts[i].as_py(), size, overlap)
        who += [i] * len(parts)
        numbers += range(len(parts))
        chunks += parts
        held += sum(map(len, parts))
        if held >= CHARACTERS_AT_ONCE or i == batch.num_rows - 1:
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(who, pa.int64())), pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())],
                ["key", "chunk_no", "text"])
            who, numbers, chunks, held = [], [], [], 0


def chunk_recursive(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``split_text`` over all documents, one row per chunk.

    A task holds the chunks of few documents at a time, however many rows an Arrow batch has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _chunked(batch, size, overlap)

    source = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {key_type}, chunk_no int, text string").withColumnRenamed("key", key)


def build_index(chunks: DataFrame, path: str | None = None) -> tuple[DataFrame, int]:
    """Write the chunk table once; returns the table and its number of chunks."""
    spark = chunks.sparkSession
    path = path or new_path(spark, "chunks")
    chunks.write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    return table, table.count()


def _distances(queries: np.ndarray, block: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all queries to all vectors of a block, from one matrix product."""
    dots = queries @ block.T
    if metric == "cosine":
        return 1.0 - dots / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(block, axis=1)[None, :])
    squares = (queries * queries).sum(axis=1)[:, None] + (block * block).sum(axis=1)[None, :] - 2 * dots
    return np.sqrt(np.maximum(squares, 0))


def _pair_distances(queries: np.ndarray, block: np.ndarray, who: np.ndarray, at: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs (who, at), each summed in one order: equal vectors get equal digits in any block."""
    out = np.empty(len(who))
    for low in range(0, len(who), PAIRS_AT_ONCE):
        part = slice(low, low + PAIRS_AT_ONCE)
        q, v = queries[who[part]], block[at[part]]
        if metric == "cosine":
            out[part] = 1.0 - (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
        else:
            out[part] = np.sqrt(((q - v) ** 2).sum(axis=1))
    return out


def _nearest(k: int, metric: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``k`` best of one block of vectors for one batch of queries, ties to the smaller id."""
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", queries.schema.field("query_id").type),
                            ("vec_id", vectors.schema.field("vec_id").type), ("dist", pa.float64())])
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        q, v = (np.stack(t.column("embedding").to_numpy()) for t in (queries, vectors))
        by_name = np.argsort(vectors.column("vec_id").to_numpy(), kind="stable")
        v = v[by_name]
        dist = _distances(q, v, metric)
        last = min(k, len(v)) - 1
        # All up to the k-th, with room for the digits that the product loses, so ties are settled by id.
        room = 1e-6 * max(1.0, float(np.abs(v).max()) * v.shape[1], float(np.abs(q).max()) * v.shape[1])
        who, at = np.nonzero(dist <= np.partition(dist, last, axis=1)[:, last, None] + room)
        exact = _pair_distances(q, v, who, at, metric)
        order = np.lexsort((at, exact, who))
        first = np.searchsorted(who[order], np.arange(len(q)))
        best = order[np.arange(len(order)) - first[who[order]] < k]
        return pa.table([queries.column("query_id").take(pa.array(who[best])),
                         vectors.column("vec_id").take(pa.array(by_name[at[best]])), pa.array(exact[best])], schema=schema)

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int = NEIGHBOURS, metric: str = "l2") -> DataFrame:
    """Exact ``k`` nearest vectors per query: query_id, rank, vec_id, dist.

    ``queries`` has query_id and embedding, ``vectors`` vec_id and embedding.
    Both stay tables: vectors are dealt to blocks by a hash of their id, and
    batches of queries meet each block in one matrix product. Every pair of a
    batch and a block returns ``k`` rows per query and only those are merged.
    Null vectors and those of another length than the query are no
    neighbours; by cosine, zero vectors have no direction and take no part.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric: {metric}")

    def usable(df: DataFrame, name: str) -> DataFrame:
        df = df.select(name, F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("_dim"))
        known = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
        if metric == "cosine":
            known &= F.exists("embedding", lambda x: x != 0)
        return df.where(known)

    asked, stored = usable(queries, "query_id"), usable(vectors, "vec_id")
    batches, blocks = -(-asked.count() // QUERIES_PER_BATCH) or 1, -(-stored.count() // VECTORS_PER_BLOCK) or 1
    left = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(batches)).alias("_batch"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    right = stored.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("_block"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(batches - 1).cast("bigint"))).alias("_batch"))
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    key = ("_dim", "_batch", "_block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _nearest(k, metric), f"query_id {kinds[0]}, vec_id {kinds[1]}, dist double")
    w = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "dist")


def chat_context(messages: DataFrame, n: int = LAST_MESSAGES, key: str = "conv_id") -> DataFrame:
    """The last ``n`` messages per conversation as prompt text.

    The rank filter runs map-side, so at most ``n`` rows per conversation and
    task are shuffled and collected.
    """
    newest = Window.partitionBy(key).orderBy(F.desc("turn"))
    speaker = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    last = messages.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).select(
        key, F.struct("turn", F.concat(speaker, F.col("text")).alias("line")).alias("_m"))
    lines = F.transform(F.sort_array(F.collect_list("_m")), lambda m: m["line"])
    return last.groupBy(key).agg(
        F.count(F.lit(1)).alias("messages"),
        F.concat(F.lit("Previous conversation:\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("context"),
    )
