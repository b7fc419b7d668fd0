"""SimHash near-dedup (13) by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits meet in a third one within
half that distance of both. Half of three is one bit for one of them and two
for the other: at distances one and three the two have different parity, so
fingerprints with an even number of set bits emit their variants within one
bit, the odd ones within two. Of any three bits two lie in the same half of
the word, so that pairs of bits within a half suffice: 65 and 1,056 variants.

Variants are shuffled, in parts, as packed arrays of their keys and of the
number of the flip, from which the fingerprint follows. Who can meet on a variant is
bounded by its own ball, and its fingerprints are linked in a star, not in
pairs: on an even variant all are two bits apart at most, on an odd one every
even fingerprint is within three bits of all others, and odd ones alone have
met on even variants already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm.base import slices
from finlake.llm.components import components
from finlake.llm.hashing import mix
from finlake.session import stage_table

WORDS, SEED = 3, 42
RADIUS = 3
#: Shingles whose bits are counted at once; variants that meet in one task, on average.
CHUNK, PART_VARIANTS = 1 << 15, 2_000_000

_BITS = [1 << b for b in range(64)]
EVEN_FLIPS = np.array([0, *_BITS], dtype=np.uint64)
ODD_FLIPS = np.array([*_BITS, *(a | b for half in (_BITS[:32], _BITS[32:]) for a, b in combinations(half, 2))], dtype=np.uint64)
#: All flips under one number each: an odd fingerprint's own come after those of the even ones.
FLIPS = np.concatenate([EVEN_FLIPS, ODD_FLIPS])

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str) -> int:
    """The fingerprint of a text: bit by bit what more than half of its shingles' hashes have set."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(WORDS, len(words))
    spans = list(zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()))
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), CHUNK):
        h = np.array([_hash(joined[a:b]) for a, b in spans[at:at + CHUNK]], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * votes > len(spans)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``fingerprint`` as a signed long) of every row; texts without words have 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint long")


def variants(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All variants of the fingerprints and the numbers of the flips they come from."""
    odd = np.bitwise_count(prints) % 2 == 1
    made, flips = [], []
    for own, masks, first in ((prints[~odd], EVEN_FLIPS, 0), (prints[odd], ODD_FLIPS, len(EVEN_FLIPS))):
        made.append((own[:, None] ^ masks[None, :]).ravel())
        flips.append(np.tile(np.arange(first, first + len(masks), dtype=np.uint16), len(own)))
    return np.concatenate(made), np.concatenate(flips)


def _meeting(keys: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) of fingerprints that meet on a variant, each variant a star."""
    order = np.argsort(keys)
    keys, flips = keys[order], flips[order]
    same = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
    shared = same[1:] | same[:-1]
    keys, prints = keys[shared], (keys ^ FLIPS[flips])[shared]
    order = np.lexsort((prints, np.bitwise_count(prints) % 2, keys))
    keys, prints = keys[order], prints[order]
    first = np.append(True, keys[1:] != keys[:-1])[:len(keys)]
    # Even fingerprints come first, so the first is a centre if any is one.
    centre = np.repeat(prints[first], np.diff(np.append(np.flatnonzero(first), len(keys))))
    linked = (np.bitwise_count(centre ^ prints) <= RADIUS) & (centre != prints)
    linked &= (np.bitwise_count(centre) % 2 == 0) | (np.bitwise_count(keys) % 2 == 0)
    return np.minimum(centre[linked], prints[linked]), np.maximum(centre[linked], prints[linked])


def links(prints: DataFrame, n: int) -> DataFrame:
    """(``a``, ``b``) of distinct fingerprints, signed longs: enough links within RADIUS bits to join all that link.

    ``prints`` has ``n`` distinct ``fingerprint``. The number of parts follows
    it, so that a part holds PART_VARIANTS variants whatever the input.
    """
    shuffled = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffled, -(-n * len(FLIPS) // (2 * PART_VARIANTS)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            made, flips = variants(batch.column(0).to_numpy().view(np.uint64))
            # The parts are even: neighbouring fingerprints do not share one.
            part = (mix(made) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            made, flips, part = made[order], flips[order], part[order]
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(at[1:], len(part))
            yield pa.RecordBatch.from_arrays([
                pa.array(part[at], pa.int32()), pa.array([made[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
                pa.array([flips[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())], names=["part", "variants", "flips"])

    def meet(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("variants").to_pylist()), np.uint64)
        flips = np.frombuffer(b"".join(table.column("flips").to_pylist()), np.uint16)
        a, b = _meeting(keys, flips)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    packed = prints.select("fingerprint").mapInArrow(emit, "part int, variants binary, flips binary")
    return packed.groupBy("part").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``.

    A-Z are lower-cased; words are what blanks and control characters 9 to 13
    separate. Texts that are null, empty or without words have fingerprint
    zero and link like any other. ``component_id`` is the smallest id
    reachable by links of at most RADIUS differing bits, null if no row there
    has an id; a row with a null id is a row like any other. Copies and rows
    that repeat an id are separate rows with one fingerprint, which is looked
    up once. An empty table gives no rows; other columns are not read.
    """
    rows = stage_table(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stage_table(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    found = stage_table(links(distinct, distinct.count()), "near")
    roots = components(found).withColumnRenamed("node", "fingerprint")
    placed = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage_table(placed.join(smallest, "root").select("fingerprint", "component_id"), "named")
    return rows.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
