"""Harmonic packing (10): documents into sequences of one capacity, by reciprocal-capacity classes.

A document's ids are cut into whole sequences and a rest. The rest is cut at
capacity/2, capacity/4, ... down to ``least`` ids, so that its pieces fill
their classes exactly, and what is left, below ``least`` ids, stays one piece.
A piece of length n belongs to the class of floor(capacity / n); each bin of a
class takes that fixed number of pieces. Every worker fills the bins of its
own documents, independent of all others.
"""

from __future__ import annotations

import array
import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm.base import load_tokenizer, slices

#: Words whose ids a worker keeps; it starts anew when they are reached.
CACHE_WORDS = 700_000
#: Characters of a text that are encoded in one go; longer texts are cut at white space.
STEP_CHARS = 1 << 20
#: Documents of one worker's bins, on average; several workers never share a bin.
WORKER_DOCS = 8_192


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER = _byte_letters()
#: Letters whose lower case and composition are one to one, then one run of signs: two units of the split pattern.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)")


class WordIds(dict):
    """Ids by word of a vocabulary that lower-cases and drops white space: a text's ids are its words' ids in order.

    A word of plain letters and closing signs is two units of the vocabulary's
    split pattern, which go to its merge model directly and are kept by
    themselves; all other words go through the whole tokenizer.
    """

    def __init__(self, tokenizer: Any) -> None:
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.units: dict[str, list[int]] = {"": []}
        self.flat = array.array("I")
        self.ends = array.array("q")

    def __missing__(self, word: str) -> int:
        plain = _PLAIN.fullmatch(word)
        if plain:
            self.flat.extend(self._unit(plain[1].lower()))
            self.flat.extend(self._unit(plain[2]))
        elif word:
            self.flat.extend(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = at = len(self)
        self.ends.append(len(self.flat))
        return at

    def _unit(self, unit: str) -> list[int]:
        ids = self.units.get(unit)
        if ids is None:
            shown = unit if unit.isascii() else "".join(map(_LETTER.__getitem__, unit.encode()))
            ids = self.units[unit] = [t.id for t in self.model.tokenize(shown)]
        return ids

    def ids(self, numbers: list[int]) -> np.ndarray:
        at = np.asarray(numbers, dtype=np.int64)
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.uint32)
        stop = ends[at]
        start = np.where(at > 0, ends[at - 1], 0)
        lens = stop - start
        return flat[np.repeat(start - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]


def _steps(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > STEP_CHARS:
        end = text.rfind(" ", start, start + STEP_CHARS)
        if end < 0:
            end = text.find(" ", start + STEP_CHARS)
        if end < 0:
            break
        yield text[start:end]
        start = end + 1
    yield text[start:]


def text_ids(text: str, cache: WordIds) -> np.ndarray:
    """Ids of the whole text, as the library gives them without special tokens added."""
    parts = [cache.ids([cache[w] for w in step.replace("\n", " ").split(" ")]) for step in _steps(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def cuts(total: int, capacity: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids."""
    out = [(start, capacity) for start in range(0, total - total % capacity, capacity)]
    at, piece = total - total % capacity, capacity // 2
    while piece >= least and at < total:
        if total - at >= piece:
            out.append((at, piece))
            at += piece
        piece //= 2
    if at < total:
        out.append((at, total - at))
    return out


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, least: int = 32,
                     with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens`` and, if wanted, ``ids``.

    ``ids_crc32`` is the CRC-32 of the piece's ids as little-endian unsigned
    32-bit numbers, ``doc_tokens`` counts the document's ids with the
    ``end_id`` that closes it. A null or empty text is that one id. Repeated
    rows are separate documents; null ids are kept; an empty table gives no
    rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        cache = WordIds(tokenizer)
        for batch in slices(batches):
            owner, start, length, crc, total, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(text_ids(text or "", cache), np.uint32(end_id)).astype("<u4", copy=False)
                for at, n in cuts(len(ids), capacity, least):
                    piece = ids[at:at + n]
                    owner.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        kept.append(piece.astype(np.int32))
                if len(cache) > CACHE_WORDS:
                    cache = WordIds(tokenizer)
            columns = [batch.column(0).take(pa.array(owner, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def fill_bins(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece of one worker.

    Bins of a class take floor(capacity / length) pieces. The last, unfilled
    bin of a class whose length is a power of two is split into bins that hold
    a power of two of pieces, so these need no padding. The unfilled bins of
    the other classes, fewer pieces than a bin each, are mixed, longest first.
    """
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    firsts = np.flatnonzero(np.r_[True, sorted_lengths[1:] != sorted_lengths[:-1]]) if len(lengths) else []
    next_bin, loose = 0, []
    for first, stop in zip(firsts, [*firsts[1:], len(lengths)]):
        n, size = stop - first, int(sorted_lengths[first])
        each = capacity // size
        full = n - n % each
        slot = np.arange(full)
        bins[order[first:first + full]] = next_bin + slot // each
        offsets[order[first:first + full]] = slot % each * size
        next_bin += full // each
        at = first + full
        if size & (size - 1) == 0 and capacity & (capacity - 1) == 0:
            group = each
            while at < stop:
                if stop - at >= group:
                    bins[order[at:at + group]] = next_bin
                    offsets[order[at:at + group]] = np.arange(group) * size
                    next_bin += 1
                    at += group
                group //= 2
        else:
            loose += range(at, stop)
    used = capacity
    for i in loose:
        size = int(sorted_lengths[i])
        if used + size > capacity:
            next_bin, used = next_bin + 1, 0
        bins[order[i]], offsets[order[i]] = next_bin - 1, used
        used += size
    return bins, offsets


def harmonic_pack(pieces: DataFrame, capacity: int = 2048, worker_docs: int = WORKER_DOCS,
                  n_docs: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; all their columns are kept.

    Needs ``doc_id``, ``start``, ``length`` (1 to ``capacity``) and ``doc_tokens``. Workers are
    hash classes of (doc_id, start block), so that one document with a third of
    all ids is spread too; their number follows the number of documents,
    ``n_docs`` if the caller knows it (counting pieces makes them once more).
    Offsets of a sequence are gapless from 0. An empty table gives no rows.
    """
    if n_docs is None:
        n_docs = pieces.where(F.col("start") == 0).count()
    workers = max(1, -(-n_docs // worker_docs))
    spread = F.pmod(F.xxhash64("doc_id", F.floor(F.col("start") / F.lit(64 * capacity))), F.lit(workers))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def fill(rows: pa.Table) -> pa.Table:
        # Only lengths are sorted; the ids stay where they are.
        order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("doc_id", "start", "length", "doc_tokens")]).to_numpy()
        found, places = fill_bins(rows.column("length").to_numpy()[order], capacity)
        bins, offsets = np.empty_like(found), np.empty_like(places)
        bins[order], offsets[order] = found, places
        sequences = (rows.column("_worker").to_numpy().astype(np.int64) << 40) + bins
        rows = rows.drop_columns(["_worker"])
        return rows.append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets))

    return pieces.withColumn("_worker", spread).groupBy("_worker").applyInArrow(
        fill, schema + ", sequence_id long, offset long")
