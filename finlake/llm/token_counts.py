"""Token counts of whole texts (3): overlapping chunks of huge documents, spliced where both sides agree.

Ordinary texts are cut in front of single blanks that follow a visible
character. A byte-level vocabulary never joins across such a place, so the
count of the text is the sum of the counts of its blank-led words, and most
words were met before. Texts above ``huge_chars`` are encoded as overlapping
chunks with offsets instead, whose tokens are spliced at a proven boundary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from finlake.llm.base import load_tokenizer, slices

#: Words whose counts a worker keeps; it starts anew when they are reached.
CACHE_WORDS = 600_000
#: Longest special string of a public vocabulary, with room to spare.
SPECIAL_CHARS = 64
_WHITE_THEN_BLANK = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]


def _boundaries(tokenizer: Any, text: str) -> list[tuple[int, int]]:
    """(character, tokens before it) wherever a word of the tokenizer begins, and the end of the text.

    A token of part of a character has the offsets of the whole character, so
    starts of words are read from the word numbers, not from the tokens.
    """
    encoding = tokenizer.encode(text, add_special_tokens=False)
    out, last, previous_end = [], -1, 0
    for i, (word, (start, end)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word is None or word != last:
            out.append((max(start, previous_end), i))
        last, previous_end = word, end
    out.append((len(text), len(encoding.ids)))
    return out


def splice_count(tokenizer: Any, text: str, chunk: int, overlap: int) -> int:
    """Tokens of ``text``, encoding no more than a chunk and its overlap at a time.

    A boundary between words of a chunk is proven when it lies well before the
    chunk's end: the split patterns of byte-level vocabularies look one
    character ahead and never back, and a special string is no longer than
    ``SPECIAL_CHARS``. Where the next chunk, which began earlier, has a
    boundary at the same character, both read the same tokens from there on.
    If the overlap holds no common boundary, it is widened to the left and the
    right until it does, at worst to the whole text.
    """
    total, done = 0, 0          # tokens before, and the character of, the last proven boundary
    while True:
        width = overlap
        while True:
            end = min(len(text), done + chunk + width)
            here = _boundaries(tokenizer, text[done:end])
            if end == len(text):
                return total + here[-1][1]
            right = max(done + 1, end - width)
            there = {right + at for at, _ in _boundaries(tokenizer, text[right:min(len(text), end + width)])[1:-1]}
            proven = [(done + at, n) for at, n in here[1:-2] if done + at <= end - SPECIAL_CHARS]
            # The right chunk may begin inside a special string, which then ends within SPECIAL_CHARS.
            common = [(at, n) for at, n in proven if at in there and at >= right + SPECIAL_CHARS]
            if common:
                break
            width *= 2
        done, n = common[-1]
        total += n


class _Counts(dict):
    """Counts by blank-led word; unknown words wait for one batch call."""

    def __init__(self, tokenizer: Any) -> None:
        super().__init__()
        self.tokenizer, self.waiting = tokenizer, []
        self.values_ = np.zeros(1024, dtype=np.int32)

    def __missing__(self, word: str | tuple[str]) -> int:
        self[word] = at = len(self)
        self.waiting.append(word)
        return at

    def settle(self) -> None:
        if len(self) > len(self.values_):
            self.values_ = np.concatenate([self.values_, np.zeros(len(self), dtype=np.int32)])
        if self.waiting:
            found = self.tokenizer.encode_batch_fast(self.waiting, add_special_tokens=False)
            first = len(self) - len(self.waiting)
            self.values_[first:len(self)] = [len(e) for e in found]
            self.waiting = []


def _words(text: str) -> list[str]:
    """The text in pieces that begin with a blank after a visible character; joined they are the text."""
    head, *rest = text.split(" ")
    out = [head]
    for word in rest:
        if out[-1][-1:].isspace() or not out[-1]:
            out[-1] += " " + word
        else:
            out.append(" " + word)
    return out


def _lacks_runs(text: str) -> bool:
    """No blank follows another white space or starts the text, so that plain splitting is enough."""
    return not text.startswith(" ") and not any(pair in text for pair in _WHITE_THEN_BLANK)


def count_batch(texts: list[str], tokenizer: Any, cache: _Counts) -> np.ndarray:
    """Tokens of each text, from the counts of its pieces."""
    at, sizes = [], []
    for text in texts:
        if not text:
            sizes.append(0)
            continue
        if _lacks_runs(text):
            head, *rest = text.split(" ")
            got = [cache[(head,)], *map(cache.__getitem__, rest)]
        else:
            got = [cache[w[1:]] if i else cache[(w,)] for i, w in enumerate(_words(text))]
        at += got
        sizes.append(len(got))
    cache.settle()
    sums = np.concatenate([[0], np.cumsum(cache.values_[np.asarray(at, dtype=np.int64)])])
    sizes = np.asarray(sizes, dtype=np.int64)
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


class _Led(_Counts):
    """Heads of texts are keys as one-tuples and stand for themselves; a string stands for a blank and itself."""

    def settle(self) -> None:
        self.waiting = [w[0] if isinstance(w, tuple) else " " + w for w in self.waiting]
        super().settle()


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
                 huge_chars: int = 65_536, chunk_chars: int = 32_768, overlap_chars: int = 2_048) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    Counts are those of the library for the whole text, without special
    tokens added; special strings inside a text count as the library's default
    has it. Null and empty texts have 0 bytes and 0 tokens; null ids and
    repeated rows are kept as they are; an empty table gives no rows; other
    columns of ``docs`` are not read, so their names cannot clash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        cache = _Led(tokenizer)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = np.zeros(len(texts), dtype=np.int64)
            usual = np.flatnonzero([len(t) <= huge_chars for t in texts])
            tokens[usual] = count_batch([texts[i] for i in usual], tokenizer, cache)
            for i, t in enumerate(texts):
                if len(t) > huge_chars:
                    tokens[i] = splice_count(tokenizer, t, chunk_chars, overlap_chars)
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
            if len(cache) > CACHE_WORDS:
                cache = _Led(tokenizer)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
