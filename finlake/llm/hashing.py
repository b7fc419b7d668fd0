"""Hashes of words and shingles over many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed in one go; longer texts are cut between two words.
CHUNK_BYTES = 1 << 21

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x9FB21C651E98DF25)


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    if n > 1:
        out[1:] = _STEP
        np.multiply.accumulate(out, out=out)
    return out


_POWERS = _powers(256)


def _parts(data: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK_BYTES that end between words."""
    start = 0
    while len(data) - start > CHUNK_BYTES:
        near = np.frombuffer(data, np.uint8, CHUNK_BYTES, start)
        cuts = np.flatnonzero(_WHITE[near])
        if len(cuts):
            end = start + int(cuts[-1]) + 1
        else:
            rest = np.flatnonzero(_WHITE[np.frombuffer(data, np.uint8, -1, start + CHUNK_BYTES)])
            end = start + CHUNK_BYTES + int(rest[0]) + 1 if len(rest) else len(data)
        yield data[start:end]
        start = end
    yield data[start:]


def _hash_chunk(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_WHITE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    lens = ends - starts
    at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    powers = _POWERS if int(lens.max()) <= len(_POWERS) else _powers(int(lens.max()))
    weighted = _BYTE[_LOWER[data[np.repeat(starts, lens) + at]]] * powers[at]
    hashes = mix(np.add.reduceat(weighted, np.cumsum(lens) - lens))
    borders = np.cumsum([len(p) + 1 for p in parts])
    return np.searchsorted(borders, starts, side="right"), hashes


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text, and 64-bit hash, of each word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in order."""
    owners, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    parts: list[bytes] = []
    whose: list[int] = []
    size = 0

    def flush() -> None:
        part, h = _hash_chunk(parts)
        owners.append(np.asarray(whose, dtype=np.int64)[part])
        hashes.append(h)

    for i, text in enumerate(texts):
        for part in _parts(text.encode("utf-8", "surrogatepass")):
            parts.append(part)
            whose.append(i)
            size += len(part)
            if size >= CHUNK_BYTES:
                flush()
                parts, whose, size = [], [], 0
    if parts:
        flush()
    return np.concatenate(owners), np.concatenate(hashes)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``words`` words.

    A text with fewer words has its whole sequence as one shingle, a text
    without words none.
    """
    owners, hashes = word_hashes(texts)
    counts = np.bincount(owners, minlength=len(texts))
    ends = np.cumsum(counts)
    factors = _powers(words + 1)[1:]
    seeds = np.arange(words + 1, dtype=np.uint64) * _STEP
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        h = hashes[end - n:end]
        if n == 0:
            out.append(h)
            continue
        k = min(n, words)
        total = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            total += h[j:n - k + 1 + j] * factors[j]
        out.append(np.unique(mix(total + seeds[k])))
    return out
