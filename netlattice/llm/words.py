"""Word splitting and 64-bit word hashing on UTF-8 bytes, for Arrow batches."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

#: Multipliers of the rolling combinations; odd, so no bits are lost.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)
#: Words remembered by one Python worker before its cache starts afresh.
CACHE_WORDS = 600_000
_CACHES: list[dict] = []
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Text that is hashed at once, up to the next white space.
HASH_BYTES = 1 << 17


def kept_cache(cache: dict) -> dict:
    """Registers a cache that lives as long as its Python worker."""
    _CACHES.append(cache)
    return cache


def only_caches(*mine: dict) -> None:
    """Empties the caches that other operators left in this worker, which Spark reuses from stage to stage."""
    for cache in _CACHES:
        if not any(cache is m for m in mine):
            cache.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library keeps what was freed
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that few texts at a time become Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


class WordHashes(dict):
    """word bytes -> xxh64, filled on demand and emptied when it has grown to ``most``."""

    most = CACHE_WORDS

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


HASHES = kept_cache(WordHashes())


def ascii_words(text: bytes | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split`` cuts at exactly these six bytes."""
    return text.split() if text else []


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each ``k`` consecutive word hashes (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = scramble(out * MIX_A + words[i : i + n] + MIX_B)
    return scramble(out)


def sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    """Index of the smallest of each ``window`` consecutive values, the rightmost among equals."""
    n = len(values) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    best = np.arange(len(values), dtype=np.int64)
    span = 1
    while span < window:  # doubling: best[i] covers span values from i
        step = min(span, window - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] <= values[left], right, left)
        span += step
    return best[:n]


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``MIX_A`` and of its inverse, modulo 2 ** 64."""
    both = (np.full(n, x, dtype=np.uint64) for x in (int(MIX_A), pow(int(MIX_A), -1, 1 << 64)))
    return tuple(np.multiply.accumulate(np.where(np.arange(n) == 0, np.uint64(1), x)) for x in both)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of ``ascii_words`` begin and end in the text, and a 64-bit hash of each.

    The hashes are differences of a running polynomial over the bytes, so that
    no word becomes a Python object.  Equal words have equal hashes; hashes that
    are equal do not prove equal words.
    """
    parts, lo = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))], 0
    while lo < len(text):
        end = SPACE.search(text, lo + HASH_BYTES)
        hi = end.start() if end else len(text)
        raw = np.frombuffer(text, np.uint8, hi - lo, lo)
        space = (raw == 32) | (raw - np.uint8(9) < 5)
        edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        ahead, back = powers(max(2 * HASH_BYTES, 1 << (hi - lo).bit_length()))
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(raw * ahead[: hi - lo], out=sums[1:])
        found = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * MIX_B
        parts.append((starts + lo, ends + lo, scramble(found)))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
