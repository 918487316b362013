"""Vectorised word and shingle hashing over UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+``; only A-Z are folded. Work is per text, so memory follows
the longest text and not the Arrow batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64


def release() -> None:
    """Give freed memory back to the system: workers live on from task to task and share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15))


_BYTE = stream(1, 256)
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = stream(2, 64) | _U(1)
_powers = np.cumprod(np.full(256, _BASE, _U))


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, _BASE, _U))
    return _powers


def as_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray | None]:
    """Each string's UTF-8 bytes without a copy; None for null."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(part):
            continue
        kind = np.int64 if pa.types.is_large_string(part.type) or pa.types.is_large_binary(part.type) else np.int32
        _, offsets, data = part.buffers()
        at = np.frombuffer(offsets, kind, len(part) + 1, part.offset * np.dtype(kind).itemsize)
        body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        there = part.is_valid().to_numpy(zero_copy_only=False) if part.null_count else None
        for i in range(len(part)):
            yield None if there is not None and not there[i] else body[at[i] : at[i + 1]]


def lowered(body: np.ndarray) -> np.ndarray:
    return _LOWER[body]


def word_spans(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.empty(len(body) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[body], out=inside[1:-1].view(bool))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[0::2], turns[1::2]


def hash_spans(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-overlapping, non-empty span."""
    if not len(starts):
        return np.zeros(0, _U)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = _BYTE[body[place + np.repeat(starts, lengths)]] * _power(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(_U) * _STEP[0])


def word_hashes(body: np.ndarray) -> np.ndarray:
    return hash_spans(body, *word_spans(body))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-word window, in order; of all words together where there are fewer."""
    n = len(words)
    k = min(k, n)
    if not n:
        return np.zeros(0, _U)
    if k <= len(_STEP):
        total = np.zeros(n - k + 1, _U)
        for j in range(k):
            total += words[j : n - k + 1 + j] * _STEP[j]
    else:
        total = np.array([(words * _power(n)[:n]).sum(dtype=_U)]) if n == k else None
        if total is None:
            raise ValueError(f"windows of at most {len(_STEP)} words")
    return mix(total + _U(k))


def shingle_set(body: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles of the lower-cased text, as 64-bit hashes."""
    return np.unique(windows(word_hashes(lowered(body)), k))
