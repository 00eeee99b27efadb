"""Digests of tokens and n-grams as arrays, and whole numbers packed for a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

#: Characters of text whose n-grams are counted at once.
CHUNK_CHARS = 2_000_000


KEYS = ("0123456789123456", "one other number")


def hashed(tokens: list[str], key: int = 0) -> np.ndarray:
    """64-bit digests of tokens, the same in every process; those of another ``key`` have nothing to do with them."""
    if not tokens:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.asarray(tokens, dtype=object), hash_key=KEYS[key], categorize=False)


def mixed(code: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The digests of n-grams that are one token longer."""
    x = code * np.uint64(0x9E3779B97F4A7C15) + token
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = starts(keys)
    return keys[first], *(np.add.reduceat(c[order], first) if len(keys) else c for c in counts)


def cuts(grams: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the equal parts of all digests begins in sorted ``grams``."""
    part = (grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte, the lowest bytes of all first, so that high bytes that are zero compress well."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def unpacked(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def chunks(texts: Iterable[str]) -> Iterator[slice]:
    """Stretches of texts with about ``CHUNK_CHARS`` characters."""
    start, at, chars = 0, 0, 0
    for at, text in enumerate(texts, 1):
        chars += len(text)
        if chars >= CHUNK_CHARS:
            yield slice(start, at)
            start, chars = at, 0
    if at > start:
        yield slice(start, at)
