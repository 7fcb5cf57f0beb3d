"""Prefix polynomial hashes of byte arrays, modulo 2^64, and batches of texts as one array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)``; the longest array asked for is kept."""
    own = _POWERS.get(base)
    if own is None or len(own) < n:
        own = np.full(max(n, 1 << 16), base, np.uint64)
        own[0] = 1
        np.cumprod(own, out=own)
        _POWERS[base] = own
    return own[:n]


def prefixes(data: np.ndarray) -> np.ndarray:
    """P with P[i] the hash of the first i bytes: the sum of (byte + 1) * BASE ** place."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def between(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``start`` to ``end``, wherever they stand."""
    return (p[end] - p[start]) * powers(_INVERSE, len(p))[start]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``most`` bytes together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) if len(column) else []
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def joined(column: pa.Array, gap: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one array with ``gap`` behind each, and where each starts and ends. Null: empty."""
    texts = [(x.as_py() or "").encode() for x in column]
    size = np.array([len(x) for x in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(size + len(gap))[:-1]]) if len(size) else size
    data = gap.join([*texts, b""]) if gap else b"".join(texts)
    return np.frombuffer(data, np.uint8), start, start + size
