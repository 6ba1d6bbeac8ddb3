"""Whole texts as flat byte arrays: words and rolling fingerprints without a Python loop per character."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(n, np.uint64(base & _MASK))
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[name] = have
    return have[:n]


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts on end, offsets with one more entry than texts); a null counts as empty."""
    # cast first: only then do the offsets hold more than 2 GB
    parts = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    parts = [p.cast(pa.large_binary()) for p in parts]
    texts = parts[0] if len(parts) == 1 else pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Prefix:
    """Fingerprints of any substring of a byte array from one pass of prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum(_TABLE[data] * _power("up", _BASE, n), out=self.sums[1:])
        self.down = _power("down", _INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text and one more) of the runs without ASCII white space; none crosses a text."""
    n = len(data)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] = inside[inner]
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of every n consecutive values; as many as there are starts."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    factor = 1
    for j in range(n):
        factor = factor * _BASE & _MASK
        out += (hashes[j : j + m] ^ np.uint64(factor)) * np.uint64(factor | 1)
    return mix(out)


def starts_inside(first: np.ndarray, n: int) -> np.ndarray:
    """Positions of windows of n items that stay inside one text; `first` from words()."""
    total = int(first[-1]) if len(first) else 0
    if total < n:
        return np.zeros(0, np.int64)
    good = np.ones(total - n + 1, np.int8)
    for_each = first[1:]
    # a window that starts in the last n - 1 items of a text leaves it
    step = np.zeros(total + 1, np.int64)
    lo = np.maximum(for_each - (n - 1), first[:-1])
    np.add.at(step, lo, 1)
    np.add.at(step, for_each, -1)
    good[np.cumsum(step)[: total - n + 1] > 0] = 0
    return np.flatnonzero(good)


def covered(flags: np.ndarray, n: int) -> np.ndarray:
    """Items inside a window of n that starts at a flagged item."""
    step = np.zeros(len(flags) + n + 1, np.int32)
    at = np.flatnonzero(flags)
    step[at] += 1
    step[at + n] -= 1
    return np.cumsum(step[: len(flags)]) > 0
