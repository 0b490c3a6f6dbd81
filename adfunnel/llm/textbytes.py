"""Vectorised work on the bytes of many texts at once (runs inside Arrow batches)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

RUN_BYTES = 2_000_000
# odd multiplier of the polynomial word hash and its inverse modulo 2^64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (finalizer with full avalanche)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_runs(column: pa.Array, limit: int = RUN_BYTES):
    """``(first, last, buf, starts)`` for runs of rows of about ``limit`` bytes.

    ``buf`` holds the UTF-8 bytes of rows ``first`` to ``last - 1``, each followed by a
    line feed; row ``first + i`` is ``buf[starts[i]:starts[i + 1] - 1]``. NULL is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        last = min(last, n)
        starts = off[first:last + 1] - off[first] + np.arange(last - first + 1)
        buf = np.full(int(starts[-1]), 10, np.uint8)
        for i in range(last - first):
            buf[starts[i]:starts[i + 1] - 1] = raw[off[first + i]:off[first + i + 1]]
        yield first, last, buf, starts
        first = last


def token_spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True (the array ends with False)."""
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def span_hashes(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings ``buf[a:b]`` (equal strings, equal hashes)."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_byte_codes()[buf] * _powers(_BASE, len(buf)), out=total[1:]) if len(buf) else None
        h = (total[b] - total[a]) * _powers(_INVERSE, len(buf) + 1)[a]
        return mix64(h ^ ((b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = _IS_LETTER[128:] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII capitals as small letters."""
    return _LOWER[buf]


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans between ASCII white space."""
    return token_spans(_IS_WORD[buf])


def letter_runs(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of ASCII letters and bytes beyond ASCII."""
    return token_spans(_IS_LETTER[buf])


def letter_bytes(buf: np.ndarray) -> np.ndarray:
    """The bytes inside ``letter_runs``, one after another."""
    return buf[_IS_LETTER[buf]]


def per_row(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index bounds in the sorted positions ``at`` of every row (length rows + 1)."""
    return np.searchsorted(at, starts)
