"""Words of whole Arrow text columns as numpy arrays: spans, 64-bit word hashes and rolling window hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D, so it is ``[^\\x20\\x09-\\x0D]+`` on code points too (UTF-8
never uses these bytes inside a character). Work goes over slices of a few megabytes, so a very long text costs its words,
not several copies of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 1 << 20
WORD_BASE, WINDOW_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
U = np.uint64


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of words and, per row, the index of its first word (one more entry at the end)."""
    low, high = int(offsets[0]), int(offsets[-1])
    space = SPACE[data[low:high]]
    if not len(space):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = offsets[:-1][offsets[1:] > offsets[:-1]] - low
    before = np.empty(len(space), bool)
    before[0], before[1:] = True, space[:-1]
    before[edge] = True
    starts = np.flatnonzero(~space & before)
    before[:-1], before[-1] = space[1:], True
    before[edge[1:] - 1] = True
    ends = np.flatnonzero(~space & before) + 1
    return starts + low, ends + low, np.searchsorted(starts, offsets - low)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.full(n, base, U)
    back = np.full(n, pow(base, -1, 1 << 64), U)
    step[0] = back[0] = 1
    return np.cumprod(step, dtype=U), np.cumprod(back, dtype=U)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least ``n`` of each."""
    return _powers(base, max(2 * BLOCK, 1 << (n - 1).bit_length()) if n > 1 else 2 * BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = WORD_BASE) -> np.ndarray:
    """64-bit hash of each span: a polynomial over its bytes and its length, mixed."""
    out, i, n = np.empty(len(starts), U), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = powers(base, high - low)
        total = np.zeros(high - low + 1, U)
        np.cumsum((data[low:high].astype(U) + U(1)) * up[: high - low], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(U) * U(SECOND_BASE)
        i = j
    return mix(out)


def window_hashes(h: np.ndarray, k: int, at: np.ndarray | None = None, base: int = WINDOW_BASE) -> np.ndarray:
    """Hash of the ``k`` consecutive words from each position (or from the positions ``at``); the caller keeps windows inside rows."""
    n = len(h)
    if at is None:
        at = np.arange(max(0, n - k + 1))
    if not len(at):
        return np.zeros(0, U)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(h * up[:n], out=total[1:])
    return mix((total[at + k] - total[at]) * down[at])


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words per row."""
    offsets, data = text_buffer(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in slices(offsets):
        out[i:j] = np.diff(word_spans(offsets[i : j + 1], data)[2])
    return out
