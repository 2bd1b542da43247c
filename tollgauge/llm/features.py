"""Hashed features of whole texts as dense numpy rows, a slice of rows at a time, and their bounded training samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgauge.llm.words import mix, slices, text_buffer, window_hashes, word_hashes, word_spans

U = np.uint64
SLICE = 1 << 19
#: Dense rows held at once: short texts fill no slice of bytes.
SLICE_ROWS = 256
Featurizer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def rows_of(column: pa.Array, features: Featurizer) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, matrix) over a text column, of at most ``SLICE_ROWS`` rows and ``SLICE`` bytes or one row."""
    offsets, data = text_buffer(column)
    for low, high in slices(offsets, SLICE):
        for i in range(low, high, SLICE_ROWS):
            j = min(high, i + SLICE_ROWS)
            yield i, j, features(offsets[i : j + 1], data)


def gram_counts(byte: np.ndarray, row: np.ndarray, rows: int, n: int, size: int) -> np.ndarray:
    """Counts of hashed ``n``-grams of a byte sequence per row; grams that cross rows are left out."""
    m = len(byte) - n + 1
    if m <= 0:
        return np.zeros((rows, size), np.float32)
    out = np.zeros(rows * size, np.float32)
    for low in range(0, m, 1 << 20):  # a very long text goes in parts
        end = min(m, low + (1 << 20))
        code = np.zeros(end - low, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) + byte[low + k : end + k]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (size.bit_length() - 1))
        a, b = row[low:end], row[low + n - 1 : end + n - 1]
        at = a.astype(np.int64) * size + code
        out += np.bincount(at[a == b], minlength=rows * size).astype(np.float32)
    return out.reshape(rows, size)


def unit(x: np.ndarray) -> np.ndarray:
    """Square roots of shares: every row has length 1, or 0 if it has no counts."""
    return np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))


# --- language: letters only, lower case, everything else one space
LETTER = np.full(256, 32, np.uint8)
LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTER[128:] = np.arange(128, 256)
LANG_SIZE = 4096


def language_features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Shares of hashed 2-, 3- and 4-grams of letters."""
    n = len(offsets) - 1
    byte = LETTER[data[offsets[0] : offsets[-1]]]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    if len(byte):
        keep = np.concatenate(([True], (byte[1:] != 32) | (byte[:-1] != 32) | (row[1:] != row[:-1])))
        byte, row = byte[keep], row[keep]
    return np.hstack([unit(gram_counts(byte, row, n, k, LANG_SIZE)) for k in (2, 3, 4)])


# --- quality: shapes of characters, words, and shares that describe how a text is built
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[128:] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
KINDS = np.full(256, 5, np.uint8)
KINDS[ord("a") : ord("z") + 1] = 0
KINDS[128:] = 0
KINDS[ord("A") : ord("Z") + 1] = 1
KINDS[ord("0") : ord("9") + 1] = 2
KINDS[[9, 11, 12, 13, 32]] = 3
KINDS[10] = 4
KINDS[[ord(c) for c in ".,;:'\"-()?"]] = 6
SHAPE_SIZE, WORD_SIZE = 2048, 2048
STEPS = np.array([0.02, 0.1, 0.25, 0.5], np.float32)


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Distinct hashes per row."""
    if not len(h):
        return np.zeros(rows)
    key = np.sort(mix(h ^ (row.astype(U) * U(0x9E3779B97F4A7C15))) & U((1 << 40) - 1) | (row.astype(U) << U(40)))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    return np.bincount((key[new] >> U(40)).astype(np.int64), minlength=rows)


def quality_features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Shape 3-grams, word shares, and shares of character kinds, repeats and word lengths with hinges."""
    n = len(offsets) - 1
    byte = data[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    shapes = unit(gram_counts(SHAPE[byte], row, n, 3, SHAPE_SIZE))
    starts, ends, first = word_spans(offsets, data)
    h, count = word_hashes(data, starts, ends), np.diff(first)
    owner = np.repeat(np.arange(n), count)
    words = unit(np.bincount(owner * WORD_SIZE + (h % U(WORD_SIZE)).astype(np.int64), minlength=n * WORD_SIZE).reshape(n, WORD_SIZE).astype(np.float32))
    kinds = np.bincount(row.astype(np.int64) * 7 + KINDS[byte], minlength=n * 7).reshape(n, 7) / np.maximum(np.diff(offsets), 1)[:, None]
    some = np.maximum(count, 1)
    whole = np.flatnonzero(np.arange(len(h)) + 3 <= first[1:][owner]) if len(h) else np.zeros(0, np.int64)
    triples = np.bincount(owner[whole], minlength=n)
    length = ends - starts
    beside = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) if len(h) else np.zeros(0, np.int64)
    shares = np.column_stack([
        kinds,
        1 - _distinct(owner, h, n) / some,
        1 - _distinct(owner[whole], window_hashes(h, 3, whole), n) / np.maximum(triples, 1),
        np.bincount(owner[beside], minlength=n) / some,
        np.bincount(owner, length == 1, n) / some,
        np.bincount(owner, length > 20, n) / some,
        np.minimum(np.bincount(owner, length, n) / some / 20, 1),
        np.minimum(np.log1p(count) / 12, 1),
    ]).astype(np.float32)
    hinges = np.maximum(shares[:, :, None] - STEPS, 0).reshape(n, -1)
    return np.hstack([shapes, words, shares, hinges]).astype(np.float32)


# --- bounded training samples
def hash_share(name: str, share: Column | float) -> Column:
    """True for about ``share`` of the rows, by a hash of the text, so reruns take the same rows."""
    return F.pmod(F.xxhash64(F.lit(name), "text"), F.lit(1_000_003)) < F.lit(1_000_003) * share


def sampled(rows: DataFrame, name: str, share: Column | float) -> DataFrame:
    """``hash_share`` of ``rows`` (text, tag), where copies, which share a hash, count once: no group of copies can fill the sample."""
    return rows.where(hash_share(name, share)).select("text", "tag").distinct()


def sparse_rows(frame: DataFrame, features: Featurizer) -> DataFrame:
    """(tag, at array<int>, value array<float>) per row of ``frame`` (text, tag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in rows_of(batch.column(0), features):
                r, c = np.nonzero(x)
                cut = pa.array(np.searchsorted(r, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(cut, pa.array(c, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(x[r, c], pa.float32()))],
                    names=["tag", "at", "value"],
                )

    return frame.select("text", "tag").mapInArrow(run, f"tag {frame.schema['tag'].dataType.simpleString()}, at array<int>, value array<float>")


class Sample:
    """A collected sample in a fixed order, read as dense mini-batches."""

    def __init__(self, rows: DataFrame, width: int):
        t = rows.toArrow()
        at, value = t.column("at").combine_chunks(), t.column("value").combine_chunks()
        at, value = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (at, value))
        self.width, self.tag = width, t.column("tag").to_numpy()
        cut = at.offsets.to_numpy() if len(self.tag) else np.zeros(1, np.int64)
        self.rows = [(at.values.to_numpy()[a:b], value.values.to_numpy()[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        order = sorted(range(len(self.rows)), key=lambda i: (str(self.tag[i]), self.rows[i][0].tobytes(), self.rows[i][1].tobytes()))
        shuffled = np.random.default_rng(7).permutation(len(order))
        order = [order[i] for i in shuffled]
        self.tag, self.rows = self.tag[order], [self.rows[i] for i in order]

    def dense(self, which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), self.width), np.float32)
        for r, i in enumerate(which):
            at, value = self.rows[i]
            x[r, at] = value
        return x


class Adam:
    def __init__(self, shape: tuple[int, ...], rate: float = 0.05):
        self.w, self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        self.w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
