"""Exact removal of word passages that occur more than once, found through difference-cover anchors.

A difference cover D modulo v has, for any two positions i and j, an offset d < v with (i + d) mod v and (j + d) mod v both in D.
So two equal passages of ``window`` words hold an equal run of ``window - v + 1`` words that starts at a cover position in *both*
documents. Only runs at cover positions are hashed and matched between documents; each repeated one extends to the windows that hold
it, and these windows are matched by 96 bits made from one 64-bit hash per word, so words are told apart by 64 bits.

Matching runs over bounded pieces of hash space. A hash that repeats inside one batch is settled there and reaches its piece as one
marker, so a passage in a third of all documents never gathers in one task. Texts are shuffled once, by row key; both joins use that
exchange.

Defined cases: null and blank texts have no words; rows that repeat (same id and text, or same text) are copies of one another, so all
their windows repeat, and the places found in rows of equal id and text are kept once for all of them; null ids are kept; columns beside ``doc_id`` and ``text`` are ignored; texts may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgauge.llm.tables import by_key, pieces, row_key
from tollgauge.llm.words import SECOND_BASE, WINDOW_BASE, slices, text_buffer, window_hashes, word_hashes, word_spans

PIECE_BYTES = 4 << 20
LISTS = {"h": pa.int64(), "g": pa.int32(), "m": pa.int64(), "mg": pa.int32(), "k": pa.int64(), "n": pa.int32(), "p": pa.int32()}
ENTRIES = pa.schema([("piece", pa.int64()), *[(c, pa.list_(t)) for c, t in LISTS.items()]])
ENTRIES_DDL = "piece long, " + ", ".join(f"{c} array<{'long' if t == pa.int64() else 'int'}>" for c, t in LISTS.items())
PLACES = pa.schema([("k", pa.int64()), ("places", pa.list_(pa.int32()))])
PLACES_DDL = "k long, places array<int>"


@lru_cache
def difference_cover(v: int) -> tuple[int, ...]:
    """A smallest difference cover modulo ``v`` (by search, so for the small periods used here)."""
    for size in range(1, v + 1):
        for rest in combinations(range(1, v), size - 1):
            cover = (0, *rest)
            if len({(a - b) % v for a in cover for b in cover}) == v:
                return cover
    raise ValueError("v must be positive")


def _runs(k: np.ndarray) -> np.ndarray:
    """First index of each run of equal values."""
    return np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)


def _row(piece: int, **lists: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array([piece], pa.int64())]
    for c, t in LISTS.items():
        v = lists.get(c, np.zeros(0, np.int64))
        cols.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t)))
    return pa.RecordBatch.from_arrays(cols, schema=ENTRIES)


def _packed(k: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """(row key, position) pairs in order, as runs of keys and differences of positions."""
    first = _runs(k)
    return {"k": k[first], "n": np.diff(np.append(first, len(k))), "p": np.diff(p, prepend=0)}


def _distinct(k: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row key, position) pairs in order; repeated rows, which share a key, bring the same pairs again."""
    order = np.lexsort((p, k))
    k, p = k[order], p[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]))) if len(k) else np.zeros(0, bool)
    return k[new], p[new]


def _settle(h: np.ndarray, g: np.ndarray, k: np.ndarray, p: np.ndarray, parts: int, spread: int) -> Iterator[pa.RecordBatch]:
    """Deal one batch's hashes to their pieces; those found twice here go on as settled places and one marker each."""
    if not len(h):
        return
    order = np.lexsort((g, h))
    hs, gs = h[order], g[order]
    first = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1]))))
    size = np.diff(np.append(first, len(h)))
    again = np.zeros(len(h), bool)
    again[order] = np.repeat(size > 1, size)
    if again.any():
        yield _row(parts + spread % parts, **_packed(*_distinct(k[again], p[again])))
    marks = first[size > 1]
    mh, mg = hs[marks], gs[marks]
    h, g, k, p = h[~again], g[~again], k[~again], p[~again]
    to, mto = (h % np.uint64(parts)).astype(np.int64), (mh % np.uint64(parts)).astype(np.int64)
    o, mo = np.argsort(to, kind="stable"), np.argsort(mto, kind="stable")
    cut, mcut = np.searchsorted(to[o], np.arange(parts + 1)), np.searchsorted(mto[mo], np.arange(parts + 1))
    for x in np.flatnonzero((np.diff(cut) > 0) | (np.diff(mcut) > 0)):
        a, m = o[cut[x] : cut[x + 1]], mo[mcut[x] : mcut[x + 1]]
        yield _row(int(x), h=h[a].view(np.int64), g=g[a].view(np.int32), m=mh[m].view(np.int64), mg=mg[m].view(np.int32), **_packed(k[a], p[a]))


def _unpacked(t: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Flat lists of a piece's rows, and its (row key, position) pairs."""
    flat = {c: t.column(c).combine_chunks().flatten().to_numpy() for c in LISTS}
    rows = np.diff(t.column("p").combine_chunks().offsets.to_numpy())
    start = np.cumsum(rows) - rows
    total = np.cumsum(flat["p"], dtype=np.int64)
    base = np.where(start > 0, total[np.maximum(start, 1) - 1], 0) if len(total) else start
    return flat, np.repeat(flat["k"], flat["n"]), total - np.repeat(base, rows)


def _matched(parts: int, homes: int):
    """Per piece: the places whose hash occurs twice in the piece or carries a marker, dealt by row key to ``homes`` groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "piece"):
            flat, k, p = _unpacked(t)
            if t.column("piece")[0].as_py() < parts:
                h, g = np.concatenate([flat["h"], flat["m"]]), np.concatenate([flat["g"], flat["mg"]])
                order = np.lexsort((g, h))
                hs, gs = h[order], g[order]
                first = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])))) if len(h) else np.zeros(0, np.int64)
                size = np.diff(np.append(first, len(h)))
                keep = np.zeros(len(h), bool)
                keep[order] = np.repeat(size > 1, size)
                marked = np.zeros(len(h), bool)
                if len(flat["m"]) and len(first):
                    marked[order] = np.repeat(np.maximum.reduceat(order >= len(flat["h"]), first), size)
                keep = (keep | marked)[: len(flat["h"])]
                k, p = k[keep], p[keep]
            k, p = _distinct(k, p)
            home = (k.view(np.uint64) % np.uint64(homes)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            cut = np.searchsorted(home[order], np.arange(homes + 1))
            for x in np.flatnonzero(np.diff(cut)):
                own = order[cut[x] : cut[x + 1]]
                yield _row(int(x), **_packed(k[own], p[own]))

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All places of a row key as one list."""
    for t in by_key(batches, "piece"):
        _, k, p = _unpacked(t)
        k, p = _distinct(k, p)
        first = _runs(k)
        yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(k)), pa.int32()), pa.array(p, pa.int32()))], schema=PLACES)


def _anchors(window: int, period: int, parts: int):
    cover, length = np.array(difference_cover(period)), window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            key = batch.column(0).to_numpy()
            offsets, data = text_buffer(batch.column(1))
            found: list[tuple] = []
            for a, b in slices(offsets):
                starts, ends, first = word_spans(offsets[a : b + 1], data)
                n = np.diff(first)
                row = np.repeat(np.arange(b - a), n)
                place = np.arange(len(starts)) - first[row]
                # an anchor counts where a window of this document can hold it
                at = np.flatnonzero(np.isin(place % period, cover) & (n[row] >= window) & (place + length <= n[row]))
                found.append((window_hashes(word_hashes(data, starts, ends), length, at), key[a:b][row[at]], place[at]))
            if found:
                h, k, p = (np.concatenate(x) for x in zip(*found))
                yield from _settle(h, np.zeros(len(h), np.uint32), k, p, parts, task + i)

    return run


def _windows(window: int, period: int, parts: int):
    reach = period - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            key, places = batch.column(0).to_numpy(), batch.column(2)
            offsets, data = text_buffer(batch.column(1))
            found: list[tuple] = []
            for a, b in slices(offsets):
                starts, ends, first = word_spans(offsets[a : b + 1], data)
                if not len(starts):
                    continue
                near = places.slice(a, b - a)
                at = near.flatten().to_numpy().astype(np.int64) + np.repeat(first[:-1], np.diff(near.offsets.to_numpy()))
                n = np.diff(first)
                row = np.repeat(np.arange(b - a), n)
                place = np.arange(len(starts)) - first[row]
                edge = np.zeros(len(starts) + 1, np.int32)
                np.add.at(edge, np.maximum(at - reach, first[row[at]]), 1)
                np.add.at(edge, at + 1, -1)
                w = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (place + window <= n[row]))
                h = word_hashes(data, starts, ends)
                second = (window_hashes(h, window, w, SECOND_BASE) >> np.uint64(32)).astype(np.uint32)
                found.append((window_hashes(h, window, w, WINDOW_BASE), second, key[a:b][row[w]], place[w]))
            if found:
                yield from _settle(*(np.concatenate(x) for x in zip(*found)), parts, task + i)

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, places = batch.column(names.index("text")), batch.column(names.index("places"))
            sizes, gone, kept = [], [], []
            for text, hits in zip(texts, places):
                words = (text.as_py() or "").encode().split()
                removed = 0
                if hits.is_valid and len(hits.values):
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = hits.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    removed = len(words) - len(stay)
                    kept.append(b" ".join([words[x] for x in stay]))
                else:
                    kept.append(b" ".join(words))
                sizes.append(len(words) if text.is_valid else 0)
                gone.append(removed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("doc_id")), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def _grouped(entries: DataFrame, parts: int) -> DataFrame:
    """Places per row key, from entries dealt by piece."""
    homes = max(entries.sparkSession.sparkContext.defaultParallelism, parts // 8)
    found = entries.repartition("piece").sortWithinPartitions("piece").mapInArrow(_matched(parts, homes), ENTRIES_DDL)
    return found.repartition("piece").sortWithinPartitions("piece").mapInArrow(_gathered, PLACES_DDL)


def remove_repeats(docs: DataFrame, window: int = 35, period: int = 21) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per row of ``docs``: words covered by a window whose words also start elsewhere are gone.

    ``kept_text`` joins the kept words with single spaces. ``period`` must not exceed ``window``.
    """
    if not 1 <= period <= window:
        raise ValueError("period must be between 1 and window")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(row_key("doc_id", "text").alias("k"), "doc_id", "text")
    parts = pieces(docs.select("text"), PIECE_BYTES, docs.sparkSession.sparkContext.defaultParallelism)
    anchors = keyed.select("k", "text").mapInArrow(_anchors(window, period, parts), ENTRIES_DDL)
    dealt = keyed.repartition("k")
    near = _grouped(anchors, parts)
    # all columns, so that both joins share one exchange
    windows = dealt.join(near, "k").select("k", "text", "places", "doc_id").mapInArrow(_windows(window, period, parts), ENTRIES_DDL)
    hits = _grouped(windows, parts)
    out = f"doc_id {kind}, n_words long, n_removed long, kept_text string"
    return dealt.join(hits, "k", "left").select("k", "doc_id", "text", "places").mapInArrow(_kept(window), out)


def op9_substring_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest of :func:`remove_repeats` with windows of 35 words."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
