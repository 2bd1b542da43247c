"""Blocks and cells of the neighbour search: results of window after window, with few windows counted and each block made once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tollgauge.llm import neighbours


def made(kind: str) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 24))
    if kind == "clusters":
        x = x * 0.2 + rng.standard_normal((9, 24))[rng.integers(0, 9, 700)]
    if kind == "copies":
        x[:400] = x[0]
    if kind == "grid":
        x = rng.integers(1, 5, (700, 2)).astype(float)
    if kind == "few":
        x = x[:7]
    if kind == "large":
        x = x * 1e-3 + 1e6
    ids = rng.permutation(len(x)).astype(np.int64)
    ids[-1] = ids[0]
    return ids, x


def window_after_window(block, own, q, k, share, widen):
    """Every window is counted from the narrowest one on, until the ``k`` best lie within its radius."""
    m, n = block.sorted.shape
    h, at = block.x @ block.lines, q @ block.lines
    pos = np.array([np.searchsorted(block.sorted[i], at[i]) for i in range(m)])
    part = max(0.02, 2 * k / n)
    while True:
        width = max(1, int(part * n / 2))
        left, right = block.sorted[np.arange(m), np.maximum(pos - width, 0)], block.sorted[np.arange(m), np.minimum(pos + width, n - 1)]
        radius = np.median(np.maximum(at - left, right - at)) if part < 1 else np.inf
        rows = np.flatnonzero((((h >= at - radius) & (h <= at + radius)).sum(1) >= share * m) & (block.ids != own))
        d = np.sqrt(((block.x[rows] - q) ** 2).sum(1))
        if part >= 1 or len(d) >= k and np.sort(d)[k - 1] <= radius:
            best = np.lexsort((block.ids[rows], d))[:k]
            return block.ids[rows[best]].tolist(), d[best].tolist()
        part = min(1.0, part * widen)


@pytest.mark.parametrize("kind", ["plain", "clusters", "copies", "grid", "few", "large"])
def test_windows_skipped_change_no_result(kind, monkeypatch):
    ids, x = made(kind)
    block, counted = neighbours.Block(ids, x, 32), []
    count = neighbours.Block.collisions
    monkeypatch.setattr(neighbours.Block, "collisions", lambda *a: counted.append(1) or count(*a))
    asked = np.arange(0, len(x), 9)
    want = [window_after_window(block, ids[i], x[i], 10, 0.58, 1.25) for i in asked]
    _, usual = block.nearest(ids[asked], x[asked], 10, 0.58, 1.25)
    for first in (0, usual, 99):
        counted.clear()
        got, done = block.nearest(ids[asked], x[asked], 10, 0.58, 1.25, first)
        assert [(i.tolist(), d.tolist()) for i, d in got] == want and done == usual
        if first == usual:
            assert len(counted) <= 4 * len(asked)


def test_a_cell_makes_its_block_once_and_streams_queries(monkeypatch):
    ids, x = made("plain")
    blocks, build = [], neighbours.Block.__init__
    monkeypatch.setattr(neighbours.Block, "__init__", lambda self, i, v, p: blocks.append(len(i)) or build(self, i, v, p))
    asked = np.arange(0, 700, 2)
    rows = [(1, False, i) for i in range(700)] + [(1, True, i) for i in asked] + [(2, True, 0), (3, False, 5), (4, False, 6), (4, False, 7), (4, True, 7)]
    t = pa.table({"cell": [c for c, *_ in rows], "asks": [a for _, a, _ in rows], "vec_id": [int(ids[i]) for *_, i in rows], "embedding": [x[i].tolist() for *_, i in rows]})
    got: dict = {}
    for b in neighbours.answers(iter(t.to_batches(max_chunksize=90)), 10, 32, 0.58, 1.25):
        for q, v, s in zip(*(b.column(c).to_pylist() for c in ("query_id", "vec_id", "score"))):
            got.setdefault(q, []).append((v, s))
    assert blocks == [700, 2]
    own = neighbours.Block(ids, x, 32)
    for i in asked:
        assert got.pop(int(ids[i]))[:10] == list(zip(*window_after_window(own, ids[i], x[i], 10, 0.58, 1.25)))
    assert got == {int(ids[7]): [(int(ids[6]), float(np.sqrt(((x[6] - x[7]) ** 2).sum())))]}


def test_vectors_travel_once_to_a_block(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(neighbours, "answers", lambda batches, *a: (pa.RecordBatch.from_pydict({"query_id": b.column("vec_id"), "vec_id": b.column("vec_id"), "score": pa.array([0.0 if a else 1.0 for a in b.column("asks").to_pylist()])}) for b in batches))
    frame = spark.range(2400).selectExpr("id AS vec_id", "array(cast(id AS double) + 1, 1.0D) AS embedding")
    for r in neighbours.search(frame, frame.vec_id % 2 == 0, k=99, block_rows=800).collect():
        sent.append((r.vec_id, r.score))
    assert sum(s == 1.0 for _, s in sent) == 2400 and sum(s == 0.0 for _, s in sent) == 3 * 1200
