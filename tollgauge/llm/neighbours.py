"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Vectors are dealt into blocks. In a block, each of ``projections`` random lines has one sorted array of projected values. A query opens
a window around its own value in every array; a vector collides where it lies in the window. Vectors that collide in at least
``share`` of the arrays are verified by their exact distance. Windows widen step by step (virtual rehashing: the arrays stay, the radius
grows) until the ``k`` best verified vectors lie within the radius. Nothing caps the candidates: at the widest window all are verified.

Queries meet blocks in cells of one block of each. A task makes a cell's arrays once and then takes its queries batch by batch. Each
cell returns a query's ``k`` nearest, ties included by smaller id, and the nearest over all cells follow.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite parts, and rows without an id, take no part; vectors of
different length never meet; repeated rows are candidates of their own, but a query's id is asked once, with its smallest vector; equal
distances go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Block:
    """Sorted projections of one block, and the place of every vector in each of them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, projections: int):
        n = len(ids)
        self.ids, self.x = ids, x
        self.squares = (x * x).sum(1)
        lines = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], projections))
        self.lines = lines
        h = (x @ lines).T
        order = np.argsort(h, axis=1, kind="stable")
        self.sorted = np.take_along_axis(h, order, 1)
        self.place = np.empty(order.shape, np.uint16 if n < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(n, dtype=self.place.dtype), order.shape), 1)
        self.shifted, self.inside = np.empty_like(self.place), np.empty(order.shape, bool)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many arrays each vector lies at a place from ``low`` to below ``high``."""
        kind = self.place.dtype
        np.subtract(self.place, low.astype(kind)[:, None], out=self.shifted)  # places below ``low`` wrap around to the top
        np.less(self.shifted, (high - low).astype(kind)[:, None], out=self.inside)
        return np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.min_scalar_type(len(self.sorted)))

    def radii(self, at: np.ndarray, k: int, widen: float) -> np.ndarray:
        """Radius of every window, narrowest first, for queries projected to ``at``; the last one is endless."""
        m, n = self.sorted.shape
        parts = [max(0.02, 2 * k / n)]
        while parts[-1] < 1:
            parts.append(min(1.0, parts[-1] * widen))
        width = np.array([max(1, int(p * n / 2)) for p in parts[:-1]], np.int64)
        out = np.full((len(at), len(parts)), np.inf)
        if len(width):
            pos = np.stack([np.searchsorted(self.sorted[i], at[:, i]) for i in range(m)], 1)[:, :, None]
            each = np.arange(m)[None, :, None]
            left, right = self.sorted[each, np.maximum(pos - width, 0)], self.sorted[each, np.minimum(pos + width, n - 1)]
            out[:, :-1] = np.median(np.maximum(at[:, :, None] - left, right - at[:, :, None]), axis=1)
        return np.where(np.isnan(out), np.inf, out)

    def closest(self, rows: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """Those of ``rows`` that can be among the ``k`` nearest to ``q``, by squared distances from one product and their rounding errors."""
        if len(rows) <= k:
            return rows
        sizes = self.squares[rows] + q @ q
        rough, error = sizes - 2 * (self.x[rows] @ q), 1e-9 * sizes
        return rows[~(rough - error > np.partition(rough + error, k - 1)[k - 1])]

    def nearest(self, own: np.ndarray, q: np.ndarray, k: int, share: float, widen: float, first: int = 0) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """(ids, distances) of the ``k`` nearest found for each query, its own id left out, and the median window at which queries were done.

        A query is done at its narrowest window whose ``k`` best lie within the radius. A window holds all that narrower ones hold, so that
        one is looked for from ``first`` in both directions: windows narrower than the k-th distance found fail, wider ones don't.
        """
        m = len(self.sorted)
        at = np.stack([v @ self.lines for v in q])
        radius = self.radii(at, k, widen)
        last = radius.shape[1] - 1
        got: list = [None] * len(q)
        fails, done, kept = np.full(len(q), -1), np.full(len(q), last), np.full(len(q), -1)
        now, step = np.full(len(q), min(first, last)), np.ones(len(q), np.int64)
        active = np.arange(len(q))
        while len(active):
            r = radius[active, now[active]]
            low = np.stack([np.searchsorted(self.sorted[i], at[active, i] - r, "left") for i in range(m)], 1)
            high = np.stack([np.searchsorted(self.sorted[i], at[active, i] + r, "right") for i in range(m)], 1)
            for a, j in enumerate(active):
                near = self.ids != own[j]
                if np.isfinite(r[a]):
                    near &= self.collisions(low[a], high[a]) >= share * m
                rows = self.closest(np.flatnonzero(near), q[j], k)
                d = np.sqrt(((self.x[rows] - q[j]) ** 2).sum(1))
                kth = np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf
                narrowest = min(np.searchsorted(radius[j], kth), last)
                if now[j] == last or kth <= r[a]:
                    best = np.flatnonzero(d <= kth) if kth < np.inf else np.arange(len(d))
                    best = best[np.lexsort((self.ids[rows[best]], d[best]))[:k]]
                    got[j], kept[j], done[j], fails[j] = (self.ids[rows[best]], d[best]), now[j], now[j], max(fails[j], min(narrowest, now[j]) - 1)
                    now[j] = max(done[j] - step[j], fails[j] + 1)
                else:
                    fails[j], done[j] = now[j], min(done[j], narrowest)
                    now[j] = min(fails[j] + step[j], done[j])
                step[j] *= 2
            active = active[(kept[active] != done[active]) | (done[active] - fails[active] > 1)]
        return got, int(np.median(done))


def usable(vector: str) -> Column:
    """Vectors that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return x.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def answers(batches: Iterator[pa.RecordBatch], k: int, projections: int, share: float, widen: float, at_once: int = 64) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) from batches sorted by (cell, asks): a cell's vectors make its block, its queries follow batch by batch."""
    cell, held, block, first = None, [], None, 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        cells, asks = t.column("cell").to_numpy(), t.column("asks").to_numpy()
        cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(cells)]
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low == high:
                continue
            if cells[low] != cell:
                cell, held, block, first = cells[low], [], None, 0
            part = t.slice(low, high - low)
            ids = part.column("vec_id").to_numpy()
            x = part.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            if not asks[low]:
                held.append((ids, x))
                continue
            if block is None and held:
                block, held = Block(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), projections), []
            if block is None:
                continue
            for i in range(0, len(ids), at_once):
                own = ids[i : i + at_once]
                got, first = block.nearest(own, x[i : i + at_once], k, share, widen, first)
                yield pa.RecordBatch.from_pydict({
                    "query_id": np.repeat(own, [len(v) for v, _ in got]), "vec_id": np.concatenate([v for v, _ in got]), "score": np.concatenate([d for _, d in got]),
                })


def search(vectors: DataFrame, asked: Column, k: int = 10, projections: int = 64, share: float = 0.58, widen: float = 1.25, block_rows: int = 8192, query_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows of ``vectors`` (vec_id, embedding) where ``asked``, against all rows but the query's own."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding"))
    v = v.withColumn("size", F.size("embedding"))
    queries = v.where(asked).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("size", F.size("embedding"))
    rows, n_queries = v.count(), queries.count()
    blocks, query_blocks = max(1, -(-rows // block_rows)), max(1, -(-n_queries // query_rows))
    block = F.pmod(F.xxhash64("vec_id", F.col("embedding")), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(query_blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = v.select("size", block.alias("b"), every(query_blocks).alias("q"), "vec_id", "embedding", F.lit(False).alias("asks"))
    ask = queries.select("size", every(blocks).alias("b"), query_block.alias("q"), "vec_id", "embedding", F.lit(True).alias("asks"))
    cells = data.unionByName(ask).withColumn("cell", F.xxhash64("size", "b", "q")).select("cell", "asks", "vec_id", "embedding")
    run = lambda batches: answers(batches, k, projections, share, widen)
    found = cells.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_collision_neighbours(vectors: DataFrame) -> DataFrame:
    """The contract's search: ids divisible by 100 ask for their 10 nearest."""
    return search(vectors, F.col("vec_id") % 100 == 0)
