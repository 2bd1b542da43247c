"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents become sets of five-word shingles; equal sets are one node. Every node carries a sketch of 120 MinHash values, one byte each.
24 bands of five values propose candidates (a pair of similarity 0.8 is missed with probability 7e-5). Buckets with the same members
count once, and large buckets are cut into blocks whose pairs of blocks are separate cells, so no task holds more than two blocks.

In a cell, sketches are compared 20 values at a time. After each step a pair is dropped when the posterior probability that its
similarity reaches the threshold (uniform prior, one-byte matches with chance agreement 1/256) is below the tolerance. Pairs that remain
are verified on their whole shingle sets. A pair in several buckets belongs to the first band in which it agrees, so it counts once
without shuffling pairs. A cell returns link counts per node and a spanning forest, never pairs; classes are the connected components.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` unchanged; a text of one to four words has one shingle, all its words; a null or blank
text has none, links to nothing and is a class of its own; repeated rows are copies of one another; a null id keeps its row, and a class
takes the smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgauge.llm.tables import by_key, row_key, stored
from tollgauge.llm.words import mix, slices, text_buffer, window_hashes, word_hashes, word_spans

HASHES, ROWS, STEP, BLOCK = 120, 5, 20, 512
BANDS = HASHES // ROWS
U = np.uint64


@lru_cache
def multipliers() -> np.ndarray:
    return mix(np.arange(1, HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes per row of a text buffer."""
    for a, b in slices(offsets):
        starts, ends, first = word_spans(offsets[a : b + 1], data)
        h = word_hashes(data, starts, ends)
        w = window_hashes(h, n)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            if j - i >= n:
                yield np.unique(w[i : j - n + 1])
            else:
                yield window_hashes(h[i:j], j - i) if j > i else np.zeros(0, U)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One byte of each MinHash value."""
    low = np.full(HASHES, np.iinfo(U).max, U)
    for i in range(0, len(shingles), 4096):
        np.minimum(low, (shingles[None, i : i + 4096] * multipliers()[:, None]).min(1), out=low)
    return (mix(low) & U(255)).astype(np.uint8)


def _sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(2))
            node, sketches, none = [], [], []
            for x in shingle_sets(offsets, data, n):
                with np.errstate(over="ignore"):
                    node.append(int(mix(np.array([len(x)], U) + np.bitwise_xor.reduce(mix(x)) * U(3) + x.sum(dtype=U))[0]) if len(x) else 0)
                sketches.append(sketch(x) if len(x) else np.zeros(HASHES, np.uint8))
                none.append(not len(x))
            if not node:
                continue
            s = np.stack(sketches)
            words = np.zeros((len(s), BANDS, 8), np.uint8)
            words[:, :, :ROWS], words[:, :, ROWS] = s.reshape(-1, BANDS, ROWS), np.arange(BANDS)
            keys = mix(words.reshape(-1).view(U)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(node, U).view(np.int64), mask=np.array(none)), pa.array([x.tobytes() for x in sketches], pa.binary()), lists],
                names=["doc_id", "k", "node", "sketch", "keys"],
            )

    return run


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """Per number of compared values (STEP, 2 STEP, ...): the fewest matches at which a pair may still reach the threshold."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(log - log.max(1, keepdims=True))
        tail = weight[:, s >= threshold].sum(1) / weight.sum(1)
        out.append(int(np.argmax(tail >= tolerance)))
    return tuple(out)


def _verify(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) of sets reach the threshold, counted on whole sets."""
    nx, ny = np.array([len(a) for a in x]), np.array([len(b) for b in y])
    if len(i) < 4 * (len(x) + len(y)):
        common = np.array([len(np.intersect1d(x[a], y[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
    else:
        # many pairs: incidence matrices of the shared shingles, a bounded number of columns at a time
        each, where = np.unique(np.concatenate([*x, *y]), return_inverse=True)
        row = np.repeat(np.arange(len(x) + len(y)), np.concatenate([nx, ny]))
        order = np.argsort(where, kind="stable")
        where, row = where[order], row[order]
        total = np.zeros((len(x), len(y)), np.float32)
        for low in range(0, len(each), 2048):
            part = slice(*np.searchsorted(where, [low, low + 2048]))
            left = row[part] < len(x)
            a, b = np.zeros((len(x), 2048), np.float32), np.zeros((len(y), 2048), np.float32)
            a[row[part][left], where[part][left] - low] = 1
            b[row[part][~left] - len(x), where[part][~left] - low] = 1
            both = (a.any(0) & b.any(0)).nonzero()[0]
            total += a[:, both] @ b[:, both].T
        common = total[i, j].astype(np.int64)
    return common >= threshold * (nx[i] + ny[j] - common) - 1e-9


def _cells(n: int, threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"node": [], "root": [], "links": []}
        for t in by_key(batches, "cell"):
            node = t.column("node").to_numpy()
            _, once = np.unique(node, return_index=True)
            side = t.column("side").to_numpy()[once]
            once = once[np.argsort(side, kind="stable")]
            node, side, copies = node[once], np.sort(side), t.column("copies").to_numpy()[once]
            band, same = int(t.column("band")[0].as_py()), bool(t.column("same")[0].as_py())
            marks = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in t.column("sketch").take(pa.array(once))])
            cut = len(node) if same else int(np.searchsorted(side, 1))
            left, right = np.arange(cut), np.arange(cut) if same else np.arange(cut, len(node))
            if not len(left) or not len(right):
                continue
            match = np.zeros((len(left), len(right)), np.uint8)
            for q in range(STEP):
                match += marks[left, q][:, None] == marks[right, q][None, :]
            i, j = np.nonzero(match >= least[0])
            m = match[i, j].astype(np.int64)
            i, j = left[i], right[j]
            if same:
                m, i, j = m[i < j], i[i < j], j[i < j]
            for step, fewest in enumerate(least[1:], 1):
                for q in range(step * STEP, (step + 1) * STEP):
                    m += marks[i, q] == marks[j, q]
                stay = m >= fewest
                m, i, j = m[stay], i[stay], j[stay]
            first = np.full(len(i), -1)
            for b in range(band, -1, -1):
                agree = np.ones(len(i), bool)
                for q in range(b * ROWS, (b + 1) * ROWS):
                    agree &= marks[i, q] == marks[j, q]
                first[agree] = b
            i, j = i[first == band], j[first == band]
            if not len(i):
                continue
            used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            offsets, data = text_buffer(t.column("text").take(pa.array(once[used])))
            sets = list(shingle_sets(offsets, data, n))
            a, b = at[: len(i)], at[len(i) :]
            ua, ub = np.unique(a), np.unique(b)
            linked = _verify([sets[x] for x in ua], [sets[x] for x in ub], np.searchsorted(ua, a), np.searchsorted(ub, b), threshold)
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            root = np.arange(len(node))
            while True:  # labels fall to the smallest node of the component; nodes are in no special order
                new = root.copy()
                np.minimum.at(new, i, root[j])
                np.minimum.at(new, j, root[i])
                new = new[new]
                if (new == root).all():
                    break
                root = new
            hit = np.flatnonzero(links)
            out["node"].append(node[hit])
            out["root"].append(node[root[hit]])
            out["links"].append(links[hit].astype(np.int64))
            if sum(map(len, out["node"])) > 50_000:
                yield pa.RecordBatch.from_pydict({c: np.concatenate(v) for c, v in out.items()})
                out = {c: [] for c in out}
        if out["node"]:
            yield pa.RecordBatch.from_pydict({c: np.concatenate(v) for c, v in out.items()})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest label of each connected component of ``edges`` (a, b), for nodes that have an edge.

    Labels spread along edges and then jump to their label's label; each round is written to the shared folder, and the driver learns
    one number per round, how many labels fell.
    """
    both = stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        fell = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        up = label.select(F.col("node").alias("mid"), F.col("root").alias("jump"))
        new = stored(fell.join(up, "mid", "left").select("node", "old", F.least("mid", "jump").alias("root")))
        moved = new.where("old <> root").count()
        label = new.select("node", "root")
        if not moved:
            return label


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-5) -> DataFrame:
    """One row per row of ``docs``: (doc_id, k, class_id, n_links, class_root).

    ``n_links`` counts other rows of similarity ``threshold`` or more, copies included; ``class_id`` is the smallest doc_id of the
    connected component, ``class_root`` its label and ``k`` the row's content key.
    """
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("k"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = stored(keyed.mapInArrow(_sketches(n), f"doc_id {kind}, k long, node long, sketch binary, keys array<long>"))
    nodes = sketched.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("k").alias("k"), F.min("sketch").alias("sketch"), F.min("keys").alias("keys"))
    nodes = stored(nodes)
    proposed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    buckets = (
        proposed.groupBy("key", "band").agg(F.count("*").alias("size"), F.expr("bit_xor(xxhash64(node))").alias("mark"), F.min("node").alias("low"), F.max("node").alias("high"))
        .where("size > 1").groupBy("size", "mark", "low", "high").agg(F.min(F.struct("band", "key")).alias("first")).select("first.band", "first.key", "size")
    )
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    member = proposed.join(buckets, ["band", "key"]).groupBy("node").agg(F.collect_list(F.struct("band", "key", blocks.alias("blocks"), own.alias("own"))).alias("member"))  # one per band at most
    carried = nodes.select("node", "copies", "k", "sketch").join(member, "node")
    texts = keyed.select("k", "text").dropDuplicates(["k"])  # rows of equal id and text travel once
    dealt = texts.join(carried, "k").select("node", "copies", "sketch", "text", F.explode("member").alias("m"))
    dealt = dealt.select("node", "copies", "sketch", "text", "m.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m.blocks") - 1)).alias("other"))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select("node", "copies", "sketch", "text", "band", cell.alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("same"))
    results = stored(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(n, threshold, tolerance), "node long, root long, links long"))
    label = components(results.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = results.groupBy("node").agg(F.sum("links").alias("links"))
    ids = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    known = ids.join(label, "node", "left").join(links, "node", "left").select("node", "low", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    known = stored(known)
    classes = known.groupBy("root").agg(F.min("low").alias("class_id"))
    known = known.join(classes, "root").select("node", "class_id", F.col("root").alias("class_root"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return sketched.select("doc_id", "k", "node").join(known, "node", "left").select(
        "doc_id", "k", F.coalesce("class_id", F.when(F.col("node").isNull(), F.col("doc_id"))).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class_root"
    )


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id (null last); rows without words all stay."""
    found = near_duplicates(docs, n, threshold).where("class_root IS NOT NULL")
    keep = found.groupBy("class_root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("first")).select(F.col("first.k").alias("k_"))
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.where(some).withColumn("k_", row_key("doc_id", "text")).join(keep, "k_", "left_semi").dropDuplicates(["k_"]).drop("k_")
    return kept.unionByName(docs.where(~some))


def op5_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "n_links")
