"""Removal of lines found in many documents, counted through levelled sorted runs of line hashes.

The state is a set of *runs*: bucketed, sorted tables of (line hash, documents so far). A batch of documents is one sorted list of
line hashes with the number of its documents. It joins the runs bucket by bucket (equal buckets, so no run is shuffled again), the
keys already known as frequent are dropped from it (merge-anti-join), and the rest, with the documents seen so far added, becomes a
new run of level 0. When a level holds ``fanout`` runs they are compacted into one run of the next level. A key's newest row has its
largest count, so compaction takes maxima.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased; hashes have 128 bits. Keys with a
thousandth of a batch's (document, key) pairs or more are *hot*: at most 1000 per batch, whatever its size. Hot frequent keys
travel to the tasks as a set of that bound; only the others are joined with the lines, so no join key holds more than a
thousandth of any batch.

Defined cases: a null or empty text is one empty line; empty keys are never dropped; every row is a document of its own, also when
it repeats another or its id is null; columns beside ``doc_id`` and ``text`` are ignored; texts may have any length.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgauge.llm.tables import input_bytes, row_key, shared_folder
from tollgauge.llm.words import slices, text_buffer

BLANK = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 8 << 20
BUCKET_BYTES = 1 << 30
HOT_SHARE = 1000
COUNTS_DDL = "batch int, h long, g long, docs long"
KEYS_DDL = "k long, h long, g long"
RUN_DDL = "h long, g long, total long, hot boolean"


def lines_of(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text and, for each, the 16-byte hash of its key (empty for an empty key)."""
    lines = text.split(b"\n")
    keys = (line.strip(BLANK).lower() for line in lines)
    return lines, [xxhash.xxh3_128_digest(key) if key else b"" for key in keys]


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first row, texts) for slices of some megabytes."""
    offsets, data = text_buffer(column)
    for a, b in slices(offsets, SLICE_BYTES):
        yield a, [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]


def _longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _counts(batches: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() % batches
        for batch in rows:
            for _, texts in _texts(batch.column(0)):
                found = Counter(key for text in texts for key in set(lines_of(text)[1]) if key)
                if found:
                    h, g = _longs(list(found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(h), own), pa.int32()), pa.array(h), pa.array(g), pa.array(list(found.values()), pa.int64())], names=["batch", "h", "g", "docs"]
                    )

    return run


def _keys(hot: frozenset[bytes]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            k = batch.column(0).to_numpy()
            for a, texts in _texts(batch.column(1)):
                own = [{key for key in lines_of(text)[1] if key and key not in hot} for text in texts]
                if any(own):
                    h, g = _longs([key for keys in own for key in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k[a : a + len(own)], [len(x) for x in own])), pa.array(h), pa.array(g)], names=["k", "h", "g"])

    return run


def _dropped(hot: frozenset[bytes]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, texts in _texts(batch.column(1)):
                hits = batch.column(2).slice(a, len(texts)).to_pylist()
                total, gone, kept = [], [], []
                for text, own in zip(texts, hits):
                    lines, keys = lines_of(text)
                    mine = {np.array([x["h"], x["g"]], np.int64).tobytes() for x in own or ()}
                    stay = [line for line, key in zip(lines, keys) if not (key in mine or key in hot)]
                    total.append(len(lines))
                    gone.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"]
                )

    return run


class LineRuns:
    """Levelled sorted runs under one shared folder. Every run is a bucketed table whose files stay there; the catalogue entry goes."""

    def __init__(self, spark, buckets: int, threshold: int, fanout: int = 4):
        self.spark, self.buckets, self.threshold, self.fanout = spark, buckets, threshold, fanout
        self.folder = shared_folder(spark)
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]

    def _write(self, df: DataFrame) -> tuple[str, DataFrame]:
        """(path, bucketed table) of a new run: joins use the buckets, whole reads the path."""
        name = f"run_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", f"{self.folder}/{name}").saveAsTable(name)
        run = self.spark.table(name)
        run.schema  # resolved with its buckets and files before the catalogue forgets the name
        self.spark.sql(f"DROP TABLE {name}")
        return f"{self.folder}/{name}", run

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, "h", "g").groupBy("h", "g")

    def _read(self, level: list[tuple[str, DataFrame]]) -> DataFrame:
        return self.spark.read.schema(RUN_DDL).parquet(*[path for path, _ in level])

    def runs(self) -> list[tuple[str, DataFrame]]:
        return [run for level in self.levels for run in level]

    def add(self, counts: DataFrame, pairs: int) -> None:
        """A batch: rows (h, g, docs), ``pairs`` being the sum of docs. A key may have several rows."""
        own = self._dealt(counts).agg(F.sum("docs").alias("docs"))
        before = []
        for i, (_, run) in enumerate(self.runs()):
            own = own.join(run.select("h", "g", F.col("total").alias(f"before{i}")), ["h", "g"], "left")
            before.append(F.coalesce(f"before{i}", F.lit(0)))
        seen = F.greatest(F.lit(0), F.lit(0), *before)
        own = own.select("h", "g", (F.col("docs") + seen).alias("total"), (F.col("docs") * HOT_SHARE >= pairs).alias("hot"), seen.alias("seen"))
        fresh = own.where((F.col("seen") < self.threshold) | F.col("hot")).drop("seen")
        self.levels[0].append(self._write(fresh))
        self._compact()

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                return
            merged = self._write(self._dealt(self._read(level)).agg(F.max("total").alias("total"), F.max("hot").alias("hot")))
            level.clear()
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(merged)

    def frequent(self) -> DataFrame:
        """(h, g, hot) of the keys found in ``threshold`` documents or more."""
        if not self.runs():
            return self.spark.createDataFrame([], "h long, g long, hot boolean")
        out = self._read(self.runs()).where(F.col("total") >= self.threshold)
        return out.groupBy("h", "g").agg(F.max("hot").alias("hot"))


def drop_frequent_lines(docs: DataFrame, threshold: int = 10, batches: int = 8, fanout: int = 4) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) per row of ``docs``: lines whose key is in ``threshold`` documents or more are gone.

    The table is taken in ``batches`` batches of input partitions, as separate deliveries would be. ``kept_text`` joins the other
    lines, unchanged, with newlines.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(row_key("doc_id", "text").alias("k"), "doc_id", "text")
    path = shared_folder(spark)
    keyed.select("text").mapInArrow(_counts(batches), COUNTS_DDL).write.partitionBy("batch").parquet(path)
    counts = spark.read.schema(COUNTS_DDL).parquet(path)
    size = input_bytes(docs.select("text"))
    runs = LineRuns(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES if size < 1 << 50 else 0), threshold, fanout)
    for batch, pairs in sorted((r.batch, r.pairs) for r in counts.groupBy("batch").agg(F.sum("docs").alias("pairs")).collect()):
        runs.add(counts.where(F.col("batch") == batch).drop("batch"), pairs)
    frequent = runs.frequent()
    hot = frozenset(np.array([r.h, r.g], np.int64).tobytes() for r in frequent.where("hot").collect())  # at most 1000 a batch
    keys = keyed.select("k", "text").mapInArrow(_keys(hot), KEYS_DDL)
    hits = keys.join(frequent.where("NOT hot").select("h", "g"), ["h", "g"]).groupBy("k").agg(F.collect_set(F.struct("h", "g")).alias("hits"))
    out = f"doc_id {kind}, n_lines long, n_dropped long, kept_text string"
    return keyed.join(hits, "k", "left").select("doc_id", "text", "hits").mapInArrow(_dropped(hot), out)


def op11_line_runs(docs: DataFrame) -> DataFrame:
    """The contract's digest of :func:`drop_frequent_lines` with keys of ten documents."""
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
