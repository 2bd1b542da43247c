"""Reading the tables, cutting lineage and walking grouped Arrow batches."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local session without that setting (tests) gets one beside its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/../llm-scratch"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files that every executor can read again."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size: file sizes for scans. Runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame, each: int, least: int = 1) -> int:
    """How many pieces of ``each`` bytes the frame makes; where Catalyst has no usable estimate, string columns are measured."""
    size = input_bytes(df)
    if size > 1 << 50:
        size = df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(8)))).first()[0] or 0
    return max(least, math.ceil(size / each))


def row_key(*columns: str) -> Column:
    """64-bit key of a row's content: equal rows share it, and it is defined for null ids."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of one key each from batches sorted by an integer key; only one key's rows are held."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)
