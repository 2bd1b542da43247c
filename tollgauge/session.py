"""Session defaults, durable cut points and frames read more than once."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tollgauge", **conf: str) -> SparkSession:
    """Session with UTC time, adaptive execution and skew-join splitting on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a local session without that setting gets one beside its warehouse; on a cluster a missing setting is an error, not a
    reason to use local disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/../checkpoints")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so later stages read one fixed copy."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filed(df: DataFrame) -> DataFrame:
    """Like ``durable`` for wide rows, in compressed columns: later stages read only the columns they ask for."""
    path = f"{_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reused(df: DataFrame) -> DataFrame:
    """A costly frame that one plan reads several times: the first job that needs it keeps it on the executors' disks.

    Nothing runs here, and what is lost with an executor is computed again from its lineage.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def spread(scan: DataFrame) -> DataFrame:
    """Give a small scan enough partitions for CPU-heavy row work; a scan with enough splits is left alone.

    Only for plain scans and projections of them, where counting partitions runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
