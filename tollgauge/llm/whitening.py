"""Whitening of embeddings with distributed block matrices.

Vectors become integer rows (``floor(64 * c) + 1000000``), so sums and squared deviations are exact. Centred rows get consecutive
numbers and go into a ``BlockMatrix`` of row blocks. Its transpose times itself, with the row blocks dealt to many partial products,
is the scatter matrix; the driver holds only that matrix of dimension by dimension, takes its eigenvectors, and a second block
product with the whitening matrix projects every row. A third one, over the stored projection, measures how far its covariance is
from the identity. Rows stay in the JVM throughout and never reach the driver.

Defined cases: vectors that are null or hold null, NaN or infinite entries are left out, as are entries beyond 2^56, whose integers
would not fit. One matrix needs one dimension: vectors of another length than the most common one (the longer of equally common
ones) are left out too, so empty vectors go unless all are empty, and then the result is empty. Null and repeated ids are kept, each
row by itself; columns beside ``vec_id`` and the vector are ignored. Components without variance have a null ``whitened``, and do not
count in ``identity_error``; ``explained`` is null if there is no variance at all. A ``deviation`` beyond a long is null.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgauge.llm.tables import stored

SCALE, SHIFT, LARGEST = 64.0, 1000000, 2.0**56
#: Rows and columns of a block, and row blocks in one partial product.
SIDE, BLOCKS = 1024, 16
#: Components with a smaller share of the variance are rounding noise.
NOISE = 1e-12
LOW_BITS = (1 << 33) - 1


def integer_rows(vectors: DataFrame, vector: str) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = vectors.where(whole).select("vec_id", F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (sizes.d if sizes else 0))


def numbered(rows: DataFrame) -> DataFrame:
    """Consecutive numbers from 0 in column ``i``, from the stored column ``own_`` (partition and place in it when they were written)."""
    part = F.shiftright("own_", 33)
    counts = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row per partition
    starts, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(at)
        at += counts.get(p, 0)
    base = F.element_at(F.array(*[F.lit(v).cast("long") for v in starts or [0]]), part.cast("int") + 1)
    return rows.withColumn("i", F.col("own_").bitwiseAND(F.lit(LOW_BITS)) + base)


def block_matrix(rows: DataFrame, vector: str) -> BlockMatrix:
    """Row blocks from columns ``i`` and ``vector`` (array of doubles), kept on the executors for the products that read them."""
    frame = rows.select(F.col("i").alias("index"), array_to_vector(vector).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(frame, "vector")).toBlockMatrix(SIDE, SIDE).persist(StorageLevel.MEMORY_AND_DISK)


def scatter(a: BlockMatrix) -> np.ndarray:
    """Transpose times matrix on the driver: as many rows and columns as the vectors have entries."""
    splits = max(1, math.ceil(a.numRowBlocks / BLOCKS))
    # the Python method leaves out the argument that deals the inner dimension to several tasks
    product = a.transpose()._java_matrix_wrapper._java_model.multiply(a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, SIDE, SIDE).toLocalMatrix().toArray()


def projected(spark: SparkSession, a: BlockMatrix, w: np.ndarray) -> DataFrame:
    """(i, w) with the rows of ``a`` times ``w``."""
    tiles = [
        ((r // SIDE, c // SIDE), Matrices.dense(*(t := w[r : r + SIDE, c : c + SIDE]).shape, t.ravel(order="F")))
        for r in range(0, w.shape[0], SIDE)
        for c in range(0, w.shape[1], SIDE)
    ]
    product = a.multiply(BlockMatrix(spark.sparkContext.parallelize(tiles, 1), SIDE, SIDE, *w.shape)).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    rows = MLUtils.convertVectorColumnsToML(rows, "vector")
    return rows.select(F.col("index").alias("i"), vector_to_array("vector").alias("w"))


def squared_deviation(n: int, sums: list[int], spread: int) -> Column:
    """Sum over dimensions of (n * x - S)^2, exact: as longs where no step can leave their range, else as 38-digit decimals."""
    kind = "long" if len(sums) * (n * (spread + 1)) ** 2 < 1 << 62 and n * (SHIFT + spread) < 1 << 62 else "decimal(38,0)"
    size, total = F.lit(n).cast(kind), F.array(*[F.lit(str(s)).cast(kind) for s in sums])
    apart = F.zip_with("x", total, lambda x, s: F.try_subtract(F.try_multiply(size, x.cast(kind)).cast(kind), s).cast(kind))
    return F.aggregate(apart, F.lit(0).cast(kind), lambda acc, v: F.try_add(acc, F.try_multiply(v, v).cast(kind)).cast(kind)).try_cast("long")


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = 32) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) per vector that takes part.

    ``whitened`` and ``explained`` are arrays over the first ``components`` principal components, ``deviation`` is the sum over the
    dimensions of (n * x - S)^2.
    """
    rows = stored(integer_rows(vectors, vector).withColumn("own_", F.monotonically_increasing_id()))
    entries = rows.select(F.posexplode("x").alias("d", "x")).groupBy("d")
    stats = entries.agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("d").collect()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not stats:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    n, sums = stats[0].n, [int(r.s) for r in stats]
    spread = max(max(abs(r.low), abs(r.high)) for r in stats)
    means = F.array(*[F.lit(s // n) for s in sums])
    rests = F.array(*[F.lit((s % n) / n) for s in sums])  # whole part and rest, so that nothing is lost before subtracting
    centred = F.zip_with(F.zip_with("x", means, lambda x, m: (x - m).cast("double")), rests, lambda x, r: x - r)
    own = stored(numbered(rows).select("i", "vec_id", squared_deviation(n, sums, spread).alias("deviation"), centred.alias("c")))
    a = block_matrix(own, "c")
    v = scatter(a) / n
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    trace = float(np.trace(v))
    real = int(np.sum(e > NOISE * trace)) if trace > 0 else 0
    explained = F.array(*[F.lit(float(x) / trace if trace > 0 else None).cast("double") for x in e])
    out = own.select("i", "vec_id", "deviation")
    error = F.lit(None).cast("double")
    if real:
        white = stored(projected(vectors.sparkSession, a, u[:, :real] / np.sqrt(e[:real])))
        apart = scatter(block_matrix(white, "w")) / n - np.eye(real)
        error = F.lit(float(np.abs(apart).max()))
        empty = F.array_repeat(F.lit(None).cast("double"), len(e) - real)
        out = out.join(white.select("i", F.concat("w", empty).alias("whitened")), "i")
    else:
        out = out.withColumn("whitened", F.array_repeat(F.lit(None).cast("double"), len(e)))
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), error.alias("identity_error"))


def op12_block_whitening(vectors: DataFrame) -> DataFrame:
    """The contract's rows of :func:`whiten`: one per vector and component, up to 32."""
    found = whiten(vectors)
    at = found.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at_", "own_"))
    return at.select("vec_id", (F.col("at_") + 1).cast("int").alias("component"), "n", "deviation", F.col("own_.whitened").alias("whitened"), F.col("own_.explained").alias("explained"), "identity_error")
