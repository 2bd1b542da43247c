"""Whitening by block matrices against numpy on the same integers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tollgauge.llm import whitening
from tollgauge.llm.tables import table


def brute(vectors):
    """n, exact deviations, eigenvalues, whitened rows and trace of integer vectors."""
    x = [[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(v[j] for v in x) for j in range(d)]
    deviation = [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in x]
    c = np.array([[v[j] - s[j] // n - (s[j] % n) / n for j in range(d)] for v in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, deviation, e[::-1], (c @ u[:, ::-1]), np.trace(c.T @ c / n)


def compared(df, vectors, components=32):
    rows = df.orderBy("vec_id", "component").collect()
    n, deviation, e, flat, trace = brute(vectors)
    d = min(components, len(e))
    assert len(rows) == n * d
    got = np.array([r.whitened for r in rows], float).reshape(n, d)
    real = e[:d] > 1e-9 * trace
    want = flat[:, :d][:, real] / np.sqrt(e[:d][real])
    sign = np.sign((got[:, real] * want).sum(axis=0))
    np.testing.assert_allclose(got[:, real] * sign, want, atol=1e-6)
    assert np.isnan(got[:, ~real]).all()
    assert [r.deviation for r in rows[::d]] == deviation
    np.testing.assert_allclose([r.explained for r in rows[:d]], e[:d] / trace, rtol=1e-4, atol=1e-12)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-6
    assert [r.component for r in rows[:d]] == list(range(1, d + 1))


def test_whole_table(spark):
    vectors = table(spark, DATA, "embeddings")
    own = [r.embedding for r in vectors.orderBy("vec_id").collect()]
    compared(whitening.op12_block_whitening(vectors), own)


@pytest.mark.parametrize(("side", "blocks"), [(7, 2), (5, 1), (64, 16)])
def test_many_blocks_both_ways(spark, monkeypatch, side, blocks):
    monkeypatch.setattr(whitening, "SIDE", side)
    monkeypatch.setattr(whitening, "BLOCKS", blocks)
    rng = np.random.default_rng(1)
    own = (rng.normal(size=(150, 20)) @ rng.normal(size=(20, 20)) + 3).tolist()
    vectors = spark.createDataFrame(list(enumerate(own)), "vec_id long, embedding array<double>").repartition(5)
    compared(whitening.op12_block_whitening(vectors), own)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    own = [[*v, 2.0] for v in rng.normal(size=(40, 3)).tolist()]
    odd = [(None, own[0], "x"), (7, None, "x"), (8, [1.0, None, 1.0, 1.0], "x"), (9, [float("nan")] * 4, "x"), (10, [float("inf"), 0.0, 0.0, 0.0], "x"), (11, [1.0], "x"), (12, [], None), (13, [1e300] * 4, "x")]
    rows = [(100 + i // 2, v, "x") for i, v in enumerate(own)] + odd
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").withColumn("i", F.lit("clash")).withColumn("n", F.lit(None).cast("int"))
    got = whitening.op12_block_whitening(vectors)
    found = got.collect()
    assert len(found) == 41 * 4 and {r.n for r in found} == {41}
    assert sum(r.vec_id is None for r in found) == 4
    # a dimension without variance has no whitened value
    assert all((r.whitened is None) == (r.component == 4) for r in found)
    n, deviation, *_ = brute([*own, own[0]])
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation)


def test_without_vectors_or_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.op12_block_whitening(spark.createDataFrame([], kind)).count() == 0
    assert whitening.op12_block_whitening(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    same = whitening.op12_block_whitening(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect()
    assert len(same) == 4 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in same} == {(None, None, None, 0)}


def test_deviation_beyond_longs(spark):
    rows = spark.createDataFrame([(0, [0.0]), (1, [2.0**55])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(rows).collect()} == {None}
    sums = [int(64 * 2.0**20) + 2 * whitening.SHIFT]
    exact = spark.sql(f"SELECT array({whitening.SHIFT}L) AS x").select(whitening.squared_deviation(2, sums, 1 << 40).alias("d")).first().d
    assert exact == (2 * whitening.SHIFT - sums[0]) ** 2
