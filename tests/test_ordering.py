import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tollgauge.operators import history as H
from tollgauge.operators import ordering as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One key owns most rows; ties on the timestamp."""
    rng = random.Random(1)
    base = dt.datetime(2024, 1, 1)
    data = []
    for i in range(600):
        key = 0 if rng.random() < 0.6 else rng.randint(1, 20)
        data.append((key, base + dt.timedelta(minutes=30 * rng.randint(0, 200)), i, rng.choice("abc"), float(rng.randint(0, 40))))
    return spark.createDataFrame(data, "k int, ts timestamp_ntz, id bigint, h string, v double").cache(), data


def test_previous_value_matches_plain_lag(skewed):
    df, data = skewed
    got = {r.id: r.prev_h for r in O.previous_value(df, ["k"], ["ts", "id"], ["h"]).collect()}
    last, want = {}, {}
    for k, ts, i, h, _ in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        want[i] = last.get(k)
        last[k] = h
    assert got == want


def test_previous_value_null_is_not_missing(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1, None), (1, dt.date(2024, 3, 1), 2, "x")], "k int, d date, id int, v string")
    out = O.previous_value(df, ["k"], ["d", "id"], ["v"]).orderBy("id").collect()
    assert [(r.prev_v, r.has_previous) for r in out] == [(None, False), (None, True)]


def test_global_rank_and_input_order(skewed, spark):
    df, data = skewed
    order = [F.col("v").desc(), F.col("id").asc()]
    want = [r[2] for r in sorted(data, key=lambda r: (-r[4], r[2]))]
    for parts, shuffles in ((1, "3"), (7, "5")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        got = [r.id for r in O.global_rank(df.repartition(parts), order).orderBy("rank").collect()]
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("per", [1, 3, 8])
def test_ranges_split_one_value_and_keep_the_order(spark, monkeypatch, per):
    """A value that fills most of the table, nulls and both directions, over many ranges."""
    monkeypatch.setattr(O, "RANGES", 64)
    monkeypatch.setattr(O, "PER_RANGE", per)
    rng = random.Random(3)
    data = [(rng.choice([None, 1.0, 1.0, 1.0, 2.0]), rng.choice(["a", "b", None]), i) for i in range(500)]
    df = spark.createDataFrame(data, "v double, s string, id int")
    for order, key in (
        ([F.col("v").desc(), F.col("s").asc(), F.col("id")], lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", r[2])),
        ([F.col("s").asc_nulls_last(), F.col("v").desc_nulls_first(), F.col("id").desc()], lambda r: (r[1] is None, r[1] or "", r[0] is not None, -(r[0] or 0), -r[2])),
    ):
        ranked = O.global_rank(df, order)
        assert [r.id for r in ranked.orderBy("rank").collect()] == [r[2] for r in sorted(data, key=key)]
        dealt = O.with_range(df, order, "p").groupBy("p").count().collect()
        assert len(dealt) > 20 and max(r["count"] for r in dealt) < 100
    with pytest.raises(ValueError, match="named columns"):
        O.with_range(df, [F.col("v") + 1])


def test_group_rank_with_a_hot_key(skewed, spark, monkeypatch):
    monkeypatch.setattr(O, "RANGES", 32)
    df, data = skewed
    got = {r.id: r.place for r in O.group_rank(df, ["k"], [F.col("v").desc(), F.col("id")], "place").collect()}
    want, seen = {}, {}
    for k, _, i, _, v in sorted(data, key=lambda r: (r[0], -r[4], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert got == want
    odd = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, id int")
    assert {r.id: r["rank"] for r in O.group_rank(odd, ["k"], [F.col("id").desc()]).collect()} == {1: 2, 2: 1, 3: 1}


def test_one_moment_of_one_key_is_spread(spark):
    df = spark.range(6000).select(F.lit("p").alias("k"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"), "id", (F.col("id") % 7).cast("string").alias("h"))
    got = O.previous_value(df, ["k"], ["ts", "id"], ["h"]).where("id > 0 AND prev_h != CAST((id - 1) % 7 AS string) OR has_previous != (id > 0)")
    assert got.count() == 0
    sizes = [r["count"] for r in O.with_range(df, [F.col("k"), F.col("ts"), F.col("id")], "p").groupBy("p").count().collect()]
    assert len(sizes) > 300 and max(sizes) < 120


def test_plans_are_built_without_jobs(skewed, spark):
    df, _ = skewed
    spark.sparkContext.setJobGroup("building", "no job belongs here")
    for built in (O.global_rank(df, [F.col("v").desc(), F.col("id")]), O.exact_median(df, "v"), O.percentile_rank(df, "v", "p"), O.previous_value(df, ["k"], ["ts", "id"], ["h"])):
        built.explain(mode="simple")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")


def test_exact_median(skewed, spark):
    df, data = skewed
    assert O.exact_median(df, "v").collect()[0].median == statistics.median(r[4] for r in data)
    for values, want in (([3.0, 1.0], 2.0), ([5.0], 5.0), ([1.0, 1.0, 9.0], 1.0), ([], None)):
        d = spark.createDataFrame([(x,) for x in values], "v double")
        out = O.exact_median(d, "v").collect()
        assert out[0].median == want


def test_percentile_rank(skewed):
    df, data = skewed
    got = {r.v: r.p for r in O.percentile_rank(df, "v", "p").collect()}
    vs = [r[4] for r in data]
    for v in set(vs):
        assert got[v] == pytest.approx(100 * sum(x <= v for x in vs) / len(vs))


def test_latest_and_recency_key(skewed):
    df, data = skewed
    got = rows(O.latest(df, ["k"], [F.col("ts").desc(), F.col("id").desc()]), "k", "id")
    key = O.recency_key(F.col("ts"), F.col("id"))
    packed = rows(df.groupBy("k").agg(F.max_by("id", key).alias("id")), "k", "id")
    best = {}
    for k, ts, i, *_ in data:
        best[k] = max(best.get(k, (ts, i)), (ts, i))
    assert got == packed == sorted((k, b[1]) for k, b in best.items())


def test_group_limit_runs_before_the_shuffle(skewed):
    df, _ = skewed
    plan = O.latest(df, ["k"], [F.col("ts").desc(), F.col("id").desc()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_content_changes(spark):
    base = dt.datetime(2024, 1, 1)
    data = [("p", "u", base + dt.timedelta(days=d), i, h) for i, (d, h) in enumerate([(0, "a"), (1, "a"), (2, "b"), (9, "b")])] + [("p", "w", base, 9, "z")]
    df = spark.createDataFrame(data, "provider_id string, source_url string, observed_at timestamp_ntz, snapshot_id int, content_hash string")
    out = {(r.source_url, r.snapshot_id): r.changed for r in H.content_changes(df).collect()}
    assert out == {("u", 0): True, ("u", 1): False, ("u", 2): True, ("u", 3): False, ("w", 9): True}


def test_trend_needs_three_points(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 6.0), ("a", 3, 4.0), ("b", 1, 1.0), ("b", 2, 2.0), ("c", 1, 5.0), ("c", 2, 5.0), ("c", 3, 5.0)], "k string, t int, v double")
    out = rows(H.trend(df, ["k"], ["t"], "v"), "k", "t", "scaled", "rising")
    assert out == [("a", 1, 0.0, True), ("a", 2, 1.0, True), ("a", 3, 0.5, True), ("c", 1, 0.0, True), ("c", 2, 0.0, True), ("c", 3, 0.0, True)]


def test_price_moves(spark):
    now = spark.createDataFrame([("x-1", 30.0), ("x-2", 11.0), ("x-3", None), ("x-4", 5.0), ("x-5", 9.0)], "plan_id string, price double")
    base = spark.createDataFrame([("x-1", 20.0), ("x-2", 10.0), ("x-3", 1.0), ("x-4", 0.0), ("x-6", 1.0)], "plan_id string, price double")
    assert rows(H.price_moves(now, base), "plan_id", "change") == [("x-1", 0.5)]


def test_run_ledger(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t + dt.timedelta(hours=i)) for i in range(9)], "run_id int, started_at timestamp_ntz")
    assert [r.run_id for r in H.newest_runs(df).collect()] == [8, 7, 6, 5, 4]
