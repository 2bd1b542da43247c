import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, rows
from tollgauge.operators import catalog as G
from tollgauge.operators import estimates as E
from tollgauge.operators import quality as QC
from tollgauge.plans import rankings as R

EST = "plan_id bigint, model_id bigint, price double, value_score double, price_band string, confidence string"


def test_value_order_and_ties(spark):
    data = [(2, 1, 10.0, 50.0, "low", "observed"), (1, 1, 10.0, 50.0, "low", "observed"), (3, 1, 5.0, 50.0, "low", "observed"), (4, 1, 1.0, 90.0, "mid", "observed"), (5, 1, 1.0, None, "low", "observed")]
    out = R.value_by_band(spark.createDataFrame(data, EST))
    assert rows(out, "price_band", "rank", "plan_id") == [("low", 1, 3), ("low", 2, 1), ("low", 3, 2), ("mid", 1, 4)]


def test_top_ten_cap(spark):
    data = [(i, 1, 10.0, float(i), "low", "observed") for i in range(25)]
    out = R.value_by_band(spark.createDataFrame(data, EST)).orderBy("rank").collect()
    assert [r.plan_id for r in out] == list(range(24, 14, -1))


def test_benchmark_index(spark):
    data = [(1, "HumanEval", 90.0, True), (1, "SWE-bench-verified", 50.0, True), (1, "MBPP", 1.0, True), (2, "Aider-polyglot", 30.0, False), (3, "MBPP", 9.0, True), (4, "HumanEval", 150.0, True)]
    df = spark.createDataFrame(data, "model_id int, name string, score double, higher_is_better boolean")
    assert rows(E.benchmark_index(df)) == [(1, 64.3), (2, 70.0), (4, 100.0)]


def test_first_message_limit_price(spark):
    plans = spark.createDataFrame([(1, 20.0), (2, 20.0), (3, None)], "plan_id int, price double")
    limits = spark.createDataFrame([(1, "messages_per_day", 10.0, 0), (1, "messages_per_month", 1.0, 1), (3, "messages_per_month", 5.0, 0)], "plan_id int, limit_type string, limit_value double, ord int")
    assert sorted(rows(E.cost_per_message(plans, limits, ("ord",))), key=str) == [(1, 0.0667), (2, None), (3, None)]


def test_task_efficiency(spark):
    df = spark.createDataFrame([("m", 24.0, 344.0, 0.039, None, 0.18, 36000.0), ("n", 40.0, 82.0, 0.14, 0.003, 0.28, 20000.0)], "name string, intel double, tps double, price_in double, price_cache double, price_out double, out_tokens double")
    out = {r.name: r for r in E.task_efficiency(df).collect()}
    assert out["m"].cost100 == pytest.approx((0.00039 + 0.00648) * 100)
    assert max(r.share_of_best for r in out.values()) == 1.0


def test_strengths_and_upsert(spark, one):
    assert one(G.strengths(F.lit(1.0), F.lit(None).cast("double"), F.lit(40.0))) == ["coding", "math"]
    assert one(G.strengths(*[F.lit(None).cast("double")] * 3)) == ["general"]


def test_replace_refs_sets_first_default(spark):
    s = "plan_id int, model_id int, access_type string, ord int"
    out = G.replace_refs(spark.createDataFrame([(1, 9, "full", 0), (2, 9, "full", 0)], s), spark.createDataFrame([(1, 5, "full", 0), (1, 6, "full", 1)], s))
    assert rows(out, "plan_id", "model_id", "is_default") == [(1, 5, True), (1, 6, False), (2, 9, False)]


def test_selection_fallback(spark):
    plans = spark.createDataFrame([(i, float(i)) for i in range(1, 9)], "plan_id int, overall double")
    ask = spark.createDataFrame([(1, 0), (99, 1)], "plan_id int, ord int")
    assert rows(G.selection(plans, ask), "plan_id") == [(6,), (7,), (8,)]
    ask = spark.createDataFrame([(i, i) for i in range(1, 9)], "plan_id int, ord int")
    assert len(rows(G.selection(plans, ask))) == 6


def test_feature_differences(spark):
    df = spark.createDataFrame([(1, True, 5.0), (2, True, None)], "plan_id int, cli boolean, ctx double")
    out = rows(G.feature_differences(G.feature_rows(df, {"a": ["cli"], "b": ["ctx"]})), "feature", "differs", "section_differs")
    assert out == [("cli", False, False), ("ctx", True, True)]


def test_locale_order(spark):
    df = spark.createDataFrame([("b",), ("B",), ("a",), ("A",)], "n string")
    assert [r.n for r in df.orderBy(G.name_order("n")).collect()] == ["a", "A", "b", "B"]


def test_issue_summary_and_report(spark):
    plans = spark.createDataFrame([("p1", "x", "pro", None), ("p2", "y", "pro", None), ("p3", "x", "api", None)], "plan_id string, provider_id string, tier string, monthly_usd double")
    providers = spark.createDataFrame([("x", "https://x"), ("y", None)], "provider_id string, pricing_url string")
    issues = QC.plans_without_price(plans, providers)
    assert rows(issues, "plan_id", "severity") == [("p1", "error"), ("p2", "warning")]
    assert rows(QC.summarize(issues)) == [("plan-no-price", 2, True, "error/warning")]
    assert QC.report(QC.banned_limits(spark.createDataFrame([("p", "fair-use")], "plan_id string, limit_type string"))).count() == 1


def test_cost_metrics(spark):
    df = spark.createDataFrame([("a", '{"costPerTaskUsd": 0.5, "accessedDate": "2026-01-01"}'), ("b", "{bad"), ("c", None), ("d", '{"costPerTaskUsd": 5000}')], "model_id string, j string")
    out = QC.cost_problems(df, "j", F.lit("2026-06-01").cast("date"))
    assert rows(out, "check_id", "model_id") == [("aa-cost-per-task-bounds", "d"), ("aa-cost-per-task-malformed", "b"), ("aa-cost-per-task-stale", "a")]


def test_flagship_runs(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    out = entry(spark)
    assert out.count() > 0 and "value_score" in out.columns
    assert set(oracle_sql()) <= set(queries())


def test_results_do_not_depend_on_partitioning(spark):
    from __spark_entry__ import queries

    q = queries()["transparency_ranking"]
    first = rows(q(spark, DATA))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    assert rows(q(spark, DATA)) == first
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_representative_and_rank_inside_a_hot_plan(spark):
    from tollgauge.operators import estimates as E

    data = [("hot" if i % 3 else f"p{i % 40}", f"m{i}", [None, 1.0, 2.0, 7.5][i * 7 % 4], i) for i in range(3000)]
    df = spark.createDataFrame(data, "plan_id string, model_id string, wmq double, ord int")
    want, by_plan = {}, {}
    for p, m, q, o in data:
        by_plan.setdefault(p, []).append((q is None, -(q or 0), o, m))
    for p, members in by_plan.items():
        for n, (*_, m) in enumerate(sorted(members), 1):
            want[p, m] = n
    ranked = E.ranked(df)
    assert {(r.plan_id, r.model_id): r.rep_rank for r in ranked.collect()} == want
    assert {(r.plan_id, r.model_id) for r in E.representative(df).collect()} == {k for k, n in want.items() if n == 1}
    assert "WindowGroupLimit" in E.representative(df)._jdf.queryExecution().executedPlan().toString()
    assert E.ranked(df.limit(0)).count() == E.representative(df.limit(0)).count() == 0


def test_report_joins_nothing(spark):
    limits = spark.createDataFrame([("p", "fair-use"), ("q", "unlimited")], "plan_id string, limit_type string")
    plans = spark.createDataFrame([("y", "y", "pro", None)], "plan_id string, provider_id string, tier string, monthly_usd double")
    providers = spark.createDataFrame([("y", None)], "provider_id string, pricing_url string")
    issues = QC.banned_limits(limits).unionByName(QC.plans_without_price(plans, providers))
    shown = QC.report(issues)
    assert rows(shown, "check_id") == rows(QC.banned_limits(limits), "check_id")
    assert QC.report(issues.limit(0)).count() == 0
    assert QC.report(issues, verbose=True).count() == 3
    assert "Join" not in QC.report(QC.banned_limits(limits))._jdf.queryExecution().optimizedPlan().toString()
