"""Notes of estimates, and the date that stands in for an undated usage limit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tollgauge.operators.estimates import estimate_notes, plan_notes
from tollgauge.plans.rankings import usage_dates

SCORE = "plan_id int, best_type string, scored boolean, agentic double, coding double, speed double, price_in double, price_out double, cost_per_task double, median_cost double"


def notes(spark, *row):
    df = spark.createDataFrame([(1, *row)], SCORE).withColumn("notes", estimate_notes(F.col("best_type")))
    return df.first()["notes"]


def test_model_without_score(spark):
    assert notes(spark, "credits", None, None, None, None, None, None, None, 2.0) == [
        "No AA data available", "No cost-per-task data — efficiency neutral",
    ]


def test_credit_budget_and_efficiency(spark):
    assert notes(spark, "credits", True, 50.0, 60.0, None, 1.0, 2.0, 0.5, 0.25) == [
        "Speed score missing — using 50/100 fallback",
        "Model cost adjustment: blended $1.70/1M tokens (30% input, 70% output). 1 credit = $0.01 assumed.",
        "Efficiency multiplier 0.925× (cost-per-task $0.5 vs median $0.25)",
    ]


def test_free_model_and_missing_index(spark):
    assert notes(spark, "credits", True, None, 60.0, 10.0, 0.0, 0.0, 0.0, 1.0) == [
        "agentic index missing — weights redistributed to available indices",
        "Model cost is zero — cannot compute cost-adjusted estimate",
        "No cost-per-task data — efficiency neutral",
    ]


def test_other_limits_carry_no_cost_note(spark):
    assert notes(spark, "messages_per_day", True, 50.0, 60.0, 10.0, 1.0, 2.0, 3.0, 3.0) == [
        "Efficiency multiplier 1.000× (cost-per-task $3 vs median $3)",
    ]


def test_plan_notes_are_distinct(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (2, ["b"]), (3, [])], "plan_id int, notes array<string>")
    assert sorted(map(tuple, plan_notes(df).collect())) == [(1, "a"), (1, "b"), (2, "b")]


def test_undated_limits_fall_back_to_the_plan(spark):
    day = dt.date
    limits = spark.createDataFrame(
        [(1, 1, None), (1, 2, day(2024, 1, 2)), (2, 1, None)], "plan_id int, ord int, accessed_date date"
    )
    plans = spark.createDataFrame(
        [(1, day(2024, 5, 5)), (2, day(2024, 6, 6)), (3, None), (4, day(2024, 7, 7))], "plan_id int, last_verified date"
    )
    found = {r["plan_id"]: r["usage_date"] for r in usage_dates(limits, ("ord",), plans).collect()}
    assert found == {1: day(2024, 1, 2), 2: day(2024, 6, 6), 3: None, 4: day(2024, 7, 7)}
