"""Line removal through levelled runs against brute force and DuckDB."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tollgauge.llm import line_runs
from tollgauge.llm.tables import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "\n".join(f"line {i % 700}" for i in range(20000))
ODD = [
    (1, None, "a"), (1, None, "a"), (None, "x\ny", None), (None, "x\ny", None), (2, "", "b"), (3, "\n", "b"), (4, " X \nx\t\n\x0bx\r\nÄ\nä", "b"),
    (5, LONG, "b"), (6, LONG + "\nlast", "b"), (7, "x", "c"), (8, "\n\nÄ", "c"), (9, "line 3", "c"), (10, "a\n\nb\n", "c"), (11, "b", "d"), (12, "B ", "d"),
]


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, threshold):
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    found = Counter(k for _, x in lines for k in {key(y) for y in x} if k)
    out = []
    for i, x in lines:
        stay = [y for y in x if found[key(y)] < threshold]
        out.append((i, len(x), len(x) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return rows.withColumn("k", F.lit(7)).withColumn("h", F.lit("clash")).withColumn("batch", F.lit(None).cast("string")).repartition(6)


@pytest.mark.parametrize(("threshold", "batches", "fanout"), [(2, 8, 2), (3, 3, 4), (1, 2, 2)])
def test_equals_brute_force(odd, threshold, batches, fanout):
    rows = [(i, t) for i, t, _ in ODD]
    assert digest(line_runs.drop_frequent_lines(odd, threshold, batches, fanout)) == brute(rows, threshold)


def test_empty_table_and_whole_documents(spark, odd):
    assert digest(line_runs.drop_frequent_lines(odd.limit(0))) == []
    docs = table(spark, DATA, "documents").repartition(9)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert digest(line_runs.drop_frequent_lines(docs, fanout=3)) == brute(rows, 10)


def test_rare_keys_are_joined_and_hot_keys_are_not(spark, monkeypatch):
    monkeypatch.setattr(line_runs, "HOT_SHARE", 4)
    texts = [(i, f"common\nshared {i % 50}\nown {i}") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    assert digest(line_runs.drop_frequent_lines(docs, 10, 8, 3)) == brute(texts, 10)


def test_levels_and_counts_of_runs(spark):
    runs = line_runs.LineRuns(spark, 3, threshold=3, fanout=2)
    batch = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (2, 2, 1)], "h long, g long, docs long")
    for i in range(4):
        runs.add(batch, 3000000)
        once = spark.createDataFrame([(100 + i, 0, 1)], "h long, g long, docs long")
        runs.add(once, 1000000)
    assert [len(level) for level in runs.levels] == [0, 0, 0, 1]
    rows = {(r.h, r.total) for r in runs.runs()[0][1].collect()}
    # frequent keys stop at the batch that makes them frequent; later batches leave them out
    assert rows == {(1, 3), (2, 4), *[(100 + i, 1) for i in range(4)]}
    assert {r.h for r in runs.frequent().collect()} == {1, 2}


def test_runs_join_without_another_shuffle_of_them(spark):
    runs = line_runs.LineRuns(spark, 4, threshold=2)
    batch = spark.range(1000).select(F.col("id").alias("h"), F.col("id").alias("g"), F.lit(1).cast("long").alias("docs"))
    runs.add(batch, 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs._dealt(batch).agg(F.sum("docs").alias("docs")).join(runs.runs()[0][1], ["h", "g"], "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
