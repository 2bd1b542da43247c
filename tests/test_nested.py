"""Provenance at any depth, nested documents of any size, default comparison sets."""

import json

from pyspark.sql import functions as F

from tests.conftest import rows
from tollgauge.operators import catalog as G
from tollgauge.operators import provenance as PV
from tollgauge.plans import rankings as R


def by_hand(node, path=""):
    if isinstance(node, dict) and "accessed_date" in node:
        return [(path, node.get("confidence"), node["accessed_date"])]
    inner = [(f".{k}" if path else k, v) for k, v in node.items()] if isinstance(node, dict) else [(f"[{i}]", v) for i, v in enumerate(node)] if isinstance(node, list) else []
    return [x for step, v in inner for x in by_hand(v, path + step)]


def test_provenance_records_at_any_depth(spark, tmp_path):
    rec = lambda d, c="observed": {"accessed_date": d, "confidence": c, "url": "https://a.dev"}
    docs = {
        "acme": {"provenance": rec("2026-06-01"), "plans": [{"pricing": {"provenance": rec("2026-01-01", "assumed")}, "usage_limits": [{"provenance": rec(None)}, {"x": [[rec("2026-05-20", "assumed")]]}]}, 7, None, "text"]},
        "bare": rec("2020-01-01", "unknown"), "none": {"a": [1, {"b": {}}]}, "deep": {"a": {"b": {"c": {"d": {"e": [rec("2025-01-01")]}}}}}, "inner": {"p": {**rec("2026-06-01"), "inside": rec("1999-01-01")}},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "broken.json").write_text("{ no")
    found = PV.provenance_records(PV.read_raw(spark, str(tmp_path))).withColumn("stale", PV.is_stale(F.lit("2026-06-23").cast("date")))
    got = sorted((r.owner, r.path, r.confidence, r.accessed_date and str(r.accessed_date)) for r in found.collect())
    assert got == sorted((n, *x) for n, d in docs.items() for x in by_hand(d))
    assert {(r.owner, r.path) for r in found.where("stale").collect()} == {("acme", "plans[0].pricing.provenance"), ("acme", "plans[0].usage_limits[1].x[0][0]"), ("deep", "a.b.c.d.e[0]")}
    assert PV.provenance_records(PV.read_raw(spark, str(tmp_path)).where("owner = 'none'")).count() == 0


def test_nested_documents_are_written_from_ordered_rows(spark, tmp_path):
    providers = spark.createDataFrame([(1, 'A "x"', True), (2, "B", True), (3, "C", False), (4, "D", True)], "provider_id bigint, name string, is_active boolean")
    hot = spark.range(20000).select(F.lit(1).cast("bigint").alias("provider_id"), F.col("id").alias("plan_id"), F.concat(F.lit("p\n"), "id").alias("plan_name"), F.lit(None).cast("double").alias("monthly_usd"), (F.col("id") % 2 == 0).alias("is_active"))
    others = spark.createDataFrame([(2, 5, "z", 1.5, True), (3, 6, "y", 1.0, True), (2, 4, "é", 2.0, True)], hot.schema)
    plans = hot.unionByName(others)
    path = str(tmp_path / "docs")
    G.write_nested(providers, plans, path)
    want = {r.provider_id: [p.plan_id for p in r.plans] for r in G.active_providers_nested(providers, plans).collect()}
    got = {r.provider_id: ([p.plan_id for p in r.plans], r.name) for r in G.read_nested(spark, path).collect()}
    assert {k: v[0] for k, v in got.items()} == want and got[1][1] == 'A "x"' and want[4] == []


def test_default_models_fall_back_under_three(spark):
    ranked = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "model_id bigint, rank int")
    profiles = spark.createDataFrame([(i, i) for i in (10, 20, 30, 1, 2, 3, 4)], "model_id bigint, ord bigint")
    assert rows(R.default_models(ranked, profiles), "rank", "model_id") == [(1, 10), (2, 20), (3, 30)]
    few = profiles.where("model_id <> 30")
    assert rows(R.default_models(ranked, few), "rank", "model_id") == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 10)]


def test_provider_upserts_and_options(spark):
    offers = spark.createDataFrame([("alibaba", 1), ("openai", 2), ("nobody", 3)], "creator string, n int")
    there = spark.createDataFrame([("qwen",), ("openai",)], "provider string")
    assert rows(G.provider_upserts(offers, there, {"alibaba": "qwen"}), "creator", "provider", "known") == [("alibaba", "qwen", True), ("nobody", "nobody", False), ("openai", "openai", True)]
    entries = spark.createDataFrame([("p", "Old", 1), ("p", "New", 2), ("q", "Alpha", 1)], "provider_id string, provider_name string, ord int")
    assert rows(G.provider_options(entries), "position", "provider_id", "provider_name") == [(1, "q", "Alpha"), (2, "p", "New")]
