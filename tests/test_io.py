import copy
import datetime as dt
import json
import math
import re
import threading

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests.conftest import DATA, rows
from tollgauge.operators.normalize import best_limit, document_limit, normalize_limits
from tollgauge.plans.crawl import process_pages
from tollgauge.sources import documents as D
from tollgauge.sources import tables as TB
from tollgauge.sources.views import Views
from tollgauge.streaming import changes as S

PROV = {"url": "https://acme.dev/pricing", "accessed_date": "2026-06-01", "method": "manual", "confidence": "observed"}
FEATURES = {
    n: True
    for n in ("agent_capabilities", "web_search", "file_uploads", "voice_input", "cli_access", "api_access", "priority_access", "custom_instructions", "team_features", "sso")
} | {"code_context_length_k": 200, "ide_integrations": ["a", "b"]}


def plan(pid, tier="pro", monthly=20.0, annual=16.0, active=True):
    return {
        "id": pid, "provider_id": "acme", "name": "Pro", "tier": tier,
        "pricing": {"monthly_usd": monthly, "annual_monthly_usd": annual, "is_per_seat": False, "currency": "USD", "provenance": PROV},
        "models": [{"model_id": "m1", "access_type": "full", "is_default": True}],
        "usage_limits": [{"type": "messages_per_day", "value": 50, "reset_window": "5h", "provenance": PROV}, {"type": "unknown", "value": None, "provenance": PROV}],
        "features": FEATURES, "target_personas": [], "is_active": active, "last_verified": "2026-06-01", "source_url": "https://acme.dev/pro",
    }


def model(mid, released="2026-05-01"):
    return {
        "id": mid, "provider_id": "acme", "display_name": mid.upper(), "context_length_k": 200, "strengths": ["coding"], "released_date": released,
        "benchmarks": [{"name": "HumanEval", "score": 90, "unit": "percent", "higher_is_better": True, "provenance": PROV}], "provenance": PROV,
    }


def provider(pid="acme", **changes):
    doc = {
        "id": pid, "name": "Acme", "display_name": "Acme", "website": "https://acme.dev", "pricing_url": "https://acme.dev/pricing", "docs_url": "https://acme.dev/docs",
        "description": "A coding assistant", "logo_slug": "acme", "category": "ai_lab", "headquarters_country": "US",
        "plans": [plan("acme-pro"), plan("acme-free", "free", 0.0, None), plan("acme-api", "api", None, None), plan("acme-old", active=False)],
        "models": [model("m1"), model("m2", "2024-01-01")], "last_verified": "2026-06-01", "provenance": PROV,
    }
    return {**doc, **changes}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "acme.json").write_text(json.dumps(provider()))
    return tmp_path


def as_of():
    return F.lit("2026-06-23").cast("date")


def test_load_filters_scope_and_recency(spark, folder):
    docs = D.load_providers(spark, str(folder), as_of())
    assert rows(D.plans_of(docs), "plan_id") == [("acme-pro",)]
    assert rows(D.models_of(docs), "model_id") == [("m1",)]
    assert rows(D.api_plans_of(D.read_documents(spark, str(folder))), "plan_id") == [("acme-api",)]
    best = best_limit(normalize_limits(document_limit(D.limits_of(D.plans_of(docs)))), ("ord",)).collect()
    assert [(r.plan_id, r.tokens_1mo) for r in best] == [("acme-pro", 2000000)]


def test_broken_file_is_skipped_when_lenient(spark, folder):
    (folder / "bad.json").write_text("{ not json")
    assert D.read_documents(spark, str(folder)).count() == 1


@pytest.mark.parametrize(
    "change,path",
    [
        ({"category": "x"}, "category"), ({"website": "nope"}, "website"), ({"description": "short"}, "description"), ({"founded_year": 1980}, "founded_year"),
        ({"last_verified": "June"}, "last_verified"), ({"name": ""}, "name"),
    ],
)
def test_strict_load_rejects(spark, folder, change, path):
    (folder / "bad.json").write_text(json.dumps(provider("bad", **change)))
    with pytest.raises(D.InvalidDocuments, match=path):
        D.load_providers(spark, str(folder), as_of())


def test_nested_rules(spark, folder):
    doc = provider("bad")
    p = copy.deepcopy(doc["plans"][0])
    p["usage_limits"][0]["type"] = "unlimited"
    p["pricing"]["currency"] = "DOLLAR"
    p["models"][0]["access_type"] = "none"
    m = copy.deepcopy(doc["models"][0])
    m["benchmarks"][0]["score"] = 500
    (folder / "bad.json").write_text(json.dumps({**doc, "plans": [p], "models": [m]}))
    found = {r.path for r in D.validation_problems(D.read_documents(spark, str(folder))).collect()}
    assert found == {"plans[].usage_limits[].type", "plans[].pricing.currency", "plans[].models[].access_type", "models[].benchmarks[].score"}


def test_seed_is_idempotent(spark, folder, tmp_path):
    (folder / "zeta.json").write_text(json.dumps(provider("zeta", models=[{**model("m1"), "display_name": "Other"}], plans=[])))
    docs = D.read_documents(spark, str(folder))
    tables = TB.seed_tables(docs, as_of())
    root = str(tmp_path / "store")
    assert sorted(TB.write_seed(tables, root)) == sorted(tables)
    assert TB.write_seed(tables, root) == []
    models = spark.read.parquet(f"{root}/models")
    assert rows(models, "model_id", "display_name") == [("m1", "M1"), ("m2", "M2")]
    plans = spark.read.parquet(f"{root}/plans")
    assert rows(plans, "plan_id", "slug", "billing_interval", "effective_price", "status") == [
        ("acme-old", "old", "annual", 16.0, "inactive"), ("acme-pro", "pro", "annual", 16.0, "active"),
    ]
    assert rows(spark.read.parquet(f"{root}/source_pages"), "provider_id", "page_type") == [
        ("acme", "docs"), ("acme", "pricing"), ("zeta", "docs"), ("zeta", "pricing"),
    ]


def test_scores_file_table_and_fallback(spark, tmp_path):
    f = tmp_path / "scores.json"
    f.write_text(json.dumps({"observed_at": "2026-06-23", "source": "s", "scores": [
        {"modelId": "a", "intelligenceIndex": 50, "codingIndex": None, "speedTps": 150, "inputPrice": 1, "outputPrice": 2},
        {"modelId": "b", "intelligenceIndex": 40, "codingIndex": 30, "agenticIndex": 20, "speedTps": 900, "inputPrice": 1, "outputPrice": 2, "costPerTaskUsd": 0.5},
    ]}))
    raw = D.read_scores(spark, str(f))
    table = D.score_table(raw)
    assert rows(table, "model_id", "coding", "agentic", "speed") == [("a", 50.0, 50.0, 50.0), ("b", 30.0, 30.0, 100.0)]
    assert json.loads(table.where("model_id = 'a'").collect()[0].metrics_json) == {"costPerTaskUsd": None, "accessedDate": None}
    assert rows(D.scores_or_fallback(table, raw), "model_id", "speed") == [("a", 50.0), ("b", 100.0)]
    empty = D.scores_or_fallback(table.where("false"), raw)
    assert rows(empty, "model_id", "speed", "confidence") == [("a", None, "observed"), ("b", None, "observed")]


def test_required_tables(spark, tmp_path):
    with pytest.raises(TB.MissingTable):
        TB.read_table(spark, str(tmp_path / "none"))
    path = str(tmp_path / "t")
    spark.range(0).write.parquet(path)
    with pytest.raises(TB.MissingTable):
        TB.read_table(spark, path)
    assert TB.read_table(spark, path, allow_empty=True).count() == 0
    with pytest.raises(TB.MissingTable, match="rank"):
        TB.read_table(spark, path, required=["rank"], allow_empty=True)


def test_replace_date_and_appends(spark, tmp_path):
    path = str(tmp_path / "rank")
    day = F.lit("2026-06-01").cast("date")
    for n in (3, 2):
        TB.replace_date(spark.range(n), path, day)
    TB.replace_date(spark.range(5), path, F.lit("2026-06-02").cast("date"))
    assert rows(spark.read.parquet(path).groupBy("observed_date").count()) == [(dt.date(2026, 6, 1), 2), (dt.date(2026, 6, 2), 5)]
    log = str(tmp_path / "log")
    for _ in range(2):
        TB.append_new(spark.range(4), log, ["id"])
    assert spark.read.parquet(log).count() == 4


def test_run_completion_and_ledger(spark, tmp_path):
    t = dt.datetime(2026, 6, 1)
    run = spark.createDataFrame([(1, t, "running", None)], "run_id int, started_at timestamp_ntz, status string, finished_at timestamp_ntz")
    done = TB.complete_run(run, "success", F.lit(t + dt.timedelta(hours=1)).cast("timestamp_ntz"))
    assert rows(TB.current_runs(run.unionByName(done)), "run_id", "status") == [(1, "success")]
    path = str(tmp_path / "ledger")
    for i in range(7):
        kept = TB.append_run(run.select(F.lit(i).alias("run_id"), "started_at", "status"), path)
    assert sorted(r.run_id for r in kept.collect()) == [2, 3, 4, 5, 6]


def test_baseline_roll(spark, tmp_path):
    root, s = str(tmp_path / "base"), "plan_id string, price double"
    assert TB.roll_baseline(spark.createDataFrame([("a", 10.0)], s), root, "2026-06-01") is None
    moved = TB.roll_baseline(spark.createDataFrame([("a", 13.0)], s), root, "2026-06-02")
    assert rows(moved, "plan_id", "from_price", "to_price") == [("a", 10.0, 13.0)]
    again = TB.roll_baseline(spark.createDataFrame([("a", 13.0)], s), root, "2026-06-02")
    assert again.count() == 1


def test_publish(spark, folder, tmp_path):
    docs = D.load_providers(spark, str(folder), as_of())
    root = str(tmp_path / "api")
    for _ in range(2):
        TB.publish(docs, root, "2026-06-23")
    found = TB.published(spark, root)
    assert rows(found["plans"], "plan_id", "effective_monthly_usd") == [("acme-pro", 16.0)]
    for name in ("plans", "models", "methodology"):
        assert TB.shape_problems(found[name], name) == []
    assert TB.shape_problems(spark.range(1), "plans") == ["plan_id", "plan_name", "provider_id", "provider_name"]


def test_published_versions_switch_at_once(spark, tmp_path):
    root = str(tmp_path / "api")
    with pytest.raises(TB.MissingTable):
        TB.published(spark, root)
    frame = lambda n: {"a": spark.range(n), "b": spark.range(n, 2 * n)}
    first = TB.commit_version(spark, root, frame(2))
    opened = TB.published(spark, root)
    tables = frame(3)
    broken = {**tables, "b": spark.range(3).select(F.raise_error(F.lit("lost")).alias("id"))}
    with pytest.raises(Exception, match="lost"):
        TB.commit_version(spark, root, broken)
    assert TB.manifest(spark, root)["version"] == first and TB.published(spark, root)["a"].count() == 2
    second = TB.commit_version(spark, root, tables)
    assert {k: d.count() for k, d in TB.published(spark, root).items()} == {"a": 3, "b": 3}
    # the earlier version is still whole for whoever opened it, and the failed one is gone
    assert {k: d.count() for k, d in opened.items()} == {"a": 2, "b": 2}
    assert {p.name for p in (tmp_path / "api" / "versions").iterdir()} == {first, second}
    TB.commit_version(spark, root, frame(1))
    assert first not in {p.name for p in (tmp_path / "api" / "versions").iterdir()}


def test_readers_during_a_publish_see_one_version(spark, tmp_path):
    """A reader thread polls while versions are published: both tables always come from one of them."""
    root, stop, seen = str(tmp_path / "api"), threading.Event(), []
    TB.commit_version(spark, root, {"a": spark.range(1), "b": spark.range(1)}, keep=9)

    def read():
        while not stop.is_set():
            found = TB.published(spark, root)
            seen.append((found["a"].count(), found["b"].count()))

    reader = threading.Thread(target=read)
    reader.start()
    for n in (2, 3, 4):
        TB.commit_version(spark, root, {"a": spark.range(n), "b": spark.range(n)}, keep=9)
    stop.set()
    reader.join()
    assert seen and all(a == b for a, b in seen)


def test_publish_estimates(spark, tmp_path):
    est = spark.createDataFrame([(1, 1, 5.0), (1, 2, None)], "plan_id int, model_id int, value_score double")
    out = TB.publish_estimates(est, spark.range(3), str(tmp_path / "e")).collect()[0]
    assert (out.estimates, out.plans, out.scored, out.scores) == (2, 1, 1, 3)


def page_frame(spark, versions):
    data = [(f"k{i}", "acme", u, kind, html, dt.datetime(2026, 6, 1 + i), ok) for i, (u, kind, html, ok) in enumerate(versions)]
    return spark.createDataFrame(data, "page_key string, provider_id string, source_url string, page_type string, html string, observed_at timestamp_ntz, allowed boolean")


def test_corpus_run_first_unchanged_changed_forced(spark):
    names = spark.createDataFrame([(1, "Acme One", 1)], "model_id bigint, display_name string, ord bigint")
    empty = spark.createDataFrame([], "provider_id string, source_url string, observed_at timestamp_ntz, snapshot_id int, content_hash string")
    html = "<p>Acme One: $20/mo, 50 messages per day</p>"
    pages = page_frame(spark, [("u1", "pricing", html, True), ("u2", "models", html, True), ("u3", "pricing", html, False)])
    first = process_pages(pages, empty, names)
    assert tuple(first.summary.collect()[0]) == (2, 1, 2, 1, 1, 1)
    stored = first.snapshots.withColumn("snapshot_id", F.lit(1))
    again = process_pages(pages, stored, names)
    assert tuple(again.summary.collect()[0]) == (2, 1, 0, 0, 0, 0)
    assert [r.extracted_text for r in again.snapshots.collect()] == [None, None]
    forced = process_pages(pages, stored, names, force=True)
    assert forced.summary.collect()[0].changed == 2
    note = json.loads(first.snapshots.where("page_key = 'k0'").collect()[0].notes)
    assert "1 model mention(s) found" in note["assumptions"] and note["footnotes"] == []


def test_change_stream_equals_batch(spark, tmp_path):
    snaps = Views(spark, DATA).snapshot.drop("extracted_text")
    src, root = str(tmp_path / "src"), str(tmp_path / "out")
    ordered = snaps.orderBy("observed_at").withColumn("part", F.ntile(3).over(W.orderBy("observed_at")))
    for p in (1, 2, 3):
        ordered.where(f"part = {p}").drop("part").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = S.run_change_stream(stream, root)
        q.awaitTermination()
    from tollgauge.operators.history import content_changes

    assert rows(spark.read.parquet(f"{root}/changes"), "snapshot_id", "changed") == rows(content_changes(snaps), "snapshot_id", "changed")


def test_ingest_drops_replays(spark, tmp_path):
    snaps = Views(spark, DATA).snapshot.drop("extracted_text").limit(50).cache()
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for _ in range(2):
        snaps.coalesce(1).write.mode("append").parquet(src)
    stream = S.ingest_once(spark.readStream.schema(snaps.schema).parquet(src))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 50


def test_page_run_keeps_compressed_columns_and_hashes_stay_behind_the_join(spark):
    """Reads of one table touch its columns only, no hash travels with a body, and stored hashes of any form compare as before."""
    import hashlib

    from tollgauge.operators.history import changed_now

    bodies = ["a", "b", "c", "d", "e"]
    hashes = [hashlib.sha256(b.encode()).hexdigest() for b in bodies]
    stored = [hashes[0], hashes[1].upper(), None, hashes[3] + "\n", hashes[0]]
    when = dt.datetime(2026, 6, 1)
    pages = spark.createDataFrame([(f"k{i}", "p", f"u{i}", "pricing", b, when, True) for i, b in enumerate(bodies)], "page_key string, provider_id string, source_url string, page_type string, html string, observed_at timestamp_ntz, allowed boolean")
    history = spark.createDataFrame([("p", f"u{i}", when - dt.timedelta(1), 1, h) for i, h in enumerate(stored)], "provider_id string, source_url string, observed_at timestamp_ntz, snapshot_id int, content_hash string")
    old = changed_now(pages.withColumn("content_hash", F.sha2("html", 256)), history)
    new = changed_now(pages, history, F.sha2("html", 256))
    assert rows(new, "page_key", "content_hash", "changed") == rows(old, "page_key", "content_hash", "changed")
    assert [r[0] for r in rows(new, "changed", "page_key")] == [False, True, True, True, True]
    run = process_pages(pages, history, spark.createDataFrame([(1, "Acme", 1)], "model_id bigint, display_name string, ord bigint"))
    plan = run.snapshots.select("page_key", "content_hash")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "prices" not in plan
    assert [r.extracted_text for r in run.snapshots.orderBy("page_key").collect()] == [None, "b", "c", "d", "e"]


def test_corpus_pages_travel_as_numbers(spark, tmp_path, monkeypatch):
    """Keys and bodies are made behind the exchanges, and keys are told apart whatever is null or comes twice."""
    from tollgauge.plans import crawl
    from tollgauge.queries import quality

    lines = [(1, 2, 3, 4, 5.5, "A", "F"), (1, 2, 3, 4, 5.0, "A", "F"), (1, 2, 3, 4, 5.5, "N", "O"), (1, 2, 3, None, 5.5, "A", "O"), (1, 2, None, 3, 5.5, "A", "O"), (1, None, 2, 3, 5.5, "R", "O")]
    lines += [(1, 2, 3, 4, None, "A", "F"), (1, 2, 3, 4, None, "N", "O"), (2, 2, 3, 4, None, "A", "F"), (2, 7, 3, 4, -5.5, None, None), (2, 6, 3, 4, 5.5, "A", "F"), (None, 1, 1, 1, 1.0, "A", "F"), (9, 1, 1, 1, 1.0, "A", "F")]
    orders = [(1, 2013.9), (1, 13.0), (1, 40.0), (2, None), (2, 1999.0), (None, 5.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(orders, "o_orderkey bigint, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))

    def text(line, price):
        if price is None or line[4] is None:
            return None
        billing = {0: "/mo", 1: " per year"}.get(None if line[1] is None else line[1] % 3, "")
        kind = {"A": " messages per day", "N": " credits/month"}.get(line[5], "x more usage")
        close = ". Free tier available, limits reset every 24 hours." if line[6] == "F" else ". Heavy use is throttled; usage limits apply and vary, capped by model."
        return f"Plan costs ${math.floor(price) % 2000}{billing}, {math.floor(line[4])}{kind}{close}"

    joined = [(line, text(line, price)) for line in lines for key, price in orders if key is not None and key == line[0]]
    want = {("/".join(str(x) for x in (*line[:4], t) if x is not None), None if t is None else f"<div><p>{t}</p></div>", None if t is None else "$13" not in t) for line, t in joined}
    v = Views(spark, str(tmp_path))
    assert rows(v.offer_text.select("l_orderkey", F.coalesce("text", F.lit("")))) == sorted((line[0], t or "") for line, t in joined)
    plans, filed = [], crawl.filed

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return filed(df)

    monkeypatch.setattr(crawl, "filed", watched)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages, stored = quality.corpus(v)
        found = [(r.page_key, r.html, r.allowed) for r in pages.collect()]
        assert len(found) == len(want) < len(joined) and set(found) == want
        assert {r.source_url for r in stored.collect()} == {k for k, html, _ in want if html and "throttled" in html}
        run = process_pages(pages, stored, quality.names(spark))
        assert {r.page_key for r in run.snapshots.collect()} == {k for k, _, allowed in want if allowed}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin [provider_id" in plans[0]
    assert not re.search(r"hashpartitioning\((page_key|source_url|provider_id)#", plans[0])


def test_an_address_that_is_the_key_is_stored_once(spark):
    names = spark.createDataFrame([(1, "Acme", 1)], "model_id bigint, display_name string, ord bigint")
    empty = spark.createDataFrame([], "provider_id string, source_url string, observed_at timestamp_ntz, snapshot_id int, content_hash string")
    pages = page_frame(spark, [(u, "pricing", "<p>Acme: $20/mo</p>", True) for u in ("k0", "u1", None, "k3", "")])
    run = process_pages(pages, empty, names)
    assert {r.page_key: r.source_url for r in run.snapshots.collect()} == {"k0": "k0", "k1": "u1", "k2": None, "k3": "k3", "k4": ""}
    files = spark.read.parquet(*run.snapshots.inputFiles())
    assert {r.page_key: r.source_url for r in files.collect()} == {"k0": None, "k1": "u1", "k2": None, "k3": None, "k4": ""}
