"""Data-quality, integrity and corpus-run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgauge.operators import quality as QC
from tollgauge.plans.crawl import process_pages
from tollgauge.plans.rankings import union_all
from tollgauge.queries import history as HQ
from tollgauge.queries.registry import query
from tollgauge.queries.sql_views import num_text, sql
from tollgauge.queries.text import _PRICE, KEYS, _limits_sql, _readable, placed_views
from tollgauge.queries.text import names as benchmark_names
from tollgauge.sources.views import Views, as_of, offer_words

DAY = "2001-09-10"

_PROV = """SELECT CAST(n_nationkey AS BIGINT) AS provider_id, d.last_verified, CASE WHEN r_name <> 'ASIA' THEN 'https://' || lower(n_name) || '.example' END AS pricing_url,
    CASE r_name WHEN 'AFRICA' THEN 'observed' WHEN 'AMERICA' THEN 'assumed' WHEN 'ASIA' THEN 'stale' WHEN 'EUROPE' THEN 'unknown' ELSE 'inferred' END AS confidence,
    1895 + n_nationkey * 6 AS founded_year, CASE WHEN r_name = 'EUROPE' THEN 'na' ELSE 'NA' END AS headquarters_country
    FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, CAST(max(o_orderdate) AS DATE) AS last_verified FROM orders
    JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey) d ON d.c_nationkey = n_nationkey"""


def providers(v: Views):
    r = F.col("r_name")
    n = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = v.table("orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    c = v.table("customer").select("c_custkey", "c_nationkey")
    seen = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.max("d").alias("last_verified"))
    conf = F.when(r == "AFRICA", "observed").when(r == "AMERICA", "assumed").when(r == "ASIA", "stale").when(r == "EUROPE", "unknown")
    return n.join(seen, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_nationkey").cast("bigint").alias("provider_id"), "last_verified",
        F.when(r != "ASIA", F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example"))).alias("pricing_url"),
        conf.otherwise("inferred").alias("confidence"), (F.col("n_nationkey") * 6 + 1895).alias("founded_year"),
        F.when(r == "EUROPE", "na").otherwise("NA").alias("headquarters_country"),
    )


_QPLAN = "SELECT *, CASE WHEN tier = 'team' THEN 'usd' ELSE 'USD' END AS currency, monthly_usd - 6 AS shifted FROM plan"
_QMODEL = """SELECT m.*, s_acctbal AS context_length_k, CASE WHEN s_acctbal > 8000 THEN 'unknown' WHEN s_acctbal > 6000 THEN 'stale'
    WHEN s_acctbal > 4000 THEN 'assumed' ELSE 'observed' END AS confidence FROM model m JOIN supplier ON s_suppkey = m.model_id"""


def q_plans(v: Views):
    return v.plan.withColumns(
        {"currency": F.when(F.col("tier") == "team", "usd").otherwise("USD"), "shifted": F.col("monthly_usd") - 6}
    )


def q_models(v: Views):
    bal = F.col("s_acctbal")
    conf = F.when(bal > 8000, "unknown").when(bal > 6000, "stale").when(bal > 4000, "assumed").otherwise("observed")
    return v.model.join(v.table("supplier").select(F.col("s_suppkey").alias("model_id"), "s_acctbal"), "model_id").select(
        "model_id", "provider_id", "display_name", "is_active", bal.alias("context_length_k"), conf.alias("confidence")
    )


# One cost record per event; error events carry truncated JSON.
_COST = """SELECT user_id AS model_id, event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 20 AS cost, CAST(ts AS DATE) AS d,
    event_type = 'error' AS broken FROM events"""


def cost_rows(v: Views):
    k = F.get_json_object("props", "$.k").cast("bigint") * 20
    good = F.concat(F.lit('{"costPerTaskUsd": '), k.cast("string"), F.lit(', "accessedDate": "'), F.col("ts").cast("date").cast("string"), F.lit('"}'))
    return v.table("events").select(
        F.col("user_id").alias("model_id"), "event_id", F.when(F.col("event_type") == "error", F.lit('{"costPerTaskUsd": ')).otherwise(good).alias("metrics")
    )


def _iss(check: str, sev: str, prov: str, plan: str, model: str, field: str, msg: str, source: str) -> str:
    return f"""SELECT '{check}' AS check_id, {sev} AS severity, CAST({prov} AS VARCHAR) AS provider_id, CAST({plan} AS VARCHAR) AS plan_id,
        CAST({model} AS VARCHAR) AS model_id, {field} AS field, {msg} AS message FROM {source}"""


_AGE = f"(DATE '{DAY}' - last_verified)"
_N = "NULL"
_CB = "CASE WHEN confidence = 'unknown' THEN 'error' ELSE 'warning' END"
_CM = """CASE WHEN confidence = 'unknown' THEN ' has confidence "unknown"' ELSE ' has low confidence: "' || confidence || '"' END"""
_ISSUES = {
    "i1": _iss("provider-stale-source", "'warning'", "provider_id", _N, _N, "'last_verified'",
               f"""'Provider "' || provider_id || '" last verified ' || {_AGE} || ' days ago (threshold: 30 days)'""", f"prov WHERE {_AGE} > 30"),
    "i2": _iss("plan-no-price", "CASE WHEN v.pricing_url IS NOT NULL THEN 'error' ELSE 'warning' END", "p.provider_id", "plan_id", _N, "'pricing.monthly_usd'",
               """'Plan "' || plan_id || '" has no monthly price (null)'""",
               "(SELECT plan_id, provider_id, CASE WHEN tier = 'free' THEN 'api' ELSE 'pro' END AS tier, monthly_usd FROM plan) p LEFT JOIN prov v ON v.provider_id = p.provider_id WHERE monthly_usd IS NULL AND tier <> 'api'"),
    "i3": _iss("plan-no-usage-estimate", "'warning'", "p.provider_id", "p.plan_id", _N, _N,
               """'Plan "' || p.plan_id || CASE WHEN k IS NULL THEN '" has no usage limits defined' ELSE '" usage limits are all "unknown" type' END""",
               """plan p LEFT JOIN (SELECT plan_id, max(limit_type <> 'unknown') AS k FROM plan_limit GROUP BY plan_id) l
                  ON l.plan_id = p.plan_id WHERE NOT coalesce(k, false) AND NOT (k IS NULL AND p.plan_id IN (SELECT plan_id FROM plan_model WHERE model_id IN (SELECT model_id FROM score WHERE wmq0)))"""),
    "i4": _iss("unlimited-coding-limit", "'error'", _N, "plan_id", _N, "'usage_limits.type'",
               """'Plan "' || plan_id || '" declares a banned "unlimited" coding limit — replace with a real published limit or "unknown".'""",
               "(SELECT plan_id, CASE WHEN limit_type = 'messages_per_period' AND limit_value = 50 THEN 'unlimited' ELSE limit_type END AS limit_type FROM plan_limit) WHERE limit_type = 'unlimited'"),
    "i5": _iss("model-no-aa-mapping", "'warning'", "'unknown'", _N, "model_id", _N, """'Model "' || model_id || '" has no AA score mapping in DB'""",
               "model WHERE is_active AND model_id NOT IN (SELECT model_id FROM score WHERE intelligence IS NOT NULL)"),
    "i6a": _iss("aa-cost-per-task-malformed", "'warning'", "'unknown'", _N, "model_id", _N,
                """'Model "' || model_id || '" price_efficiency_metrics_json is not valid JSON'""", "cost_row WHERE broken"),
    "i6b": _iss("aa-cost-per-task-bounds", "'error'", "'unknown'", _N, "model_id", _N,
                f"""'Model "' || model_id || '" cost-per-task $' || {num_text("cost")} || ' out of bounds [$0.0001, $1000]'""",
                "cost_row WHERE NOT broken AND (cost < 0.0001 OR cost > 1000)"),
    "i6c": _iss("aa-cost-per-task-stale", "'warning'", "'unknown'", _N, "model_id", _N,
                """'Model "' || model_id || '" cost-per-task observed ' || (DATE '2024-04-10' - d) || 'd ago (>90d) — refresh from AA'""",
                "cost_row WHERE NOT broken AND DATE '2024-04-10' - d > 90"),
    "i7": _iss("ranking-stale-data", "'warning'", "provider_id", _N, _N, "'last_verified'",
               f"""'Rankings may include stale data from "' || provider_id || '" (last verified ' || {_AGE} || ' days ago)'""", f"prov WHERE {_AGE} > 30"),
    "i8a": _iss("confidence-below-threshold", _CB, "provider_id", _N, _N, "'provenance.confidence'", f"""'Provider "' || provider_id || '"' || {_CM}""",
                "prov WHERE confidence IN ('unknown', 'assumed', 'stale')"),
    "i8b": _iss("confidence-below-threshold", _CB, "provider_id", _N, "model_id", "'models[].provenance.confidence'", f"""'Model "' || model_id || '"' || {_CM}""",
                "qmodel WHERE confidence IN ('unknown', 'assumed', 'stale')"),
    "i9a": _iss("impossible-values", "'error'", "provider_id", _N, _N, "'founded_year'",
                """'Provider "' || provider_id || '" has impossible founded_year: ' || founded_year""", "prov WHERE founded_year < 1900 OR founded_year > 2026"),
    "i9b": _iss("impossible-values", "'warning'", "provider_id", _N, _N, "'headquarters_country'",
                """'Provider "' || provider_id || '" has non-standard country code: "' || headquarters_country || '"'""", "prov WHERE headquarters_country = 'na'"),
    "i9c": _iss("impossible-values", "'error'", "provider_id", "plan_id", _N, "'pricing.monthly_usd'",
                f"""'Plan "' || plan_id || '" has negative price: $' || {num_text("shifted")}""", "qplan WHERE shifted < 0"),
    "i9d": _iss("impossible-values", "'warning'", "provider_id", "plan_id", _N, "'pricing.currency'",
                """'Plan "' || plan_id || '" has non-standard currency: "usd"'""", "qplan WHERE currency = 'usd'"),
    "i9e": _iss("impossible-values", "'error'", "provider_id", _N, "model_id", "'context_length_k'",
                f"""'Model "' || model_id || '" has context_length_k <= 0: ' || {num_text("context_length_k")}""", "qmodel WHERE context_length_k <= 0"),
    "i10": _iss("day-over-day-change", "'warning'", "split_part(slug, '-', 1)", "slug", _N, "'pricing.monthly_usd'",
                f"""'Plan "' || slug || '" price changed ' || printf('%.0f', abs((now_price - base_price) / base_price) * 100) || '% ($' || {num_text("base_price")}
                || ' → $' || {num_text("now_price")} || ')'""",
                "(SELECT plan_slug AS slug, monthly_usd AS base_price, annual_usd AS now_price FROM plan) WHERE base_price <> 0 AND abs((now_price - base_price) / base_price) > 0.19"),
    "i11": _iss("page-changed-no-extraction", "'warning'", "r.provider_id", _N, _N, _N,
                """'Source page changed but no extracted text recorded for "' || r.provider_id || '"'""",
                "run r LEFT JOIN snapshot s ON s.provider_id = r.provider_id AND s.source_url = r.source_url AND s.observed_at = r.observed_at WHERE change_detected AND s.extracted_text IS NULL"),
}
_ISSUES["i3"] = _ISSUES["i3"].replace("WHERE wmq0", "WHERE intelligence IS NOT NULL")
_SOURCES = {"prov": _PROV, "qplan": _QPLAN, "qmodel": _QMODEL, "cost_row": _COST, "run": HQ._RUN, **_ISSUES}
_NEED = ("plan", "plan_limit", "plan_model", "model", "score", "snapshot")
_ALL = " UNION ALL ".join(f"SELECT * FROM {k}" for k in _ISSUES)


def all_issues(v: Views):
    p, plans, models = providers(v), q_plans(v), q_models(v)
    scored = v.score.where(F.col("intelligence").isNotNull())
    # the largest message limit per period stands for an unlimited one
    endless = (F.col("limit_type") == "messages_per_period") & (F.col("limit_value") == 50)
    declared = v.limit.withColumn("limit_type", F.when(endless, "unlimited").otherwise(F.col("limit_type")))
    slug = v.plan.select(F.col("plan_slug").alias("plan_id"), "monthly_usd", "annual_usd")
    retiered = v.plan.withColumn("tier", F.when(F.col("tier") == "free", "api").otherwise("pro"))
    return union_all(
        [
            QC.old_providers(p, as_of(DAY)),
            QC.plans_without_price(retiered, p),
            QC.plans_without_usage(v.plan, v.limit, v.plan_model, scored),
            QC.banned_limits(declared),
            QC.unmapped_models(v.model, scored),
            QC.cost_problems(cost_rows(v), "metrics", as_of("2024-04-10")),
            QC.ranking_on_old_data(p, v.plan, as_of(DAY)),
            QC.weak_confidence(p, "Provider", "provenance.confidence"),
            QC.weak_confidence(models, "Model", "models[].provenance.confidence"),
            QC.impossible_values(p, plans.drop("monthly_usd").withColumnRenamed("shifted", "monthly_usd"), models),
            QC.price_jumps(
                slug.select("plan_id", F.col("annual_usd").alias("price")), slug.select("plan_id", F.col("monthly_usd").alias("price")), 0.19
            ),
            QC.silent_changes(HQ.runs(v), v.snapshot),
        ]
    )


@query("quality_issues", sql(_ALL, *_NEED, **_SOURCES))
def quality_issues(v: Views):
    return all_issues(v)


@query(
    "quality_summary",
    sql(
        f"""SELECT check_id, count(*) AS issues, max(severity = 'error') AS has_error, string_agg(DISTINCT severity, '/' ORDER BY severity) AS severities
            FROM ({_ALL}) GROUP BY check_id""",
        *_NEED, **_SOURCES,
    ),
)
def quality_summary(v: Views):
    return QC.summarize(all_issues(v))


@query(
    "quality_report",
    sql(
        f"""SELECT check_id, severity, count(*) AS shown FROM ({_ALL}) WHERE check_id IN (SELECT check_id FROM ({_ALL}) WHERE severity = 'error') GROUP BY ALL""",
        *_NEED, **_SOURCES,
    ),
)
def quality_report(v: Views):
    return QC.report(all_issues(v)).groupBy("check_id", "severity").agg(F.count("*").alias("shown"))


@query(
    "score_json_metrics",
    sql(
        """SELECT event_id, model_id, NOT broken AS well_formed, CASE WHEN NOT broken THEN cost END AS cost_per_task, CASE WHEN NOT broken THEN d END AS cost_date,
           least(100e0, floor(cost / 300e0 * 100 + 0.5)) AS speed_score FROM cost_row""",
        cost_row=_COST,
    ),
)
def score_json_metrics(v: Views):
    from tollgauge.functions.capacity import speed_score

    rows = cost_rows(v).join(
        v.table("events").select("event_id", (F.get_json_object("props", "$.k").cast("double") * 20).alias("tps")), "event_id"
    )
    return QC.cost_metrics(rows, "metrics").select(
        "event_id", "model_id", "well_formed", "cost_per_task", "cost_date", speed_score(F.col("tps")).alias("speed_score")
    )


@query(
    "integrity_checks",
    """SELECT 'lineitem.part' AS rule, count(*) AS rows FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
       UNION ALL SELECT 'events.supplier', count(*) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
       UNION ALL SELECT 'lineitem.key', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
       UNION ALL SELECT 'plan.row', count(*) FROM part WHERE p_type = 'MEDIUM'
       UNION ALL SELECT 'plan.id', count(*) FROM part WHERE length(CAST(p_partkey AS VARCHAR)) < 2
       UNION ALL SELECT 'model.id', count(*) FROM supplier WHERE length(CAST(s_suppkey AS VARCHAR)) < 2
       UNION ALL SELECT 'page.url', count(*) FROM pages WHERE NOT regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*://[^\\s/?#]+\\S*')
       UNION ALL SELECT 'ranking.type', count(*) FROM events WHERE length(event_type) < 2""",
)
def integrity_checks(v: Views):
    li = v.table("lineitem")
    plan_rows = v.plan.select(
        F.col("plan_id").cast("string").alias("id"), F.col("plan_slug").alias("slug"), "plan_name", F.lit("monthly").alias("billing_interval"),
        F.when(F.col("tier") == "team", "US").otherwise("USD").alias("currency"), F.lit(None).cast("string").alias("plan_url"),
    )
    plan_bad = QC.plan_row_problems(plan_rows)
    text_id = F.col("model_id").cast("string")
    model_rows = v.model.select(text_id.alias("id"), F.concat(F.lit("m"), text_id).alias("canonical_model_id"), "display_name")
    page_rows = v.table("pages").select(
        F.concat(F.lit("p-"), F.col("page_id").cast("string")).alias("id"), F.lit("slug").alias("slug"), F.lit("n").alias("name"),
        F.col("url").alias("website_url"), F.col("url").alias("pricing_url"), F.lit(None).cast("string").alias("docs_url"),
    )
    kinds = v.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("ranking_type"))

    def count(rule, df):
        return df.agg(F.count("*").alias("rows")).select(F.lit(rule).alias("rule"), "rows")

    return union_all(
        [
            count("lineitem.part", QC.orphans(li, "l_partkey", v.table("part"), "p_partkey")),
            count("events.supplier", QC.orphans(v.table("events"), "user_id", v.table("supplier"), "s_suppkey")),
            count("lineitem.key", QC.duplicates(li, ["l_orderkey", "l_linenumber"])),
            count("plan.row", plan_bad.where("path = 'currency'")),
            count("plan.id", plan_bad.where("path = 'id'")),
            count("model.id", QC.model_row_problems(model_rows).where("path = 'id'")),
            count("page.url", QC.provider_row_problems(page_rows).where("path = 'website_url'")),
            count("ranking.type", QC.ranking_row_problems(kinds)),
        ]
    )


@query(
    "provenance_census",
    sql(
        """SELECT path, confidence, count(*) AS records, min(accessed_date) AS oldest FROM (
           SELECT 'plans[].pricing.provenance' AS path, pricing_confidence AS confidence, accessed_date FROM plan
           UNION ALL SELECT 'plans[].usage_limits[].provenance', confidence, accessed_date FROM plan_limit
           UNION ALL SELECT 'models[].provenance', confidence, released_date FROM qmodel) GROUP BY ALL""",
        "plan", "plan_limit", qmodel=_QMODEL,
    ),
)
def provenance_census(v: Views):
    models = q_models(v).select("model_id", "confidence").join(v.model.select("model_id", F.col("released_date").alias("accessed_date")), "model_id")
    c = QC.provenance_census(v.plan, v.limit, models)
    return c.groupBy("path", "confidence").agg(F.count("*").alias("records"), F.min("accessed_date").alias("oldest"))


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES))
def table_counts(v: Views):
    return union_all([v.table(t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows") for t in TABLES])


@query(
    "enabled_pages",
    sql(
        r"""SELECT p.page_id, p.url, v.provider_id, v.provider_name, CASE WHEN contains(url, '/en/') THEN 'pricing' WHEN contains(url, '/fr/') THEN 'docs' ELSE 'models' END AS page_type
           FROM pages p JOIN provider v ON v.provider_id = p.page_id % 25 WHERE v.is_active AND NOT contains(url, '#')""",
        "provider",
    ),
)
def enabled_pages(v: Views):
    """Source pages that are enabled (no fragment in the address, active provider) with provider details."""
    url = F.col("url")
    kind = F.when(url.contains("/en/"), "pricing").when(url.contains("/fr/"), "docs").otherwise("models")
    p = v.table("pages").select("page_id", "url", (F.col("page_id") % 25).alias("provider_id"), kind.alias("page_type"))
    live = v.provider.where("is_active").select("provider_id", "provider_name")
    return p.where(~url.contains("#")).join(live, "provider_id").select("page_id", "url", "provider_id", "provider_name", "page_type")


# Corpus run: every offer text is a page; pages shipped before 1998 are already stored with the same hash.
_CORPUS = """SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || text AS page_key, * FROM offer_text"""


def corpus(v: Views):
    """(pages, stored snapshots) built from offer texts."""
    told = F.col("amount").isNotNull() & F.col("whole").isNotNull()
    numbers = F.array_compact(F.array(F.col("l_linenumber").cast("bigint"), "l_partkey", "l_suppkey"))
    # a key names its order and is the list of the other numbers there are and the text, so keys are told apart beside the order's
    # other lines, without being spelled out
    offers = v.offer.withColumns({c: F.when(told, F.col(c)) for c in ("amount", "whole", "wording")}).withColumn("numbers", numbers)
    keyed = offers.groupBy("l_orderkey", "numbers", "amount", "whole", "wording")
    distinct = keyed.agg(F.first(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("x")).select("l_orderkey", "x.*", "amount", "whole", "wording")
    # rows go to their address while they are numbers: keys, bodies and hashes are made behind the exchange, bodies behind the order
    key, text = F.concat_ws("/", *KEYS, offer_words()), offer_words()
    dealt = distinct.repartition("l_partkey", key).withColumn("page_key", key)
    kind = F.when(F.col("l_linenumber") <= 3, "pricing").when(F.col("l_linenumber") <= 5, "docs").otherwise("models")
    columns = [
        "page_key", F.col("l_partkey").alias("provider_id"), F.col("page_key").alias("source_url"), kind.alias("page_type"),
        F.concat(F.lit("<div><p>"), text, F.lit("</p></div>")).alias("html"), F.lit("2001-08-02").cast("timestamp_ntz").alias("observed_at"),
        (~text.contains("$13")).alias("allowed"),
    ]
    pages = dealt.sortWithinPartitions("l_partkey", "page_key").select(*columns)
    stored = dealt.select(*columns).where(F.col("html").contains("throttled")).select(
        "provider_id", "source_url", F.lit("2001-08-01").cast("timestamp_ntz").alias("observed_at"), F.lit(1).alias("snapshot_id"),
        F.sha2("html", 256).alias("content_hash"),
    )
    return pages, stored


def names(spark):
    return spark.createDataFrame([(1, "Free tier", 1), (2, "tier", 2), (3, "usage", 3)], "model_id bigint, display_name string, ord bigint")


@query(
    "corpus_extract",
    sql(
        r"""SELECT (SELECT count(DISTINCT page_key) FROM corp WHERE NOT contains(text, '$13')) AS processed,
             (SELECT count(DISTINCT page_key) FROM corp WHERE contains(text, '$13')) AS skipped, count(*) AS changed,
             CAST(sum(CASE WHEN l_linenumber <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS prices,
             (SELECT count(*) FROM limit_hit h JOIN live l ON l.page_key = h.page_key AND l.l_linenumber <= 5) AS limits,
             CAST(sum(CASE WHEN l_linenumber <= 5 THEN len(regexp_extract_all(text, '\bfree tier\b|\busage\b', 0, 'i')) ELSE 0 END) AS BIGINT) AS mentions
           FROM live""",
        "live", "limit_hit", "offer_text", corp=_CORPUS,
        live="SELECT DISTINCT page_key, l_linenumber, text FROM corp WHERE NOT contains(text, '$13') AND NOT contains(text, 'throttled')",
        **_limits_sql("page_key", "live"),
    ),
)
def corpus_extract(v: Views):
    pages, stored = corpus(v)
    return process_pages(pages, stored, names(v.spark)).summary


@query(
    "corpus_snapshots",
    sql(
        r"""SELECT page_key, sha256('<div><p>' || text || '</p></div>') AS content_hash, CASE WHEN NOT contains(text, 'throttled') THEN text END AS extracted_text
           FROM (SELECT DISTINCT page_key, text FROM corp) WHERE NOT contains(text, '$13')""",
        "offer_text", corp=_CORPUS,
    ),
)
def corpus_snapshots(v: Views):
    pages, stored = corpus(v)
    return process_pages(pages, stored, names(v.spark)).snapshots.select("page_key", "content_hash", "extracted_text")


# The same run over the pages table: addresses with a fragment are not allowed, those with a query are stored already, English pages
# are price lists, French ones documentation; names come from the benchmark table.
_LIVE = f"""SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'pricing' WHEN contains(url, '/fr/') THEN 'docs' ELSE 'models' END AS page_type,
    {_readable("html")} AS text FROM pages WHERE NOT contains(url, '#') AND NOT contains(url, '?')"""


def page_run(v: Views):
    url = F.col("url")
    kind = F.when(url.contains("/en/"), "pricing").when(url.contains("/fr/"), "docs").otherwise("models")
    pages = v.texts("pages", "page_id", "url", "html").select(
        F.col("page_id").alias("page_key"), F.lit(0).alias("provider_id"), F.concat_ws(" ", "page_id", "url").alias("source_url"), kind.alias("page_type"), "html",
        F.lit("2001-08-02").cast("timestamp_ntz").alias("observed_at"), (~url.contains("#")).alias("allowed"), url.contains("?").alias("stored"),
    )
    history = pages.where("stored").select(
        "provider_id", "source_url", F.lit("2001-08-01").cast("timestamp_ntz").alias("observed_at"), F.lit(1).alias("snapshot_id"), F.sha2("html", 256).alias("content_hash")
    )
    return process_pages(pages.drop("stored"), history, benchmark_names(v))


@query(
    "corpus_pages",
    sql(
        f"""SELECT 'processed' AS counter, count(*) AS n FROM pages WHERE NOT contains(url, '#') UNION ALL SELECT 'skipped', count(*) FROM pages WHERE contains(url, '#')
           UNION ALL SELECT 'errors', count(*) FROM pages WHERE html IS NULL AND NOT contains(url, '#') UNION ALL SELECT 'changed', count(*) FROM live
           UNION ALL SELECT 'prices', count(*) FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '{_PRICE}', 0, 'i'))) FROM live WHERE page_type = 'pricing')
           UNION ALL SELECT 'limits', count(*) FROM limit_hit UNION ALL SELECT 'mentions', count(*) FROM won""",
        "limit_hit", live=_LIVE, disclosed="SELECT page_id, text FROM live WHERE page_type IN ('pricing', 'docs')", **_limits_sql("page_id", "disclosed"),
        **placed_views("disclosed", "page_id"),
    ),
)
def corpus_pages(v: Views):
    """All counters of a run over the pages."""
    found = page_run(v).counters
    return v.spark.createDataFrame(list(found.items()), "counter string, n bigint")


@query(
    "corpus_page_mentions",
    sql(
        "SELECT p.page_id AS page_key, p.model_id, p.raw, p.pos FROM place p JOIN won ON won.page_id = p.page_id AND won.w.m = p.model_id AND won.w.pos = p.pos",
        "place", "won", live=_LIVE, disclosed="SELECT page_id, text FROM live WHERE page_type IN ('pricing', 'docs')", **placed_views("disclosed", "page_id"),
    ),
)
def corpus_page_mentions(v: Views):
    """Names claimed on changed price lists and documentation."""
    return page_run(v).mentions.select("page_key", "model_id", "raw", F.col("pos").cast("bigint").alias("pos"))
