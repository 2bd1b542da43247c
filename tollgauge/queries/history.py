"""History, freshness and run-ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgauge.functions import basics as B
from tollgauge.operators import history as H
from tollgauge.operators.ordering import previous_value
from tollgauge.plans import rankings as R
from tollgauge.queries import ranking as Q
from tollgauge.queries.registry import query
from tollgauge.queries.sql_views import AS_OF, SCORES_AS_OF, effective, sql
from tollgauge.sources.views import SCORES_AS_OF as SCORES_DAY
from tollgauge.sources.views import Views, as_of


@query(
    "content_changed",
    sql(
        """SELECT provider_id, source_url, snapshot_id, content_hash, lag(content_hash) OVER w IS NULL OR lag(content_hash) OVER w <> content_hash AS changed
           FROM snapshot WINDOW w AS (PARTITION BY provider_id, source_url ORDER BY observed_at, snapshot_id)""",
        "snapshot",
    ),
)
def content_changed(v: Views):
    return H.content_changes(v.snapshot).select("provider_id", "source_url", "snapshot_id", "content_hash", "changed")


@query(
    "incoming_page_changes",
    sql(
        """SELECT n.provider_id, n.source_url, n.snapshot_id, s.content_hash IS NULL OR s.content_hash <> n.content_hash AS changed
           FROM (SELECT * FROM snapshot WHERE observed_at >= TIMESTAMP '2024-01-21') n LEFT JOIN (SELECT * FROM snapshot
           WHERE observed_at < TIMESTAMP '2024-01-21' QUALIFY row_number() OVER (PARTITION BY provider_id, source_url
           ORDER BY observed_at DESC, snapshot_id DESC) = 1) s ON s.provider_id = n.provider_id AND s.source_url = n.source_url""",
        "snapshot",
    ),
)
def incoming_page_changes(v: Views):
    cut = F.lit("2024-01-21").cast("timestamp_ntz")
    s = v.snapshot
    out = H.changed_now(s.where(s.observed_at >= cut), s.where(s.observed_at < cut))
    return out.select("provider_id", "source_url", "snapshot_id", "changed")


@query(
    "latest_snapshots",
    sql(
        """SELECT provider_id, source_url, snapshot_id, content_hash FROM snapshot QUALIFY row_number() OVER (
           PARTITION BY provider_id, source_url ORDER BY observed_at DESC, snapshot_id DESC) = 1""",
        "snapshot",
    ),
)
def latest_snapshots(v: Views):
    return H.latest_snapshot(v.snapshot, H.PAGE).select("provider_id", "source_url", "snapshot_id", "content_hash")


_MOVES = """SELECT b.plan_id, b.price AS from_price, c.price AS to_price, abs((c.price - b.price) / b.price) AS change FROM
    (SELECT plan_id, price FROM price_history WHERE observed_date < DATE '2000-01-01'
      QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY observed_date DESC, snapshot_id DESC) = 1) b
    JOIN (SELECT plan_id, price FROM price_history
      QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY observed_date DESC, snapshot_id DESC) = 1) c ON c.plan_id = b.plan_id
    WHERE b.price <> 0 AND abs((c.price - b.price) / b.price) > 0.2"""


@query("price_vs_baseline", sql(_MOVES, "price_history"))
def price_vs_baseline(v: Views):
    h = v.price_history
    baseline = H.latest_snapshot(h.where(F.col("observed_date") < F.lit("2000-01-01").cast("date")), ["plan_id"], "observed_date")
    current = H.latest_snapshot(h, ["plan_id"], "observed_date")
    return H.price_moves(current, baseline)


@query(
    "price_day_over_day",
    sql(
        """SELECT plan_id, snapshot_id, observed_date, from_price, price AS to_price, abs((price - from_price) / from_price) AS change FROM (
           SELECT *, lag(price) OVER (PARTITION BY plan_id ORDER BY observed_date, snapshot_id) AS from_price FROM price_history)
           WHERE from_price <> 0 AND abs((price - from_price) / from_price) > 0.2""",
        "price_history",
    ),
)
def price_day_over_day(v: Views):
    """Every price in the history against the one before it."""
    prev = previous_value(v.price_history, ["plan_id"], ["observed_date", "snapshot_id"], ["price"])
    known = prev.where(F.col("prev_price") != 0)
    change = F.abs((F.col("price") - F.col("prev_price")) / F.col("prev_price"))
    return known.withColumn("change", change).where(F.col("change") > 0.2).select(
        "plan_id", "snapshot_id", "observed_date", F.col("prev_price").alias("from_price"), F.col("price").alias("to_price"), "change"
    )


@query(
    "sparkline_scaled",
    sql(
        """SELECT h.plan_id, snapshot_id, price, (price - low) / CASE WHEN high = low THEN 1e0 ELSE high - low END AS scaled, rising FROM price_history h
           JOIN (SELECT plan_id, min(price) AS low, max(price) AS high, count(*) AS n,
             arg_max(price, (observed_date, snapshot_id)) >= arg_min(price, (observed_date, snapshot_id)) AS rising
             FROM price_history GROUP BY plan_id) b ON b.plan_id = h.plan_id WHERE n >= 3""",
        "price_history",
    ),
)
def sparkline_scaled(v: Views):
    return H.trend(v.price_history, ["plan_id"], ["observed_date", "snapshot_id"], "price").select(
        "plan_id", "snapshot_id", "price", "scaled", "rising"
    )


@query(
    "snapshots_since",
    sql(
        "SELECT provider_id, source_url, snapshot_id, CAST(observed_at AS DATE) AS observed_date FROM snapshot WHERE observed_at >= TIMESTAMP '2024-01-15'",
        "snapshot",
    ),
)
def snapshots_since(v: Views):
    recent = H.since(v.snapshot, "observed_at", F.lit("2024-01-15").cast("timestamp_ntz"))
    return recent.select("provider_id", "source_url", "snapshot_id", F.col("observed_at").cast("date").alias("observed_date"))


@query(
    "price_history_since",
    sql("SELECT plan_id, snapshot_id, observed_date, price FROM price_history WHERE observed_date >= DATE '2000-06-01'", "price_history"),
)
def price_history_since(v: Views):
    return H.since(v.price_history, "observed_date", F.lit("2000-06-01").cast("date")).select(
        "plan_id", "snapshot_id", "observed_date", "price"
    )


# Runs: one event is one crawl run of (user, event type); errors fail, signups are still running.
_RUN = """SELECT event_id AS run_id, user_id AS provider_id, event_type AS source_url, ts AS started_at, ts AS observed_at,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'running' ELSE 'success' END AS status,
    event_type <> 'signup' AND value > 20 AS change_detected, CAST(floor(value * 1000) AS BIGINT) AS duration_ms FROM events"""


def runs(v: Views):
    kind = F.col("event_type")
    return v.table("events").select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("provider_id"), kind.alias("source_url"),
        F.col("ts").alias("started_at"), F.col("ts").alias("observed_at"),
        F.when(kind == "error", "error").when(kind == "signup", "running").otherwise("success").alias("status"),
        ((kind != "signup") & (F.col("value") > 20)).alias("change_detected"),
        F.floor(F.col("value") * 1000).alias("duration_ms"),
    )


@query(
    "latest_finished_runs",
    sql(
        """SELECT provider_id, run_id, status FROM run WHERE status <> 'running' QUALIFY row_number() OVER (
           PARTITION BY provider_id ORDER BY started_at DESC, run_id DESC) = 1""",
        run=_RUN,
    ),
)
def latest_finished_runs(v: Views):
    return H.latest_finished_run(runs(v), ["provider_id"]).select("provider_id", "run_id", "status")


@query(
    "changed_without_text",
    sql(
        """SELECT r.provider_id, r.source_url, r.run_id FROM run r LEFT JOIN snapshot s ON s.provider_id = r.provider_id
           AND s.source_url = r.source_url AND s.observed_at = r.observed_at WHERE change_detected AND s.extracted_text IS NULL""",
        "snapshot", run=_RUN,
    ),
)
def changed_without_text(v: Views):
    return H.changed_without_text(runs(v), v.snapshot).select("provider_id", "source_url", "run_id")


@query(
    "run_ledger",
    sql(
        """SELECT 'newest' AS part, run_id, status AS detail FROM (SELECT * FROM run ORDER BY started_at DESC, run_id DESC LIMIT 5)
           UNION ALL SELECT 'problem', run_id, 'durationMs must be >= 0' FROM led WHERE duration_ms < 0
           UNION ALL SELECT 'problem', run_id, 'status not allowed' FROM led WHERE status NOT IN ('ok', 'changed', 'failed')
           UNION ALL SELECT 'log', run_id, CASE status WHEN 'error' THEN 'error' ELSE 'warn' END FROM run WHERE status IN ('error', 'running')""",
        run=_RUN,
        led="""SELECT run_id, CASE status WHEN 'success' THEN 'ok' WHEN 'error' THEN 'failed' ELSE status END AS status,
          duration_ms - 5000 AS duration_ms FROM run""",
    ),
)
def run_ledger(v: Views):
    r = runs(v)
    newest = H.newest_runs(r).select(F.lit("newest").alias("part"), "run_id", F.col("status").alias("detail"))
    led = r.select(
        "run_id", "started_at", F.col("started_at").alias("completed_at"), (F.col("duration_ms") - 5000).alias("duration_ms"),
        F.lit(0).alias("low_confidence"), (F.col("status") == "success").alias("success"),
        F.when(F.col("status") == "success", "ok").when(F.col("status") == "error", "failed").otherwise(F.col("status")).alias("status"),
    )
    problems = H.run_problems(led).select(F.lit("problem").alias("part"), "run_id", F.col("problem").alias("detail"))
    level = F.when(F.col("status") == "error", "error").when(F.col("status") == "running", "warn").otherwise("info")
    logs = H.at_level(r.withColumn("level", level), "warn").select(F.lit("log").alias("part"), "run_id", F.col("level").alias("detail"))
    return newest.unionByName(problems).unionByName(logs)


@query(
    "score_refresh_due",
    sql(
        """SELECT source, newest, newest IS NULL OR DATE '2024-02-05' - newest > 7 AS refresh FROM (
           SELECT 'scores' AS source, max(observed_at) AS newest FROM score UNION ALL SELECT 'pages', CAST(max(ts) AS DATE) FROM events)""",
        "score",
    ),
)
def score_refresh_due(v: Views):
    day = as_of("2024-02-05")
    scores = H.needs_refresh(v.score, "observed_at", day).select(F.lit("scores").alias("source"), "newest", "refresh")
    pages = H.needs_refresh(v.table("events").select(F.col("ts").cast("date").alias("d")), "d", day).select(F.lit("pages").alias("source"), "newest", "refresh")
    return scores.unionByName(pages)


@query(
    "stale_confidence",
    sql(
        f"""SELECT snapshot_id, declared, {effective("declared", "observed_date")} AS effective, CAST({AS_OF} - observed_date AS BIGINT) AS age_days,
           {AS_OF} - observed_date > 90 AS stale, declared <> 'unknown' AND {AS_OF} - observed_date > CASE declared WHEN 'assumed' THEN 30 ELSE 90 END AS needs_review,
           CASE WHEN {AS_OF} - observed_date > 30 THEN 'red' WHEN {AS_OF} - observed_date > 14 THEN 'yellow' ELSE 'green' END AS freshness
           FROM (SELECT o_orderkey AS snapshot_id, CAST(o_orderdate AS DATE) AS observed_date, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'observed'
             WHEN '2' THEN 'inferred' WHEN '3' THEN 'assumed' WHEN '4' THEN 'stale' ELSE 'unknown' END AS declared FROM orders)""",
        "price_history",
    ),
)
def stale_confidence(v: Views):
    digit = F.left("o_orderpriority", F.lit(1))
    declared = F.when(digit == "1", "observed").when(digit == "2", "inferred").when(digit == "3", "assumed").when(digit == "4", "stale")
    o = v.table("orders").select(
        F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").cast("date").alias("observed_date"), declared.otherwise("unknown").alias("declared")
    )
    d, t = F.col("declared"), F.col("observed_date")
    return H.freshness(o, "observed_date", as_of()).select(
        "snapshot_id", "declared", B.effective_confidence(d, t, as_of()).alias("effective"), "age_days", "stale",
        B.stale_source(d, t, as_of()).alias("needs_review"), "freshness",
    )


@query(
    "assumption_review",
    sql(
        f"""SELECT plan_id, field, order_id, line, confidence FROM (
             SELECT plan_id, 'Pricing' AS field, 0 AS order_id, 0 AS line, {effective("pricing_confidence", "accessed_date")} AS confidence FROM scoped_plan
             UNION ALL SELECT plan_id, replace(limit_type, '_', ' '), order_id, line, {effective("confidence", "accessed_date")} FROM plan_limit
               WHERE plan_id IN (SELECT plan_id FROM scoped_plan))
           WHERE confidence IN ('assumed', 'stale')""",
        "scoped_plan", "plan_limit",
    ),
)
def assumption_review(v: Views):
    return H.review_list(v.scoped_plan, v.limit, as_of()).select("plan_id", "field", "order_id", "line", "confidence")


@query(
    "assumption_review_top",
    sql(
        f"""SELECT plan_id, field, order_id, line, confidence FROM (
             SELECT plan_id, 'Pricing' AS field, 0 AS order_id, 0 AS line, {effective("pricing_confidence", "accessed_date")} AS confidence FROM scoped_plan
             UNION ALL SELECT plan_id, replace(limit_type, '_', ' '), order_id, line, {effective("confidence", "accessed_date")} FROM plan_limit
               WHERE plan_id IN (SELECT plan_id FROM scoped_plan))
           WHERE confidence IN ('assumed', 'stale') ORDER BY plan_id, order_id, line, field, confidence LIMIT 25""",
        "scoped_plan", "plan_limit",
    ),
)
def assumption_review_top(v: Views):
    """The first 25 entries to review: plan by plan, its price before its limits."""
    listed = H.review_list(v.scoped_plan, v.limit, as_of()).select("plan_id", "field", "order_id", "line", "confidence")
    return listed.orderBy("plan_id", "order_id", "line", "field", "confidence").limit(25)


@query(
    "ranked_score_age",
    sql(f"SELECT min(score_date) AS oldest, max(score_date) AS newest, {SCORES_AS_OF} - min(score_date) > 14 AS stale FROM value_band", "value_band"),
)
def ranked_score_age(v: Views):
    return H.score_age(R.value_by_band(Q.rows(v)), as_of(SCORES_DAY))


@query(
    "baseline_rollover",
    sql(
        """SELECT plan_id, price, CAST('2001-08-02' AS DATE) AS baseline_date FROM price_history QUALIFY row_number() OVER (
           PARTITION BY plan_id ORDER BY observed_date DESC, snapshot_id DESC) = 1""",
        "price_history",
    ),
)
def baseline_rollover(v: Views):
    """Next baseline: the newest price of each plan, stamped with the day it becomes the reference."""
    newest = H.latest_snapshot(v.price_history, ["plan_id"], "observed_date")
    return newest.select("plan_id", "price", as_of().alias("baseline_date"))


@query(
    "provider_freshness",
    """WITH d AS (SELECT CAST(c_nationkey AS BIGINT) AS provider_id, CAST(max(o_orderdate) AS DATE) AS last_verified FROM orders
       JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey)
       SELECT provider_id, last_verified, CAST(DATE '2001-09-10' - last_verified AS BIGINT) AS age_days, DATE '2001-09-10' - last_verified > 90 AS stale,
       CASE WHEN DATE '2001-09-10' - last_verified > 30 THEN 'red' WHEN DATE '2001-09-10' - last_verified > 14 THEN 'yellow' ELSE 'green' END AS freshness FROM d""",
)
def provider_freshness(v: Views):
    o = v.table("orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    c = v.table("customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("provider_id"))
    seen = o.join(c, o.o_custkey == c.c_custkey).groupBy("provider_id").agg(F.max("d").alias("last_verified"))
    return H.freshness(seen, "last_verified", as_of("2001-09-10")).orderBy("last_verified", "provider_id")
