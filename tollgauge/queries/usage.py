"""Limit normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgauge.constants import NormalizationConfig, UsdRate
from tollgauge.functions.capacity import window_confidence, window_too_far
from tollgauge.operators import normalize as N
from tollgauge.queries.registry import query
from tollgauge.queries.sql_views import normalized, num_text, sql
from tollgauge.sources.views import Views

KEYS = ["plan_id", "model_id", "order_id", "line", "limit_value", "limit_type"]


def _windows(df):
    e = N.envelope(df)
    return e.select(
        *KEYS, "layer", "tokens_1mo", "tokens_1w", "tokens_24h", "tokens_5h", "low_1mo", "high_1mo", "low_5h", "high_1w",
        "uncertainty_low", "uncertainty_high", "confidence",
    )


_WINDOW_SQL = """SELECT plan_id, model_id, order_id, line, limit_value, limit_type, layer, tokens_1mo, tokens_1w, tokens_24h, tokens_5h,
    low_1mo, high_1mo, low_5h, high_1w, low_5h AS uncertainty_low, high_1mo AS uncertainty_high, norm_confidence AS confidence FROM """


@query("limit_tokens_windows", sql(_WINDOW_SQL + "norm_table", "norm_table"))
def limit_tokens_windows(v: Views):
    return _windows(N.normalize_limits(v.limit))


@query("document_limit_tokens", sql(_WINDOW_SQL + "norm_doc", "norm_doc"))
def document_limit_tokens(v: Views):
    return _windows(N.normalize_limits(N.document_limit(v.limit)))


@query(
    "limit_layer_census",
    sql(
        """SELECT 'document' AS source, layer, norm_confidence AS confidence, count(*) AS limits,
           CAST(sum(CAST(floor(tokens_1mo) AS BIGINT)) AS BIGINT) AS tokens FROM norm_doc GROUP BY ALL
           UNION ALL SELECT 'table', layer, norm_confidence, count(*), CAST(sum(CAST(floor(tokens_1mo) AS BIGINT)) AS BIGINT)
           FROM norm_table GROUP BY ALL""",
        "norm_doc", "norm_table",
    ),
)
def limit_layer_census(v: Views):
    def census(df, source):
        n = N.normalize_limits(df)
        return n.groupBy(F.lit(source).alias("source"), "layer", "confidence").agg(
            F.count("*").alias("limits"), F.sum(F.floor("tokens_1mo").cast("bigint")).alias("tokens")
        )

    return census(N.document_limit(v.limit), "document").unionByName(census(v.limit, "table"))


@query(
    "best_limit_per_plan",
    sql("SELECT plan_id, order_id, line, limit_type, limit_value, layer, tokens_1mo, norm_confidence AS confidence FROM best_limit", "best_limit"),
)
def best_limit_per_plan(v: Views):
    best = N.best_limit(N.normalize_limits(N.document_limit(v.limit)), v.LIMIT_ORDER)
    return best.select("plan_id", "order_id", "line", "limit_type", "limit_value", "layer", "tokens_1mo", "confidence")


def _slug_limits(v: Views):
    """Limits keyed by the text plan id and the model's display name."""
    slug = v.plan.select("plan_id", "plan_slug")
    named = v.limit.join(slug, "plan_id").withColumn("plan_id", F.col("plan_slug")).drop("plan_slug")
    return named.withColumn("supplier", F.col("model_id")).withColumn(
        "model_id", F.concat(F.lit("sup"), (F.col("supplier") % 9).cast("string"), F.lit("-"), F.col("supplier").cast("string"))
    )


_SLUG = """SELECT l.* EXCLUDE (plan_id, model_id), plan_slug AS plan_id, l.model_id AS supplier,
    'sup' || (l.model_id % 9) || '-' || l.model_id AS model_id FROM plan_limit l JOIN plan p ON p.plan_id = l.plan_id"""

RATES = {"Brand#3-27": UsdRate(150, 40, 2), "Brand#2-0": UsdRate(90, 30, 6), "Brand#1": UsdRate(9, 9, 9)}


@query(
    "usd_credit_rates",
    sql(
        """SELECT plan_id, supplier, order_id, line, limit_value, tokens_1mo, low_1mo, high_1mo, norm_confidence AS confidence
           FROM n WHERE layer = 'usd_credits'""",
        slug=_SLUG,
        n=normalized(
            "slug",
            usd="(CASE plan_id WHEN 'Brand#3-27' THEN 40e0 WHEN 'Brand#2-0' THEN 30e0 WHEN 'Brand#1' THEN 9e0 ELSE 20e0 END), "
            "(CASE plan_id WHEN 'Brand#3-27' THEN 150e0 WHEN 'Brand#2-0' THEN 90e0 WHEN 'Brand#1' THEN 9e0 ELSE 75e0 END), "
            "(CASE plan_id WHEN 'Brand#3-27' THEN 2e0 WHEN 'Brand#2-0' THEN 6e0 WHEN 'Brand#1' THEN 9e0 ELSE 10e0 END)",
        ),
    ),
)
def usd_credit_rates(v: Views):
    n = N.normalize_limits(_slug_limits(v), NormalizationConfig(usd_rates=RATES)).where(F.col("layer") == "usd_credits")
    return n.select(
        "plan_id", "supplier", "order_id", "line", "limit_value", "tokens_1mo", "low_1mo", "high_1mo", "confidence"
    )


CREDITS = {"Brand#1": 300.0, "Brand#17-1": 750.0, "Brand#2-0": 900.0, "Brand#25": 640.0}
UNITS = {"Brand#2": 1500.0, "Brand#4": 2500.0}


@query(
    "mapped_credits_prefix",
    sql(
        """SELECT plan_id, supplier, order_id, line, limit_value, layer, tokens_1mo, norm_confidence AS confidence
           FROM n WHERE layer IN ('credits', 'compute_units')""",
        slug=_SLUG,
        n=normalized(
            "slug",
            credit="""CASE WHEN plan_id = 'Brand#1' THEN 300 WHEN plan_id = 'Brand#17-1' THEN 750 WHEN plan_id = 'Brand#2-0' THEN 900
              WHEN plan_id = 'Brand#25' THEN 640 WHEN starts_with(plan_id, 'Brand#1') THEN 300 WHEN starts_with(plan_id, 'Brand#17-1') THEN 750
              WHEN starts_with(plan_id, 'Brand#2-0') THEN 900 WHEN starts_with(plan_id, 'Brand#25') THEN 640 END""",
            units="""CASE WHEN starts_with(plan_id, 'Brand#2') THEN 1500 WHEN starts_with(plan_id, 'Brand#4') THEN 2500 END""",
        ),
    ),
)
def mapped_credits_prefix(v: Views):
    cfg = NormalizationConfig(credit_mappings=CREDITS, compute_unit_mappings=UNITS)
    n = N.normalize_limits(_slug_limits(v), cfg).where(F.col("layer").isin("credits", "compute_units"))
    return n.select("plan_id", "supplier", "order_id", "line", "limit_value", "layer", "tokens_1mo", "confidence")


@query(
    "prefix_table_lookup",
    sql(
        """SELECT p.plan_id, p.plan_slug, (SELECT arg_min(m.rate, CASE WHEN m.k = p.plan_slug THEN -1 ELSE m.ord END)
             FROM m WHERE starts_with(p.plan_slug, m.k)) AS rate FROM plan p""",
        "plan",
        m="SELECT p_brand AS k, min(p_partkey) AS ord, CAST(count(*) AS DOUBLE) AS rate FROM part GROUP BY p_brand",
    ),
)
def prefix_table_lookup(v: Views):
    brands = v.table("part").groupBy(F.col("p_brand").alias("key")).agg(
        F.min("p_partkey").alias("ord"), F.count("*").cast("double").alias("rate")
    )
    return N.lookup_by_prefix(v.plan.select("plan_id", "plan_slug"), "plan_slug", brands, "rate")


MULTIPLIERS = {"sup1-10": 2.5, "sup2-family": 0.75, "sup1-other": 1.2, "sup": 1.1}


@query(
    "model_multiplier",
    sql(
        """SELECT model_id, layer, limit_type, mult AS multiplier, count(*) AS limits,
           CAST(sum(CAST(floor(tokens_1mo) AS BIGINT)) AS BIGINT) AS tokens FROM n GROUP BY ALL""",
        slug=_SLUG,
        n=normalized(
            "slug",
            mult="""CASE WHEN model_id = 'sup1-10' THEN 2.5 WHEN starts_with(model_id, 'sup1') THEN 2.5
              WHEN starts_with(model_id, 'sup2') THEN 0.75 ELSE 1.1 END""",
        ),
    ),
)
def model_multiplier(v: Views):
    n = N.normalize_limits(_slug_limits(v), NormalizationConfig(model_multipliers=MULTIPLIERS))
    return n.groupBy("model_id", "layer", "limit_type", "multiplier").agg(
        F.count("*").alias("limits"), F.sum(F.floor("tokens_1mo").cast("bigint")).alias("tokens")
    )


_TEXT = {k: num_text(k) for k in ("monthly", "tokens_1mo", "tokens_1w", "tokens_24h", "tokens_5h")}


@query(
    "normalise_audit",
    sql(
        f"""SELECT plan_id, model_id, order_id, line, limit_value, limit_type, step, layer_name AS layer, input_value, input_unit, output_tokens,
           target_window, warning_count, assumption, detail_month FROM (
           SELECT *, CAST(CASE WHEN layer = 'unknown' THEN 1 WHEN tokens_1mo = 0 THEN 0 ELSE 1 END AS BIGINT) AS warning_count,
             CASE layer WHEN 'messages' THEN 'Message-to-token: 2000 tokens/message' WHEN 'requests' THEN 'Request-to-token: 5000 tokens/request'
               WHEN 'credits' THEN 'Credit mapping: 500 tokens/credit' WHEN 'compute_units' THEN 'Compute-unit mapping: 1000 tokens/compute-unit'
               WHEN 'usd_credits' THEN 'USD credit conversion: $' || {_TEXT["monthly"]} || '/mo'
               WHEN 'time_window' THEN 'Generic unit limit: 5000 tokens/' || coalesce(lower(limit_unit), 'unit') END AS assumption,
             CASE WHEN layer <> 'unknown' THEN {_TEXT["tokens_1mo"]} || ' tokens (confidence: ' || CASE WHEN tokens_1mo = 0 THEN 'inferred' ELSE 'observed' END || ')' END AS detail_month,
             unnest(CASE WHEN layer = 'time_window' THEN [0, 1] ELSE [0] END) AS step,
             unnest(CASE layer WHEN 'time_window' THEN ['time_window', 'requests'] ELSE [layer] END) AS layer_name,
             CASE WHEN layer IN ('direct_tokens', 'time_window', 'unknown') THEN limit_value ELSE monthly END AS input_value,
             CASE WHEN layer IN ('direct_tokens', 'time_window', 'unknown') THEN lower(limit_unit) WHEN layer = 'usd_credits' THEN 'USD' ELSE layer END AS input_unit,
             unnest(CASE layer WHEN 'time_window' THEN [NULL, tokens_1mo] WHEN 'unknown' THEN [NULL] ELSE [tokens_1mo] END) AS output_tokens,
             CASE layer WHEN 'unknown' THEN 'N/A' WHEN 'time_window' THEN reset_window WHEN 'direct_tokens' THEN coalesce(reset_window, '1mo')
               ELSE '1mo' END AS target_window FROM norm_table)""",
        "norm_table",
    ),
)
def normalise_audit(v: Views):
    a = N.audit_steps(N.audit(N.normalize_limits(v.limit)))
    return a.select(
        *KEYS, "step", F.col("chain_layer").alias("layer"), "input_value", "input_unit", "output_tokens", "target_window",
        F.size("warnings").cast("bigint").alias("warning_count"), F.get("assumptions", F.lit(0)).alias("assumption"),
        F.get_json_object("window_detail", "$.1mo").alias("detail_month"),
    )


@query(
    "limits_of_provider",
    sql(
        """SELECT p.plan_id, count(*) AS limits, CAST(sum(CAST(limit_value AS BIGINT)) AS BIGINT) AS total FROM plan_limit l
           JOIN plan p ON p.plan_id = l.plan_id WHERE starts_with(p.plan_slug, 'Brand#1') GROUP BY p.plan_id""",
        "plan_limit", "plan",
    ),
)
def limits_of_provider(v: Views):
    """Limits of the plans whose text id starts with a provider id."""
    chosen = v.plan.where(F.col("plan_slug").startswith("Brand#1")).select("plan_id")
    return v.limit.join(chosen, "plan_id").groupBy("plan_id").agg(
        F.count("*").alias("limits"), F.sum(F.col("limit_value").cast("bigint")).alias("total")
    )


@query(
    "window_conversions",
    """WITH w AS (SELECT unnest(['1h','3h','5h','1d','1w','1mo','1y']) AS code, unnest([1e0,3e0,5e0,24e0,168e0,730e0,8760e0]) AS h),
       t AS (SELECT unnest(['5h','24h','1w','1mo']) AS code, unnest([5e0,24e0,168e0,730e0]) AS h),
       q AS (SELECT DISTINCT l_quantity AS value FROM lineitem)
       SELECT value, w.code AS from_window, t.code AS to_window,
         CASE WHEN value = 0 OR w.h = t.h THEN value WHEN w.h < t.h THEN floor(value * (t.h / w.h) + 0.5) ELSE floor(value / (w.h / t.h) + 0.5) END AS converted,
         CASE WHEN value = 0 THEN 'inferred' WHEN w.h = t.h THEN 'observed' WHEN greatest(w.h / t.h, t.h / w.h) <= 5 THEN 'inferred'
           WHEN greatest(w.h / t.h, t.h / w.h) <= 50 THEN 'assumed' ELSE 'unknown' END AS confidence,
         greatest(w.h, 5e0) / least(w.h, 5e0) > 1000 AS too_far
       FROM q, w, t""",
)
def window_conversions(v: Views):
    from tollgauge.functions.capacity import convert_window

    values = v.table("lineitem").select(F.col("l_quantity").alias("value")).distinct()
    targets = F.array(*[F.lit(t) for t in N.TARGETS])
    froms = F.array(*[F.lit(w) for w in N.KNOWN_WINDOWS])
    grid = values.withColumn("from_window", F.explode(froms)).withColumn("to_window", F.explode(targets))
    f, t = F.col("from_window"), F.col("to_window")
    return grid.select(
        "value", "from_window", "to_window",
        convert_window(F.col("value"), f, t).alias("converted"),
        window_confidence(F.col("value"), f, t).alias("confidence"),
        window_too_far(f, F.lit("5h")).alias("too_far"),
    )


@query(
    "config_rules",
    """SELECT l_orderkey AS config_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_quantity AS quantity, CAST(
         CASE WHEN l_quantity > 2000 - l_extendedprice / 20 THEN 1 ELSE 0 END
         + CASE WHEN l_linenumber > 5 THEN 1 ELSE 0 END + CASE WHEN l_quantity > 31 OR l_quantity <= 0 THEN 1 ELSE 0 END
         + CASE WHEN l_discount = 0 THEN 1 ELSE 0 END + CASE WHEN 2000 - l_extendedprice / 20 < 0 THEN 1 ELSE 0 END
         + CASE WHEN 2000 - l_extendedprice / 20 > 5000 THEN 1 ELSE 0 END AS BIGINT) AS error_count,
       CASE WHEN l_discount = 0 THEN 'sessionsPerMonth must be > 0' WHEN l_quantity > 31 THEN 'workingDaysPerMonth must be 1-31' END AS sample
       FROM lineitem""",
)
def config_rules(v: Views):
    """Every line item read as one configuration row; checks the validation rules."""
    li = v.table("lineitem")
    c = li.select(
        F.col("l_orderkey").alias("config_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("quantity"),
        F.col("l_quantity").alias("tokensPerCodingMessage_low"),
        (F.lit(2000) - F.col("l_extendedprice") / 20).alias("tokensPerCodingMessage_base"),
        F.lit(5000.0).alias("tokensPerCodingMessage_high"),
        F.col("l_linenumber").cast("double").alias("tokensPerAgenticRequest_low"),
        F.lit(5.0).alias("tokensPerAgenticRequest_base"),
        F.lit(12.0).alias("tokensPerAgenticRequest_high"),
        F.lit(50.0).alias("tokensPerAutocomplete_low"),
        F.lit(150.0).alias("tokensPerAutocomplete_base"),
        F.lit(400.0).alias("tokensPerAutocomplete_high"),
        F.lit(500.0).alias("tokensPerCredit_base"),
        F.lit(1000.0).alias("tokensPerComputeUnit_base"),
        (F.col("l_discount") * 100).alias("sessionsPerMonth"),
        F.col("l_quantity").alias("workingDaysPerMonth"),
        F.lit(4.0).alias("weeksPerMonth"),
        F.lit(5.0).alias("hoursPerSession"),
    )
    e = N.config_errors(c)
    period = F.filter("errors", lambda x: x.startswith("sessionsPerMonth") | x.startswith("workingDays"))
    return e.select(
        "config_id", "line", "part", "supp", "quantity", F.size("errors").cast("bigint").alias("error_count"),
        F.get(period, F.lit(0)).alias("sample"),
    )


_KNOWN = "SELECT plan_id, CAST(model_id AS VARCHAR) AS model_key FROM plan_model WHERE access_type = 'legacy'"


@query(
    "estimate_refresh",
    sql(
        """SELECT 'skip' AS mode, n.plan_id, n.model_key, order_id, line, limit_value, limit_type, layer, tokens_1mo, norm_confidence AS confidence FROM n
           UNION ALL SELECT 'force', f.plan_id, f.model_key, order_id, line, limit_value, limit_type, layer, tokens_1mo, norm_confidence FROM f""",
        keyed="SELECT *, CAST(model_id AS VARCHAR) AS model_key FROM plan_limit",
        known=_KNOWN,
        first="""SELECT k.* FROM keyed k ANTI JOIN known h ON h.plan_id = k.plan_id AND h.model_key = k.model_key
          QUALIFY row_number() OVER (PARTITION BY k.plan_id, k.model_key ORDER BY order_id, line, model_id, limit_value, limit_type) = 1""",
        final="""SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY plan_id, model_key
          ORDER BY order_id DESC, line DESC, model_id DESC, limit_value DESC, limit_type DESC) = 1""",
        n=normalized("first"),
        f=normalized("final"),
    ),
)
def estimate_refresh(v: Views):
    legacy = v.plan_model.where(F.col("access_type") == "legacy")
    existing = legacy.select("plan_id", F.col("model_id").cast("string").alias("model_key"))
    cols = ["plan_id", "model_key", "order_id", "line", "limit_value", "limit_type", "layer", "tokens_1mo", "confidence"]
    skip = N.refresh_estimates(v.limit, existing, v.LIMIT_ORDER).select(F.lit("skip").alias("mode"), *cols)
    force = N.refresh_estimates(v.limit, existing, v.LIMIT_ORDER, force=True).select(F.lit("force").alias("mode"), *cols)
    return skip.unionByName(force)


@query(
    "refresh_summary",
    sql(
        """SELECT (SELECT count(*) FROM plan_limit) AS limits_processed, (SELECT count(*) FROM n) AS estimates_written,
           (SELECT count(*) FROM plan_limit) - (SELECT count(*) FROM n) AS skipped,
           (SELECT count(*) FROM n WHERE norm_confidence = 'unknown') AS unknown""",
        "plan_limit",
        first="""SELECT * FROM plan_limit QUALIFY row_number() OVER (PARTITION BY plan_id, model_id
          ORDER BY order_id, line, model_id, limit_value, limit_type) = 1""",
        n=normalized("first"),
    ),
)
def refresh_summary(v: Views):
    return N.summary(v.limit, N.refresh_estimates(v.limit, None, v.LIMIT_ORDER))
