"""DuckDB SQL for the domain views and the shared formulas, used only to check results."""

from __future__ import annotations

AS_OF = "DATE '2001-08-02'"
SCORES_AS_OF = "DATE '2024-01-31'"


def hu(x: str) -> str:
    return f"floor(({x}) + 0.5)"


def hu_digits(x: str, digits: int) -> str:
    return f"(floor(({x}) * {10**digits}e0 + 0.5) / {10**digits}e0)"


def conf_rank(c: str) -> str:
    return f"(CASE {c} WHEN 'observed' THEN 4 WHEN 'inferred' THEN 3 WHEN 'assumed' THEN 2 WHEN 'stale' THEN 1 ELSE 0 END)"


def rank_conf(r: str) -> str:
    return f"(CASE {r} WHEN 4 THEN 'observed' WHEN 3 THEN 'inferred' WHEN 2 THEN 'assumed' WHEN 1 THEN 'stale' WHEN 0 THEN 'unknown' END)"


def effective(conf: str, accessed: str, as_of: str = AS_OF) -> str:
    return f"(CASE WHEN ({as_of} - {accessed}) > 90 AND {conf_rank(conf)} > 1 THEN 'stale' ELSE {conf} END)"


def band(p: str) -> str:
    return f"(CASE WHEN {p} IS NULL OR {p} <= 0 THEN 'free' WHEN {p} <= 15 THEN 'low' WHEN {p} <= 49 THEN 'mid' ELSE 'high' END)"


def caveat(conf: str) -> str:
    return (
        f"(CASE WHEN {conf} = 'observed' THEN '' ELSE 'Data confidence: ' || {conf} || "
        "' — not directly observed from the provider source; figures are proxied or assumed.' END)"
    )


def num_text(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


_TYPES = (
    "['messages_per_day','messages_per_month','messages_per_period','tokens_per_minute','tokens_per_day',"
    "'tokens_per_month','requests_per_minute','requests_per_day','requests_per_month','completions_per_month',"
    "'credits_per_month','usd_credits_per_month','compute_units_per_month','unknown']"
)

VIEWS: dict[str, str] = {
    "provider": """SELECT CAST(n_nationkey AS BIGINT) AS provider_id, n_name AS provider_name, r_name AS category,
        r_name <> 'AFRICA' AS is_active FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "model": f"""SELECT s_suppkey AS model_id, CAST(s_nationkey AS BIGINT) AS provider_id, s_name AS display_name,
        s_acctbal >= 0 AS is_active, {AS_OF} - CAST(floor(abs(s_acctbal) / 20) AS INT) AS released_date FROM supplier""",
    "plan": f"""SELECT p_partkey AS plan_id, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) % 25 AS provider_id,
        p_name AS plan_name, p_brand || '-' || p_partkey AS plan_slug,
        CASE p_type WHEN 'ECONOMY' THEN 'individual' WHEN 'STANDARD' THEN 'pro' WHEN 'SMALL' THEN 'free'
          WHEN 'MEDIUM' THEN 'team' WHEN 'LARGE' THEN 'enterprise' WHEN 'PROMO' THEN 'api' END AS tier,
        CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN 0e0 ELSE p_size * 2e0 END AS monthly_usd,
        CASE WHEN p_size % 3 = 0 THEN CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN 0e0 ELSE p_size * 1.6e0 END END AS annual_usd,
        p_name NOT LIKE 'old%' AS is_active,
        CASE WHEN p_size % 8 < 4 THEN 'observed' WHEN p_size % 8 = 4 THEN 'inferred' WHEN p_size % 8 = 5 THEN 'assumed'
          WHEN p_size % 8 = 6 THEN 'stale' ELSE 'unknown' END AS pricing_confidence,
        {AS_OF} - CAST(floor((p_retailprice - 900) * 1.5e0) AS INT) AS accessed_date,
        CASE WHEN p_size <> 7 THEN {AS_OF} - CAST(p_size AS INT) END AS last_verified FROM part""",
    "scoped_plan": """SELECT *, least(monthly_usd, annual_usd) AS price FROM plan
        WHERE is_active AND tier IN ('individual', 'pro') AND monthly_usd > 0""",
    "plan_model": """SELECT l_partkey AS plan_id, l_suppkey AS model_id,
        CASE WHEN min(l_returnflag) = 'R' THEN 'legacy' ELSE 'full' END AS access_type, l_suppkey AS ord
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "limit_typed": f"""SELECT *, {_TYPES}[1 + ((CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END
        + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) + (l_linenumber - 1) * 6) % 14] AS limit_type FROM lineitem""",
    "plan_limit": f"""SELECT l_partkey AS plan_id, l_suppkey AS model_id, l_orderkey AS order_id, l_linenumber AS line, limit_type,
        CASE WHEN limit_type = 'unknown' AND l_quantity < 25 THEN NULL ELSE l_quantity END AS limit_value,
        CASE WHEN limit_type LIKE 'messages%' THEN 'Messages' WHEN limit_type LIKE 'tokens%' THEN 'tokens'
          WHEN limit_type LIKE 'requests%' THEN (CASE WHEN l_linenumber % 2 = 0 THEN 'requests' ELSE 'calls' END)
          WHEN limit_type LIKE 'completions%' THEN 'completions' END AS limit_unit,
        CASE WHEN l_linenumber = 6 THEN NULL ELSE ['1h','3h','5h','1d','1w','1mo','1y'][l_linenumber] END AS reset_window,
        CASE WHEN l_partkey % 3 = 0 THEN 'observed' WHEN l_partkey % 3 = 1 THEN 'inferred' WHEN l_tax < 0.05 THEN 'assumed'
          ELSE 'unknown' END AS confidence,
        {AS_OF} - CAST(l_partkey % 120 + l_linenumber AS INT) AS accessed_date FROM limit_typed""",
    "document_limit": """SELECT * REPLACE (
        CASE limit_type WHEN 'credits_per_month' THEN 'credits' WHEN 'compute_units_per_month' THEN 'compute_units'
          ELSE limit_type END AS limit_type,
        CASE WHEN limit_type LIKE 'tokens%' THEN 'tokens' WHEN limit_type LIKE 'messages%' THEN 'messages'
          WHEN limit_type LIKE 'requests%' THEN 'requests' WHEN limit_type LIKE 'completions%' THEN limit_unit END AS limit_unit,
        CASE WHEN limit_type LIKE '%\\_per\\_minute' ESCAPE '\\' THEN '1h' WHEN limit_type LIKE '%\\_per\\_day' ESCAPE '\\' THEN '1d'
          WHEN limit_type LIKE '%\\_per\\_week' ESCAPE '\\' THEN '1w' WHEN limit_type LIKE '%\\_per\\_month' ESCAPE '\\' THEN '1mo'
          END AS reset_window) FROM plan_limit""",
    "score_last": """SELECT user_id, event_type, CASE WHEN value IS NOT NULL THEN least(100e0, value) END AS idx, value, event_id
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "score_any": """SELECT user_id, event_id AS last_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(ts AS DATE) AS observed_at
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "score": """SELECT a.user_id AS model_id, p.idx AS intelligence, v.idx AS coding, c.idx AS agentic, s.idx AS speed,
        e.value / 10 AS price_in, e.value / 10 * 3 AS price_out, k / 100 AS cost_per_task, observed_at,
        CASE WHEN last_id % 11 = 0 THEN 'unknown' WHEN last_id % 5 < 3 THEN 'observed' WHEN last_id % 5 = 3 THEN 'inferred'
          ELSE 'assumed' END AS confidence
        FROM score_any a
        LEFT JOIN score_last p ON p.user_id = a.user_id AND p.event_type = 'purchase'
        LEFT JOIN score_last v ON v.user_id = a.user_id AND v.event_type = 'view'
        LEFT JOIN score_last c ON c.user_id = a.user_id AND c.event_type = 'click'
        LEFT JOIN score_last s ON s.user_id = a.user_id AND s.event_type = 'signup'
        LEFT JOIN score_last e ON e.user_id = a.user_id AND e.event_type = 'error'""",
    "rated": f"""SELECT *, CASE WHEN agentic IS NOT NULL OR coding IS NOT NULL THEN {hu_digits(
            "(coalesce(agentic * 0.5e0, 0e0) + coalesce(coding * 0.4e0, 0e0) + coalesce(speed, 50e0) * 0.1e0)"
            " / ((CASE WHEN agentic IS NULL THEN 0e0 ELSE 0.5e0 END) + (CASE WHEN coding IS NULL THEN 0e0 ELSE 0.4e0 END) + 0.1e0)", 1)}
          END AS wmq,
        CASE WHEN (agentic IS NULL) <> (coding IS NULL) THEN {rank_conf(f"least({conf_rank('confidence')}, 3)")}
          ELSE confidence END AS wmq_confidence FROM score""",
    "median_cost": "SELECT median(cost_per_task) AS med FROM score WHERE cost_per_task > 0",
    "efficient": """SELECT *, CASE WHEN cost_per_task > 0 AND med IS NOT NULL
          THEN 0.85e0 + least(100e0, greatest(0e0, med / cost_per_task * 50e0)) / 100 * (1.15e0 - 0.85e0) ELSE 1e0 END AS efficiency
        FROM rated, median_cost""",
    "snapshot": """SELECT user_id AS provider_id, event_type AS source_url, ts AS observed_at, event_id AS snapshot_id,
        sha256(props) AS content_hash, CASE WHEN event_type <> 'error' THEN props END AS extracted_text FROM events""",
    "price_history": """SELECT o_custkey AS plan_id, CAST(o_orderdate AS DATE) AS observed_date, o_orderkey AS snapshot_id,
        o_totalprice AS price FROM orders""",
    "offer_text": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey AS plan_id,
        'Plan costs $' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 2000 AS VARCHAR)
        || CASE WHEN l_linenumber % 3 = 0 THEN '/mo' WHEN l_linenumber % 3 = 1 THEN ' per year' ELSE '' END || ', '
        || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR)
        || CASE l_returnflag WHEN 'A' THEN ' messages per day' WHEN 'N' THEN ' credits/month' ELSE 'x more usage' END
        || CASE l_linestatus WHEN 'F' THEN '. Free tier available, limits reset every 24 hours.'
           ELSE '. Heavy use is throttled; usage limits apply and vary, capped by model.' END AS text
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}

_M = (
    "CASE reset_window WHEN '1h' THEN limit_value * 5 * 80 WHEN '3h' THEN floor(limit_value * 20 * 5 / 3 + 0.5) "
    "WHEN '5h' THEN limit_value * 80 WHEN '1d' THEN limit_value * 20 WHEN '1w' THEN limit_value * 4 "
    "WHEN '1y' THEN floor(limit_value / 12 + 0.5) ELSE limit_value END"
)


def _to(x: str, hours: int) -> str:
    return f"CASE WHEN {x} = 0 THEN {x} ELSE floor({x} / (730e0 / {hours}) + 0.5) END"


def normalized(source: str, credit: str = "NULL", units: str = "NULL", mult: str = "NULL", usd: str = "20e0, 75e0, 10e0") -> str:
    """Limit normalisation over ``source``; the factor arguments are SQL expressions."""
    base_rate, low_rate, high_rate = usd.split(", ")

    def scaled(b: int) -> str:
        return f"coalesce(floor({b}e0 * mult + 0.5), {b}e0)"

    return f"""SELECT *, CASE WHEN layer = 'unknown' THEN 'unknown' ELSE {rank_conf("least(CASE WHEN tokens_1mo = 0 THEN 3 ELSE 4 END, cap)")} END AS norm_confidence,
        {_to("tokens_1mo", 5)} AS tokens_5h, {_to("tokens_1mo", 24)} AS tokens_24h, {_to("tokens_1mo", 168)} AS tokens_1w,
        {_to("low_1mo", 5)} AS low_5h, {_to("high_1mo", 168)} AS high_1w FROM (
      SELECT *, CASE WHEN layer = 'usd_credits' OR low0 <> tokens_1mo THEN low0 END AS low_1mo,
        CASE WHEN layer = 'usd_credits' OR high0 <> tokens_1mo THEN high0 END AS high_1mo FROM (
        SELECT *, CASE layer
            WHEN 'direct_tokens' THEN coalesce(floor(limit_value * mult + 0.5), limit_value)
            WHEN 'messages' THEN monthly * {scaled(2000)} WHEN 'requests' THEN monthly * {scaled(5000)}
            WHEN 'credits' THEN monthly * coalesce(credit_factor, 500e0) WHEN 'usd_credits' THEN floor(monthly * 1e6 / {base_rate} + 0.5)
            WHEN 'compute_units' THEN monthly * coalesce(unit_factor, 1000e0) WHEN 'time_window' THEN limit_value * {scaled(5000)} END AS tokens_1mo,
          CASE layer WHEN 'messages' THEN monthly * 1000e0 WHEN 'requests' THEN monthly * 3000e0
            WHEN 'usd_credits' THEN floor(monthly * 1e6 / {low_rate} + 0.5) END AS low0,
          CASE layer WHEN 'messages' THEN monthly * 5000e0 WHEN 'requests' THEN monthly * 12000e0
            WHEN 'usd_credits' THEN floor(monthly * 1e6 / {high_rate} + 0.5) END AS high0,
          CASE layer WHEN 'direct_tokens' THEN 4 WHEN 'time_window' THEN 2
            WHEN 'credits' THEN CASE WHEN credit_factor IS NULL THEN 2 ELSE 3 END
            WHEN 'compute_units' THEN CASE WHEN unit_factor IS NULL THEN 2 ELSE 3 END ELSE 3 END AS cap
        FROM (SELECT *, {_M} AS monthly, CAST({credit} AS DOUBLE) AS credit_factor, CAST({units} AS DOUBLE) AS unit_factor, CAST({mult} AS DOUBLE) AS mult,
            CASE WHEN limit_value IS NULL THEN 'unknown' WHEN lower(limit_unit) = 'tokens' THEN 'direct_tokens'
              WHEN lower(limit_unit) = 'messages' THEN 'messages' WHEN lower(limit_unit) IN ('requests', 'calls') THEN 'requests'
              WHEN limit_type = 'credits_per_month' THEN 'credits' WHEN limit_type = 'usd_credits_per_month' THEN 'usd_credits'
              WHEN limit_type = 'compute_units_per_month' THEN 'compute_units'
              WHEN reset_window IN ('1h','3h','5h','1d','1w','1mo','1y') THEN 'time_window' ELSE 'unknown' END AS layer
          FROM {source})))"""


VIEWS["norm_doc"] = normalized("document_limit")
VIEWS["norm_table"] = normalized("plan_limit")
VIEWS["best_limit"] = """SELECT * FROM norm_doc WHERE tokens_1mo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY plan_id
        ORDER BY tokens_1mo DESC, order_id, line, model_id, limit_value, limit_type) = 1"""
VIEWS["estimate_base"] = f"""SELECT r.plan_id, r.model_id, r.ord, s.price, b.limit_type AS best_type, b.limit_value AS best_value,
        b.tokens_5h, b.tokens_24h, b.tokens_1w, b.tokens_1mo, q.wmq, q.cost_per_task, coalesce(q.efficiency, 1e0) AS efficiency,
        {rank_conf(f"least({conf_rank('b.norm_confidence')}, CASE WHEN q.model_id IS NULL THEN 0 ELSE {conf_rank('q.wmq_confidence')} END)")} AS confidence,
        CASE WHEN b.limit_type = 'credits' AND q.price_in * 0.3e0 + q.price_out * 0.7e0 > 0 THEN
          floor(coalesce(b.limit_value, 0e0) * 0.01e0 * (1e6 / (q.price_in * 0.3e0 + q.price_out * 0.7e0)) + 0.5) END AS model_adjusted_1mo
        FROM plan_model r JOIN scoped_plan s ON s.plan_id = r.plan_id
        JOIN model m ON m.model_id = r.model_id AND m.provider_id = s.provider_id
        LEFT JOIN best_limit b ON b.plan_id = r.plan_id LEFT JOIN efficient q ON q.model_id = r.model_id
        WHERE r.access_type <> 'legacy'"""
VIEWS["estimate"] = """SELECT *, CASE WHEN qa_1mo IS NOT NULL AND price <> 0 THEN
          least(100e0, greatest(0e0, floor(qa_1mo * efficiency / price / 40000e0 * 100 + 0.5))) END AS value_score,
        row_number() OVER (PARTITION BY plan_id ORDER BY wmq DESC NULLS LAST, ord) AS rep_rank FROM (
          SELECT *, floor(tokens_1mo * (wmq / 100) + 0.5) AS qa_1mo, floor(tokens_5h * (wmq / 100) + 0.5) AS qa_5h FROM estimate_base)"""
VIEWS["model_index"] = """SELECT model_id, display_name, provider_id FROM model
        WHERE provider_id IN (SELECT provider_id FROM scoped_plan)"""
VIEWS["usage_date"] = """SELECT p.plan_id, coalesce(l.accessed_date, p.last_verified) AS usage_date FROM plan p LEFT JOIN (
        SELECT plan_id, accessed_date FROM plan_limit
        QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY order_id, line, model_id, limit_value, limit_type) = 1) l ON l.plan_id = p.plan_id"""
VIEWS["plan_model_row"] = f"""SELECT e.*, p.plan_name, p.provider_id, v.provider_name, p.accessed_date AS pricing_date,
        s.observed_at AS score_date, s.coding AS coding_index, u.usage_date,
        coalesce(i.display_name, CAST(e.model_id AS VARCHAR)) AS model_name, {band("e.price")} AS price_band,
        CASE WHEN e.price > 0 THEN {hu_digits("qa_1mo / e.price", 2)} END AS value_ratio, {caveat("e.confidence")} AS caveat
        FROM estimate e JOIN scoped_plan p ON p.plan_id = e.plan_id JOIN provider v ON v.provider_id = p.provider_id
        LEFT JOIN model_index i ON i.model_id = e.model_id LEFT JOIN score s ON s.model_id = e.model_id
        LEFT JOIN usage_date u ON u.plan_id = e.plan_id WHERE {conf_rank("e.confidence")} >= 2"""
_ORDER = "value_score DESC, price ASC NULLS LAST, plan_id, model_id"
VIEWS["value_band"] = f"""SELECT *, row_number() OVER (PARTITION BY price_band ORDER BY {_ORDER}) AS rank FROM plan_model_row
        WHERE price_band <> 'free' AND value_score IS NOT NULL QUALIFY rank <= 10"""
VIEWS["plan_quality"] = """SELECT r.plan_id, r.model_id, q.wmq, q.wmq_confidence, q.cost_per_task, q.observed_at FROM plan_model r
        JOIN rated q ON q.model_id = r.model_id WHERE r.access_type <> 'legacy' AND q.wmq IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY r.plan_id ORDER BY q.wmq DESC, r.ord) = 1"""
VIEWS["quality_band"] = f"""SELECT *, row_number() OVER (PARTITION BY price_band ORDER BY wmq DESC, plan_id, model_id) AS rank FROM (
        SELECT p.plan_id, p.plan_name, p.provider_id, p.price, {band("p.price")} AS price_band, q.model_id, q.wmq,
          q.wmq_confidence AS confidence, q.cost_per_task, q.observed_at AS score_date
        FROM scoped_plan p JOIN plan_quality q ON q.plan_id = p.plan_id WHERE {conf_rank("q.wmq_confidence")} >= 2)
        WHERE price_band <> 'free' QUALIFY rank <= 10"""


def _metric(metric: str) -> str:
    conf = "wmq_confidence" if metric == "wmq" else "confidence"
    return f"""(SELECT '{metric}' AS metric, row_number() OVER (ORDER BY r.{metric} DESC, r.model_id) AS rank, r.model_id,
        i.display_name, i.provider_id, r.{metric} AS metric_value, r.{conf} AS confidence, r.observed_at AS score_date
        FROM rated r JOIN model_index i ON i.model_id = r.model_id
        WHERE r.{metric} IS NOT NULL AND {conf_rank("r." + conf)} >= 2 QUALIFY rank <= 10)"""


VIEWS["model_metric"] = " UNION ALL ".join(_metric(m) for m in ("intelligence", "coding", "agentic", "wmq"))
VIEWS["provider_peak"] = f"""SELECT *, row_number() OVER (ORDER BY peak DESC, provider_id) AS rank FROM (
        SELECT provider_id, provider_name, plan_id, model_id, confidence, {hu_digits("worth", 2)} AS peak FROM (
          SELECT *, tokens_1mo * (coding_index / 100) / price AS worth FROM plan_model_row
          WHERE coding_index IS NOT NULL AND tokens_1mo IS NOT NULL AND price > 0)
        QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY worth DESC, plan_id, model_id) = 1)"""
VIEWS["transparency"] = f"""SELECT *, 100 - uncertainty AS transparency, row_number() OVER (ORDER BY uncertainty, plan_id) AS rank FROM (
        SELECT *, CAST(CASE WHEN score_confidence = 'observed' THEN 0 ELSE 65 END + CASE WHEN pricing = 'observed' THEN 0 ELSE 25 END
          + CASE WHEN usage = 'observed' THEN 0 ELSE 10 END AS BIGINT) AS uncertainty,
          {rank_conf(f"least({conf_rank('score_confidence')}, {conf_rank('pricing')}, {conf_rank('usage')})")} AS confidence
        FROM (SELECT p.plan_id, p.plan_name, p.provider_id, {effective("p.pricing_confidence", "p.accessed_date")} AS pricing,
          coalesce(s.confidence, 'unknown') AS score_confidence, coalesce({rank_conf("u.r")}, 'unknown') AS usage
          FROM scoped_plan p LEFT JOIN (SELECT plan_id, model_id FROM estimate WHERE rep_rank = 1) e ON e.plan_id = p.plan_id
          LEFT JOIN score s ON s.model_id = e.model_id
          LEFT JOIN (SELECT plan_id, min({conf_rank(effective("confidence", "accessed_date"))}) AS r FROM plan_limit
            WHERE limit_type <> 'unknown' OR limit_value IS NOT NULL GROUP BY plan_id) u ON u.plan_id = p.plan_id))"""
VIEWS["best_per_model"] = f"""SELECT model_id, model_name, price_band, plan_id, price, value_score FROM plan_model_row
        WHERE price_band <> 'free' AND value_score IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY model_id, price_band ORDER BY {_ORDER}) = 1"""


def sql(select: str, *views: str, **extra: str) -> str:
    """``WITH`` the named views, what they need (in definition order) and any extra CTEs, then ``select``."""
    import re

    known = {**VIEWS, **extra}
    need: set[str] = set()
    todo = [*views, *extra]
    while todo:
        v = todo.pop()
        if v in need:
            continue
        need.add(v)
        body = known[v]
        todo += [n for n in known if n not in need and n != v and re.search(rf"\b(FROM|JOIN)\s+{n}\b|,\s*{n}\b", body)]
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in known if n in need) + "\n" + select
