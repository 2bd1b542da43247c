"""Estimate, score and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgauge import constants as K
from tollgauge.functions import basics as B
from tollgauge.functions import capacity as C
from tollgauge.operators import estimates as E
from tollgauge.operators import normalize as N
from tollgauge.operators.ordering import percentile_rank
from tollgauge.plans import rankings as R
from tollgauge.queries.registry import query
from tollgauge.queries.sql_views import hu_digits, num_text, sql
from tollgauge.sources.views import Views, as_of


def estimates(v: Views):
    return E.plan_estimates(v.scoped_plan, v.plan_model, v.model, v.limit, v.score, v.LIMIT_ORDER)


def rows(v: Views):
    usage = R.usage_dates(v.limit, v.LIMIT_ORDER, v.plan)
    return R.plan_model_rows(estimates(v), v.scoped_plan, v.provider, v.model, v.score, usage)


_BAND_COLS = (
    "price_band, CAST(rank AS BIGINT) AS rank, provider_id, provider_name, plan_id, plan_name, model_id, model_name, price, wmq, tokens_1mo, "
    "qa_1mo AS quality_adjusted_1mo, value_ratio, value_score, efficiency, confidence"
)


@query("best_value_by_band", sql(f"SELECT {_BAND_COLS} FROM value_band", "value_band"))
def best_value_by_band(v: Views):
    top = R.value_by_band(rows(v))
    return top.select(
        "price_band", F.col("rank").cast("bigint").alias("rank"), "provider_id", "provider_name", "plan_id", "plan_name",
        "model_id", "model_name", "price", "wmq", "tokens_1mo", "quality_adjusted_1mo", "value_ratio", "value_score",
        "efficiency", "confidence",
    )


_SCORE = "model_id, intelligence, coding, agentic, speed, price_in, price_out, cost_per_task, observed_at, confidence"


@query("latest_scores", sql(f"SELECT {_SCORE} FROM score", "score"))
def latest_scores(v: Views):
    return v.score.select(*[c.strip() for c in _SCORE.split(",")])


@query(
    "model_wmq",
    sql(
        """SELECT model_id, wmq, wmq_confidence, concat_ws('; ', CASE WHEN speed IS NULL THEN 'Speed score missing — using 50/100 fallback' END,
           CASE WHEN agentic IS NULL AND coding IS NULL THEN 'No agentic or coding index — WMQ cannot be computed'
             WHEN agentic IS NULL THEN 'agentic index missing — weights redistributed to available indices'
             WHEN coding IS NULL THEN 'coding index missing — weights redistributed to available indices' END) AS notes FROM rated""",
        "rated",
    ),
)
def model_wmq(v: Views):
    notes = F.array_join(C.quality_notes(F.col("agentic"), F.col("coding"), F.col("speed")), "; ")
    return E.score_quality(v.score).select("model_id", "wmq", "wmq_confidence", notes.alias("notes"))


@query(
    "efficiency_multiplier",
    sql("SELECT model_id, cost_per_task, med AS median_cost, efficiency FROM efficient", "efficient"),
)
def efficiency_multiplier(v: Views):
    return E.with_efficiency(v.score).select("model_id", "cost_per_task", "median_cost", "efficiency")


@query(
    "plan_model_estimates",
    sql(
        """SELECT plan_id, model_id, price, best_type, best_value, tokens_5h, tokens_24h, tokens_1w, tokens_1mo, wmq, cost_per_task, efficiency,
           confidence, qa_1mo AS quality_adjusted_1mo, qa_5h AS quality_adjusted_5h, value_score, CAST(rep_rank AS BIGINT) AS rep_rank FROM estimate""",
        "estimate",
    ),
)
def plan_model_estimates(v: Views):
    return E.ranked(estimates(v)).select(
        "plan_id", "model_id", "price", "best_type", "best_value", "tokens_5h", "tokens_24h", "tokens_1w", "tokens_1mo", "wmq",
        "cost_per_task", "efficiency", "confidence", "quality_adjusted_1mo", "quality_adjusted_5h", "value_score",
        F.col("rep_rank").cast("bigint").alias("rep_rank"),
    )


_BLEND = "(q.price_in * 0.3e0 + q.price_out * 0.7e0)"
_NOTES = f"""SELECT e.plan_id, e.model_id, list_filter([
        CASE WHEN q.model_id IS NULL THEN 'No AA data available' WHEN q.speed IS NULL THEN 'Speed score missing — using 50/100 fallback' END,
        CASE WHEN q.model_id IS NULL THEN NULL WHEN q.agentic IS NULL AND q.coding IS NULL THEN 'No agentic or coding index — WMQ cannot be computed'
          WHEN q.agentic IS NULL THEN 'agentic index missing — weights redistributed to available indices'
          WHEN q.coding IS NULL THEN 'coding index missing — weights redistributed to available indices' END,
        CASE WHEN e.best_type = 'credits' AND {_BLEND} <= 0 THEN 'Model cost is zero — cannot compute cost-adjusted estimate'
          WHEN e.best_type = 'credits' AND {_BLEND} > 0 THEN 'Model cost adjustment: blended $' || printf('%.2f', {_BLEND})
            || '/1M tokens (30% input, 70% output). 1 credit = $0.01 assumed.' END,
        CASE WHEN q.cost_per_task > 0 AND q.med IS NOT NULL THEN 'Efficiency multiplier ' || printf('%.3f', q.efficiency) || '× (cost-per-task $'
          || {num_text("q.cost_per_task")} || ' vs median $' || {num_text("q.med")} || ')' ELSE 'No cost-per-task data — efficiency neutral' END
        ], lambda x: x IS NOT NULL) AS ns FROM estimate e LEFT JOIN efficient q ON q.model_id = e.model_id"""


@query("estimate_notes", sql("SELECT plan_id, model_id, array_to_string(ns, ' | ') AS notes FROM noted", "estimate", "efficient", noted=_NOTES))
def estimate_notes(v: Views):
    return estimates(v).select("plan_id", "model_id", F.array_join("notes", " | ").alias("notes"))


@query("plan_notes", sql("SELECT DISTINCT plan_id, unnest(ns) AS note FROM noted", "estimate", "efficient", noted=_NOTES))
def plan_notes(v: Views):
    return E.plan_notes(estimates(v))


@query(
    "cost_adjusted_tokens",
    sql(
        """SELECT plan_id, model_id, best_value, model_adjusted_1mo, floor(model_adjusted_1mo * 168e0 / 730e0 + 0.5) AS model_adjusted_1w,
           floor(model_adjusted_1mo * 24e0 / 730e0 + 0.5) AS model_adjusted_24h, floor(model_adjusted_1mo * 5e0 / 730e0 + 0.5) AS model_adjusted_5h
           FROM c""",
        "plan_limit",
        c="""SELECT l.plan_id, r.model_id, l.limit_value AS best_value, CASE WHEN q.price_in * 0.3e0 + q.price_out * 0.7e0 > 0 THEN floor(coalesce(l.limit_value, 0e0) * 0.01e0 *
           (1e6 / (q.price_in * 0.3e0 + q.price_out * 0.7e0)) + 0.5) END AS model_adjusted_1mo
           FROM (SELECT plan_id, max(limit_value) AS limit_value FROM document_limit WHERE limit_type = 'credits' GROUP BY plan_id) l
           JOIN plan_model r ON r.plan_id = l.plan_id AND r.access_type <> 'legacy' LEFT JOIN score q ON q.model_id = r.model_id""",
    ),
)
def cost_adjusted_tokens(v: Views):
    """Largest credit budget of each plan at the prices of every model it offers; null tokens where a model has no price."""
    credits = (
        N.document_limit(v.limit).where(F.col("limit_type") == "credits").groupBy("plan_id").agg(F.max("limit_value").alias("best_value"))
    )
    refs = v.plan_model.where(F.col("access_type") != "legacy").select("plan_id", "model_id")
    prices = v.score.select("model_id", "price_in", "price_out")
    month = C.cost_adjusted_month(F.lit("credits"), F.col("best_value"), F.col("price_in"), F.col("price_out"))
    out = credits.join(refs, "plan_id").join(prices, "model_id", "left").withColumn("model_adjusted_1mo", month)
    return out.select(
        "plan_id", "model_id", "best_value", "model_adjusted_1mo",
        *[C.cost_adjusted_window(F.col("model_adjusted_1mo"), t).alias(f"model_adjusted_{t}") for t in ("1w", "24h", "5h")],
    )


@query(
    "quality_by_band",
    sql(
        """SELECT price_band, CAST(rank AS BIGINT) AS rank, plan_id, plan_name, provider_id, price, model_id, wmq, confidence, cost_per_task, score_date
           FROM quality_band""",
        "quality_band",
    ),
)
def quality_by_band(v: Views):
    q = R.quality_by_band(v.scoped_plan, v.plan_model, v.score)
    return q.select(
        "price_band", F.col("rank").cast("bigint").alias("rank"), "plan_id", "plan_name", "provider_id", "price", "model_id",
        "wmq", "confidence", "cost_per_task", "score_date",
    )


@query(
    "model_metric_top",
    sql("SELECT metric, CAST(rank AS BIGINT) AS rank, model_id, display_name, provider_id, metric_value, confidence, score_date FROM model_metric", "model_metric"),
)
def model_metric_top(v: Views):
    index = R.model_index(v.model, v.scoped_plan)
    frames = [R.metric_ranking(v.score, index, m) for m in ("intelligence", "coding", "agentic", "wmq")]
    return R.union_all(frames).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "best_plan_per_model_band",
    sql(
        """SELECT s.model_id, s.model_name, q.wmq, l.plan_id AS low_plan, m.plan_id AS mid_plan, h.plan_id AS high_plan, l.value_score AS low_score,
           concat_ws(' ', CASE WHEN l.plan_id IS NULL THEN 'No low-cost ($0.01–30) plan offers this model.' END,
             CASE WHEN m.plan_id IS NULL THEN 'No mid-cost ($30.01–80) plan offers this model.' END,
             CASE WHEN h.plan_id IS NULL THEN 'No high-cost (>$80) plan offers this model.' END) AS caveats
           FROM (SELECT DISTINCT model_id, model_name FROM plan_model_row) s LEFT JOIN rated q ON q.model_id = s.model_id
           LEFT JOIN best_per_model l ON l.model_id = s.model_id AND l.price_band = 'low'
           LEFT JOIN best_per_model m ON m.model_id = s.model_id AND m.price_band = 'mid'
           LEFT JOIN best_per_model h ON h.model_id = s.model_id AND h.price_band = 'high'""",
        "plan_model_row", "rated", "best_per_model",
    ),
)
def best_plan_per_model_band(v: Views):
    b = R.best_plan_per_model(rows(v), v.score)
    return b.select(
        "model_id", "model_name", "wmq",
        *[F.col(f"best_{x}.plan_id").alias(f"{x}_plan") for x in K.PRICE_BANDS],
        F.col("best_low.value_score").alias("low_score"), F.array_join("caveats", " ").alias("caveats"),
    )


@query(
    "provider_peak_value",
    sql("SELECT CAST(rank AS BIGINT) AS rank, provider_id, provider_name, peak, plan_id, model_id, confidence FROM provider_peak", "provider_peak"),
)
def provider_peak_value(v: Views):
    return R.provider_peak(rows(v)).select("rank", "provider_id", "provider_name", "peak", "plan_id", "model_id", "confidence")


_TRANSPARENCY = "plan_id, plan_name, provider_id, uncertainty, transparency, score_confidence, pricing, usage, confidence"


def _transparency(v: Views):
    rep = E.representative(estimates(v)).select("plan_id", "model_id")
    return R.transparency(v.scoped_plan, rep, v.score, v.limit, as_of())


@query("transparency_ranking", sql(f"SELECT CAST(rank AS BIGINT) AS rank, {_TRANSPARENCY} FROM transparency", "transparency"))
def transparency_ranking(v: Views):
    return _transparency(v).select("rank", *[c.strip() for c in _TRANSPARENCY.split(",")])


def _long(select: str) -> str:
    return f"SELECT ranking_type, price_band, CAST(rank AS BIGINT) AS rank, provider_id, plan_id, model_id, metric_value, confidence FROM ({select})"


_LONG = " UNION ALL BY NAME ".join(
    _long(s)
    for s in (
        "SELECT *, 'value' AS ranking_type, value_score AS metric_value FROM value_band",
        "SELECT *, 'quality' AS ranking_type, wmq AS metric_value FROM quality_band",
        "SELECT *, metric AS ranking_type, NULL AS price_band, NULL AS plan_id FROM model_metric",
        "SELECT *, 'provider' AS ranking_type, peak AS metric_value, NULL AS price_band FROM provider_peak",
        "SELECT *, 'transparency' AS ranking_type, CAST(transparency AS DOUBLE) AS metric_value, NULL AS price_band, NULL AS model_id FROM transparency",
        """SELECT model_id, price_band, plan_id, 1 AS rank, NULL AS provider_id, NULL AS confidence, 'per_model' AS ranking_type,
           value_score AS metric_value FROM best_per_model""",
    )
)


@query("rankings_long", sql(_LONG, "value_band", "quality_band", "model_metric", "provider_peak", "transparency", "best_per_model"))
def rankings_long(v: Views):
    from tollgauge.plans.pipeline import all_rankings

    return all_rankings(
        v.scoped_plan, v.plan_model, v.model, v.provider, v.limit, v.score, v.LIMIT_ORDER, as_of()
    ).select(*R.LONG_COLUMNS)


@query(
    "plan_model_rows",
    sql(
        f"""SELECT plan_id, model_id, provider_id, model_name, price, price_band, value_ratio, confidence, caveat AS caveats, score_date, pricing_date,
           usage_date, least(score_date, pricing_date, usage_date) AS oldest_date,
           CASE price_band WHEN 'low' THEN 'Budget' WHEN 'mid' THEN 'Standard' WHEN 'high' THEN 'Premium' END AS band_label FROM plan_model_row""",
        "plan_model_row",
    ),
)
def plan_model_rows(v: Views):
    return rows(v).select(
        "plan_id", "model_id", "provider_id", "model_name", "price", "price_band", "value_ratio", "confidence",
        F.array_join("caveats", " ").alias("caveats"), "score_date", "pricing_date", "usage_date",
        B.oldest_date(F.col("score_date"), F.col("pricing_date"), F.col("usage_date")).alias("oldest_date"),
        B.band_label(F.col("price_band")).alias("band_label"),
    )


# Benchmarks: four named results and one unweighted name per model, from its latest scores.
_BENCH = """SELECT model_id, unnest(['SWE-bench-verified', 'HumanEval', 'Aider-polyglot', 'LiveCodeBench', 'MBPP']) AS name,
    unnest([agentic, coding, price_out, speed, intelligence]) AS score, unnest([true, true, false, true, true]) AS higher_is_better FROM score"""


def benchmarks(v: Views):
    def one(name: str, score: str, higher: bool):
        return F.struct(F.lit(name).alias("name"), F.col(score).alias("score"), F.lit(higher).alias("higher_is_better"))

    return v.score.select(
        "model_id",
        F.explode(
            F.array(
                one("SWE-bench-verified", "agentic", True), one("HumanEval", "coding", True), one("Aider-polyglot", "price_out", False),
                one("LiveCodeBench", "speed", True), one("MBPP", "intelligence", True),
            )
        ).alias("b"),
    ).select("model_id", "b.*")


_W = "(CASE name WHEN 'SWE-bench-verified' THEN 0.45e0 WHEN 'HumanEval' THEN 0.25e0 WHEN 'Aider-polyglot' THEN 0.2e0 ELSE 0.1e0 END)"
_BENCH_CTE = {
    "bench": _BENCH,
    "bench_known": """SELECT model_id, name, CASE WHEN higher_is_better THEN least(100e0, score / 100 * 100)
        ELSE 100e0 - least(100e0, score / 100 * 100) END AS s FROM bench WHERE name <> 'MBPP' AND score IS NOT NULL""",
    "bench_wide": """SELECT model_id, max(CASE WHEN name = 'SWE-bench-verified' THEN s END) AS a, max(CASE WHEN name = 'HumanEval' THEN s END) AS b,
        max(CASE WHEN name = 'Aider-polyglot' THEN s END) AS c, max(CASE WHEN name = 'LiveCodeBench' THEN s END) AS d FROM bench_known GROUP BY model_id""",
    "bench_index": "SELECT model_id, "
    + hu_digits(
        "(coalesce(a, 0e0) * 0.45e0 + coalesce(b, 0e0) * 0.25e0 + coalesce(c, 0e0) * 0.2e0 + coalesce(d, 0e0) * 0.1e0)"
        " / (0e0 + CASE WHEN a IS NULL THEN 0e0 ELSE 0.45e0 END + CASE WHEN b IS NULL THEN 0e0 ELSE 0.25e0 END"
        " + CASE WHEN c IS NULL THEN 0e0 ELSE 0.2e0 END + CASE WHEN d IS NULL THEN 0e0 ELSE 0.1e0 END)", 1,
    )
    + " AS benchmark_index FROM bench_wide",
}


@query("model_benchmark_index", sql("SELECT model_id, benchmark_index FROM bench_index", "score", **_BENCH_CTE))
def model_benchmark_index(v: Views):
    return E.benchmark_index(benchmarks(v))


# Plan features read from part attributes.
_FEATURES = """SELECT p_partkey AS plan_id, p_type IN ('ECONOMY', 'STANDARD') AS agent, p_size % 2 = 0 AS files, p_size > 10 AS api, p_size > 20 AS cli,
    p_name LIKE '%gear' AS custom, p_name LIKE 'red%' AS web, p_type = 'PROMO' AS priority, p_type IN ('MEDIUM', 'LARGE') AS team,
    p_type = 'LARGE' AS sso, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 4e0 END AS context_k, p_size % 6 AS ides FROM part"""


def features(v: Views):
    size, name, kind = F.col("p_size"), F.col("p_name"), F.col("p_type")
    return v.table("part").select(
        F.col("p_partkey").alias("plan_id"),
        kind.isin("ECONOMY", "STANDARD").alias("agent_capabilities"),
        (size % 2 == 0).alias("file_uploads"),
        (size > 10).alias("api_access"),
        (size > 20).alias("cli_access"),
        name.endswith("gear").alias("custom_instructions"),
        name.startswith("red").alias("web_search"),
        (kind == "PROMO").alias("priority_access"),
        kind.isin("MEDIUM", "LARGE").alias("team_features"),
        (kind == "LARGE").alias("sso"),
        F.when(size % 5 != 0, size * 4.0).alias("code_context_length_k"),
        (size % 6).alias("ide_count"),
    )


def scored_plans(v: Views):
    """Every plan with its price, quality inputs and overall score."""
    f = features(v)
    feature = C.feature_score({n: F.col(n) for n in K.FEATURE_WEIGHTS}, F.col("ide_count"))
    tokens = N.best_limit(N.normalize_limits(N.document_limit(v.limit)), v.LIMIT_ORDER).select("plan_id", "tokens_1mo")
    wmq = E.best_quality_per_plan(v.plan_model, v.score).select("plan_id", F.col("wmq").alias("plan_wmq"))
    bench = E.benchmark_per_plan(v.plan_model, E.benchmark_index(benchmarks(v)))
    plans = v.plan.select("plan_id", B.effective_price(F.col("monthly_usd"), F.col("annual_usd")).alias("price"))
    base = (
        plans.join(f.select("plan_id", feature.alias("feature_score")), "plan_id")
        .join(tokens, "plan_id", "left")
        .join(wmq, "plan_id", "left")
        .join(bench, "plan_id", "left")
        .join(E.cost_per_message(plans, v.limit, v.LIMIT_ORDER), "plan_id", "left")
    )
    return E.score_plans(base)


_PLAN_SCORE = f"""SELECT plan_id, price, tokens_1mo, plan_wmq, benchmark_index, feature_score, cost_score, cost_per_message, notes,
             CASE WHEN tokens_1mo IS NOT NULL AND price > 0 THEN least(100e0, floor(tokens_1mo * (quality / 100) / price / 40000e0 * 100 + 0.5))
               WHEN tokens_1mo IS NOT NULL AND price = 0 THEN least(100e0, floor(quality * 0.6e0 + feature_score * 0.4e0 + 0.5))
               ELSE floor(cost_score * 0.35e0 + bench * 0.4e0 + feature_score * 0.25e0 + 0.5) END AS overall
           FROM (SELECT p.plan_id, least(monthly_usd, annual_usd) AS price, b.tokens_1mo, w.plan_wmq, x.benchmark_index,
             coalesce(w.plan_wmq, x.benchmark_index, 0e0) AS quality, coalesce(x.benchmark_index, 0e0) AS bench,
             floor((CASE WHEN agent THEN 20e0 ELSE 0e0 END + CASE WHEN context_k > 0 THEN 15e0 ELSE 0e0 END + CASE WHEN files THEN 10e0 ELSE 0e0 END
               + CASE WHEN api THEN 10e0 ELSE 0e0 END + CASE WHEN cli THEN 10e0 ELSE 0e0 END + CASE WHEN custom THEN 8e0 ELSE 0e0 END
               + CASE WHEN web THEN 7e0 ELSE 0e0 END + CASE WHEN priority THEN 7e0 ELSE 0e0 END + CASE WHEN team THEN 7e0 ELSE 0e0 END
               + CASE WHEN sso THEN 4e0 ELSE 0e0 END + least(1e0, ides / 3) * 2e0) / 100e0 * 100 + 0.5) AS feature_score,
             CASE WHEN least(monthly_usd, annual_usd) IS NULL THEN 50e0 WHEN least(monthly_usd, annual_usd) = 0 THEN 100e0
               ELSE greatest(10e0, floor(100e0 - log2(least(monthly_usd, annual_usd) / 20e0 + 0.5) * 30 + 0.5)) END AS cost_score,
             CASE WHEN m.monthly <> 0 THEN {hu_digits("least(monthly_usd, annual_usd) / m.monthly", 4)} END AS cost_per_message,
             concat_ws(' ', CASE WHEN x.benchmark_index IS NULL THEN 'Benchmark index defaulted to 0 — no coding benchmark data available for included models.' END,
               CASE WHEN least(monthly_usd, annual_usd) IS NULL THEN 'Pricing unknown — QAMU requires a price; fell back to legacy score.' END,
               CASE WHEN b.tokens_1mo IS NULL THEN 'Usage limits unknown — QAMU cannot be computed; fell back to legacy score.' END) AS notes
             FROM plan p JOIN feat f ON f.plan_id = p.plan_id LEFT JOIN best_limit b ON b.plan_id = p.plan_id
             LEFT JOIN (SELECT plan_id, wmq AS plan_wmq FROM plan_quality) w ON w.plan_id = p.plan_id
             LEFT JOIN (SELECT r.plan_id, max(i.benchmark_index) AS benchmark_index FROM plan_model r JOIN bench_index i ON i.model_id = r.model_id
               WHERE access_type <> 'legacy' GROUP BY r.plan_id) x ON x.plan_id = p.plan_id
             LEFT JOIN (SELECT plan_id, CASE WHEN limit_type = 'messages_per_day' THEN limit_value * 30 ELSE limit_value END AS monthly FROM plan_limit
               WHERE limit_type IN ('messages_per_month', 'messages_per_day') QUALIFY row_number() OVER (PARTITION BY plan_id
               ORDER BY order_id, line, model_id, limit_value, limit_type) = 1) m ON m.plan_id = p.plan_id)"""
#: Views that ``scored`` (every plan with its overall score) needs.
SCORED = {"feat": _FEATURES, **_BENCH_CTE, "scored": _PLAN_SCORE}


@query("plan_score_branches", sql("SELECT * FROM scored", "plan", "best_limit", "plan_quality", "plan_limit", **SCORED))
def plan_score_branches(v: Views):
    return scored_plans(v).select(
        "plan_id", "price", "tokens_1mo", "plan_wmq", "benchmark_index", "feature_score", "cost_score", "cost_per_message",
        F.array_join("notes", " ").alias("notes"), "overall",
    )


#: View ``tasks``: every model with its task costs and composite.
TASKS = {
    "tasks": """SELECT *, CASE WHEN cost100 > 0 THEN intel / cost100 END AS intel_per_cost, CASE WHEN cost100 > 0 THEN intel * tps / cost100 END AS composite FROM (
        SELECT model_id, coalesce(intelligence, 0e0) AS intel, coalesce(speed, 1e0) AS tps,
          (price_in * 7000 / 1000000 + coalesce(cost_per_task, price_in) * 3000 / 1000000 + (1000 + 10 * coalesce(agentic, 0e0)) * price_out / 1000000) * 100 AS cost100
        FROM (SELECT * REPLACE (CASE WHEN price_in > 0 THEN price_in END AS price_in) FROM score))"""
}


def task_models(v: Views):
    """Models without a positive input price stay, with null costs."""
    s = v.score.withColumn("price_in", F.when(F.col("price_in") > 0, F.col("price_in")))
    return s.select(
        "model_id", F.coalesce("intelligence", F.lit(0.0)).alias("intel"), F.coalesce("speed", F.lit(1.0)).alias("tps"), "price_in",
        F.col("cost_per_task").alias("price_cache"), "price_out",
        (F.lit(1000) + F.lit(10) * F.coalesce("agentic", F.lit(0.0))).alias("out_tokens"),
    )


@query("task_cost_efficiency", sql("SELECT *, composite / (SELECT max(composite) FROM tasks) AS share_of_best FROM tasks", "score", **TASKS))
def task_cost_efficiency(v: Views):
    return E.task_efficiency(task_models(v)).select("model_id", "intel", "tps", "cost100", "intel_per_cost", "composite", "share_of_best")


def radar(v: Views, n: int = 10):
    """Five 0-100 axes per model; ranked lists take precedence over raw scores."""
    s = v.score
    index = R.model_index(v.model, v.scoped_plan)
    speed = percentile_rank(s.where(F.col("speed") > 0), "speed", "speed_pct")
    blended = s.withColumn("blend", C.blended_price(F.col("price_in"), F.col("price_out")))
    price = percentile_rank(blended, "blend", "price_pct")
    out = blended.join(speed, "speed", "left").join(price, "blend", "left")
    for metric in ("intelligence", "coding", "agentic"):
        # top-N lists, so each of these joins has at most N rows on its right side
        r = R.metric_ranking(s, index, metric, n=n).select(
            "model_id", F.col("metric_value").alias(f"{metric}_ranked"), F.col("display_name").alias(f"{metric}_name")
        )
        out = out.join(F.broadcast(r), "model_id", "left")
    zero = F.lit(0.0)
    axes = {
        "intelligence": F.coalesce("intelligence_ranked", "intelligence", zero),
        "coding": F.coalesce("coding_ranked", "coding", zero),
        "agentic": F.coalesce("agentic_ranked", "agentic", "coding", zero),
        "speed": F.coalesce("speed_pct", zero),
        "price": F.when(F.col("price_pct").isNotNull(), F.lit(100.0) - F.col("price_pct")).otherwise(zero),
    }
    name = F.coalesce("intelligence_name", "coding_name", "agentic_name", F.col("model_id").cast("string"))
    return out.select("model_id", name.alias("name"), *[B.half_up(x).alias(k) for k, x in axes.items()])


_RADAR = """SELECT s.model_id, coalesce(i.display_name, c.display_name, a.display_name, CAST(s.model_id AS VARCHAR)) AS name,
    floor(coalesce(i.metric_value, s.intelligence, 0e0) + 0.5) AS intelligence, floor(coalesce(c.metric_value, s.coding, 0e0) + 0.5) AS coding,
    floor(coalesce(a.metric_value, s.agentic, s.coding, 0e0) + 0.5) AS agentic,
    floor(coalesce(CAST(sp.n AS DOUBLE) / (SELECT count(*) FROM score WHERE speed > 0) * 100, 0e0) + 0.5) AS speed,
    floor(CASE WHEN bp.n IS NULL THEN 0e0 ELSE 100e0 - CAST(bp.n AS DOUBLE) / (SELECT count(*) FROM bl WHERE b IS NOT NULL) * 100 END + 0.5) AS price
    FROM score s LEFT JOIN bl ON bl.model_id = s.model_id
    LEFT JOIN (SELECT DISTINCT x.speed, (SELECT count(*) FROM score y WHERE y.speed > 0 AND y.speed <= x.speed) AS n FROM score x WHERE x.speed > 0) sp ON sp.speed = s.speed
    LEFT JOIN (SELECT DISTINCT x.b, (SELECT count(*) FROM bl y WHERE y.b <= x.b) AS n FROM bl x WHERE x.b IS NOT NULL) bp ON bp.b = bl.b
    LEFT JOIN model_metric i ON i.model_id = s.model_id AND i.metric = 'intelligence'
    LEFT JOIN model_metric c ON c.model_id = s.model_id AND c.metric = 'coding'
    LEFT JOIN model_metric a ON a.model_id = s.model_id AND a.metric = 'agentic'"""


@query("radar_axes", sql(_RADAR, "score", "model_metric", bl="SELECT model_id, price_in * 0.3e0 + price_out * 0.7e0 AS b FROM score"))
def radar_axes(v: Views):
    return radar(v)


@query(
    "radar_default_models",
    sql("SELECT model_id, CAST(rank AS BIGINT) AS rank FROM model_metric WHERE metric = 'wmq' AND rank <= 5 AND model_id IN (SELECT model_id FROM score)", "model_metric", "score"),
)
def radar_default_models(v: Views):
    """Default comparison set: the five best by quality that have a profile."""
    index = R.model_index(v.model, v.scoped_plan)
    top = R.metric_ranking(v.score, index, "wmq", n=5)
    chosen = top.join(v.score.select("model_id"), "model_id", "left_semi")
    return chosen.select("model_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "scored_plans_best_estimate",
    sql(
        """SELECT p.plan_id, e.model_id, e.value_score, e.confidence FROM scoped_plan p
           LEFT JOIN (SELECT * FROM estimate WHERE rep_rank = 1) e ON e.plan_id = p.plan_id""",
        "scoped_plan", "estimate",
    ),
)
def scored_plans_best_estimate(v: Views):
    best = E.representative(estimates(v)).select("plan_id", "model_id", "value_score", "confidence")
    return v.scoped_plan.select("plan_id").join(best, "plan_id", "left")
