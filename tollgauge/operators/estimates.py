"""Plan x model estimates: capacity, quality and price combined into value scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgauge import constants as K
from tollgauge.constants import NormalizationConfig
from tollgauge.functions import capacity as C
from tollgauge.functions.basics import effective_price, fixed_text, number_text, round_digits, weaker
from tollgauge.operators.normalize import TARGETS, best_limit, document_limit, normalize_limits
from tollgauge.operators.ordering import exact_median, global_rank, group_rank, latest
from tollgauge.session import reused

SCORE_COLUMNS = [
    "intelligence", "coding", "agentic", "speed", "price_in", "price_out", "cost_per_task", "observed_at", "confidence",
]


def score_quality(scores: DataFrame) -> DataFrame:
    """Scores with weighted quality and the confidence it carries."""
    a, c, s = F.col("agentic"), F.col("coding"), F.col("speed")
    return scores.withColumns(
        {"wmq": C.model_quality(a, c, s), "wmq_confidence": C.quality_confidence(a, c, F.col("confidence"))}
    )


def median_cost(scores: DataFrame) -> DataFrame:
    """Exact median of the positive costs per task; one row."""
    return exact_median(scores.where(F.col("cost_per_task") > 0), "cost_per_task")


def with_efficiency(scores: DataFrame) -> DataFrame:
    """Efficiency multiplier against the median, fed in as a one-value subquery."""
    return scores.withColumn("median_cost", median_cost(scores).scalar()).withColumn(
        "efficiency", C.efficiency_multiplier(F.col("cost_per_task"), F.col("median_cost"))
    )


def usable_refs(plan_models: DataFrame, plans: DataFrame, models: DataFrame) -> DataFrame:
    """Non-legacy references to models that the plan's own provider lists."""
    refs = plan_models.where(F.col("access_type") != "legacy")
    owned = refs.join(plans.select("plan_id", "provider_id"), "plan_id")
    return owned.join(models.select("model_id", "provider_id"), ["model_id", "provider_id"], "left_semi").drop("provider_id")


def plan_estimates(
    plans: DataFrame,
    plan_models: DataFrame,
    models: DataFrame,
    limits: DataFrame,
    scores: DataFrame,
    limit_order: tuple[str, ...],
    cfg: NormalizationConfig | None = None,
) -> DataFrame:
    """Estimate rows of every plan and usable model; :func:`representative` and :func:`ranked` order them inside the plan.

    Limits shrink to one row per plan before they meet the model references, and scores to one row per
    model, so the only fan-out is the plan-model pairs themselves.
    """
    wanted = document_limit(limits).join(plans.select("plan_id"), "plan_id", "left_semi")
    best = best_limit(normalize_limits(wanted, cfg), limit_order).select(
        "plan_id",
        F.col("limit_type").alias("best_type"),
        F.col("limit_value").alias("best_value"),
        *[f"tokens_{t}" for t in TARGETS],
        F.col("confidence").alias("usage_confidence"),
    )
    priced = plans.select("plan_id", effective_price(F.col("monthly_usd"), F.col("annual_usd")).alias("price"))
    rated = with_efficiency(score_quality(scores)).select(
        "model_id", "wmq", "wmq_confidence", "agentic", "coding", "speed", "price_in", "price_out", "cost_per_task", "median_cost", "efficiency",
        F.lit(True).alias("scored"),
    )
    base = (
        usable_refs(plan_models, plans, models)
        .join(priced, "plan_id")
        .join(best, "plan_id", "left")
        .join(rated, "model_id", "left")
    )
    wmq, mult = F.col("wmq"), F.coalesce(F.col("efficiency"), F.lit(1.0))
    cost_month = C.cost_adjusted_month(F.col("best_type"), F.col("best_value"), F.col("price_in"), F.col("price_out"))
    conf_usage = F.coalesce(F.col("usage_confidence"), F.lit("unknown"))
    conf_model = F.when(F.col("scored"), F.col("wmq_confidence")).otherwise("unknown")
    est = base.withColumns({"model_adjusted_1mo": cost_month, "confidence": weaker(conf_usage, conf_model)})
    out = {f"quality_adjusted_{t}": C.quality_adjusted(F.col(f"tokens_{t}"), wmq) for t in TARGETS}
    out.update({f"model_adjusted_{t}": C.cost_adjusted_window(F.col("model_adjusted_1mo"), t) for t in TARGETS if t != "1mo"})
    est = est.withColumns(out).withColumns(
        {
            "efficiency": mult,
            "value_score": C.value_score(F.col("quality_adjusted_1mo"), F.col("price"), mult),
            "engine_version": F.lit(K.ENGINE_VERSION),
            "notes": estimate_notes(F.col("best_type")),
        }
    )
    return est.drop("scored", "wmq_confidence", "usage_confidence", "agentic", "coding", "speed", "price_in", "price_out", "median_cost")


def _by_quality() -> list[Column]:
    return [F.col("wmq").desc_nulls_last(), F.col("ord").asc()]


def representative(estimates: DataFrame) -> DataFrame:
    """The estimate of best quality per plan; every task keeps one row per plan before the shuffle, whatever the plan's share of pairs."""
    return latest(estimates, ["plan_id"], _by_quality())


def ranked(estimates: DataFrame) -> DataFrame:
    """Adds ``rep_rank``, the place by quality inside the plan. A plan with a large share of the pairs is spread over ranges of the order."""
    return group_rank(reused(estimates), ["plan_id"], _by_quality(), "rep_rank")


def estimate_notes(limit_type: Column) -> Column:
    """Notes of one estimate, in order: quality gaps, price of a credit budget, efficiency. Reads the rated score columns."""
    a, c, s, p_in, p_out, cost, median = (
        F.col(n) for n in ("agentic", "coding", "speed", "price_in", "price_out", "cost_per_task", "median_cost")
    )
    blend = C.blended_price(p_in, p_out)
    quality = F.when(F.col("scored"), C.quality_notes(a, c, s)).otherwise(F.array(F.lit(K.NOTE_NO_SCORE)))
    priced = F.concat(F.lit(K.NOTE_BLENDED[0]), fixed_text(blend, 2), F.lit(K.NOTE_BLENDED[1]))
    budget = F.when((limit_type == "credits") & blend.isNotNull(), F.when(blend <= 0, K.NOTE_ZERO_COST).otherwise(priced))
    head, per_task, against, tail = (F.lit(t) for t in K.NOTE_EFFICIENCY)
    factor = fixed_text(C.efficiency_multiplier(cost, median), 3)
    measured = F.concat(head, factor, per_task, number_text(cost), against, number_text(median), tail)
    efficiency = F.when((cost > 0) & median.isNotNull(), measured).otherwise(K.NOTE_NEUTRAL)
    return F.concat(quality, F.array_compact(F.array(budget, efficiency)))


def plan_notes(estimates: DataFrame) -> DataFrame:
    """Distinct notes over the estimates of each plan, one row per plan and note."""
    return estimates.select("plan_id", F.explode("notes").alias("note")).distinct()


def best_quality_per_plan(plan_models: DataFrame, scores: DataFrame) -> DataFrame:
    """Highest-quality non-legacy model of each plan, first reference on ties, any provider."""
    rated = score_quality(scores).where(F.col("wmq").isNotNull())
    refs = plan_models.where(F.col("access_type") != "legacy").join(rated, "model_id")
    return latest(refs, ["plan_id"], [F.col("wmq").desc(), F.col("ord").asc()])


def benchmark_index(benchmarks: DataFrame) -> DataFrame:
    """Weighted benchmark index per model; names without a weight are ignored.

    Expects model_id, name, score, higher_is_better. One pass of conditional sums, so models with very
    many rows combine on the map side. Sums run over the four known names in a fixed order.
    """
    normal = F.least(F.lit(100.0), F.col("score") / 100 * 100)
    oriented = F.when(F.col("higher_is_better"), normal).otherwise(F.lit(100.0) - normal)
    known = benchmarks.where(F.col("name").isin(list(K.BENCHMARK_WEIGHTS)) & F.col("score").isNotNull())
    per_name = known.groupBy("model_id", "name").agg(F.sum(oriented).alias("s"), F.count("*").alias("n"))
    aggs = []
    for i, name in enumerate(K.BENCHMARK_WEIGHTS):
        hit = F.col("name") == name
        aggs += [F.max(F.when(hit, F.col("s"))).alias(f"s{i}"), F.max(F.when(hit, F.col("n"))).alias(f"n{i}")]
    wide = per_name.groupBy("model_id").agg(*aggs)
    total, weight = F.lit(0.0), F.lit(0.0)
    for i, w in enumerate(K.BENCHMARK_WEIGHTS.values()):
        total = total + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * w
        weight = weight + F.coalesce(F.col(f"n{i}"), F.lit(0)) * w
    return wide.select("model_id", round_digits(total / weight, 1).alias("benchmark_index"))


def benchmark_per_plan(plan_models: DataFrame, index: DataFrame) -> DataFrame:
    """Best index over the plan's non-legacy models."""
    refs = plan_models.where(F.col("access_type") != "legacy").select("plan_id", "model_id")
    return refs.join(index, "model_id").groupBy("plan_id").agg(F.max("benchmark_index").alias("benchmark_index"))


def cost_per_message(plans: DataFrame, limits: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Price per message from the first monthly or daily message limit, four decimals."""
    messages = limits.where(F.col("limit_type").isin("messages_per_month", "messages_per_day"))
    first = latest(messages, ["plan_id"], [F.col(c).asc() for c in order])
    monthly = F.when(F.col("limit_type") == "messages_per_day", F.col("limit_value") * 30).otherwise(F.col("limit_value"))
    return plans.join(first.select("plan_id", monthly.alias("monthly")), "plan_id", "left").select(
        "plan_id",
        F.when(F.col("monthly") != 0, round_digits(F.col("price") / F.col("monthly"), 4)).alias("cost_per_message"),
    )


def score_plans(plans: DataFrame, with_notes: bool = True) -> DataFrame:
    """Overall score per plan. Expects price, tokens_1mo, plan_wmq, benchmark_index, feature_score."""
    bench = F.coalesce(F.col("benchmark_index"), F.lit(0.0))
    quality = F.coalesce(F.col("plan_wmq"), bench)
    out = plans.withColumn("cost_score", C.cost_score(F.col("price"))).withColumn(
        "overall",
        C.plan_score(F.col("tokens_1mo"), quality, F.col("price"), F.col("cost_score"), bench, F.col("feature_score")),
    )
    if not with_notes:
        return out
    notes = F.array_compact(
        F.array(
            F.when(F.col("benchmark_index").isNull(), F.lit(K.NOTE_NO_BENCHMARK)),
            F.when(F.col("price").isNull(), F.lit(K.NOTE_NO_PRICE)),
            F.when(F.col("tokens_1mo").isNull(), F.lit(K.NOTE_NO_USAGE)),
        )
    )
    return out.withColumn("notes", notes)


def ordered_plans(scored: DataFrame) -> DataFrame:
    """All scored plans, best overall score first, with their position."""
    return global_rank(reused(scored), [F.col("overall").desc(), F.col("plan_id").asc()], "position")


def ordered_efficiency(models: DataFrame) -> DataFrame:
    """Rows of :func:`task_efficiency`, best composite first and those without one last, with their position."""
    return global_rank(reused(models), [F.col("composite").desc_nulls_last(), F.col("model_id").asc()], "position")


def task_efficiency(models: DataFrame) -> DataFrame:
    """Cost of 100 tasks, quality per cost, composite and its share of the best composite."""
    cost = C.task_cost(F.col("price_in"), F.col("price_cache"), F.col("price_out"), F.col("out_tokens")) * 100
    rows = models.withColumn("cost100", cost).withColumns(
        {
            "intel_per_cost": F.when(F.col("cost100") > 0, F.col("intel") / F.col("cost100")),
            "composite": F.when(F.col("cost100") > 0, F.col("intel") * F.col("tps") / F.col("cost100")),
        }
    )
    best = rows.agg(F.max("composite")).scalar()
    return rows.withColumn("share_of_best", F.col("composite") / best)


