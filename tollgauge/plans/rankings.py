"""The thirteen ranking tables and the long table that holds them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgauge import constants as K
from tollgauge.functions import capacity as C
from tollgauge.functions.basics import (
    at_least,
    confidence_caveats,
    confidence_rank,
    effective_confidence,
    effective_price,
    price_band,
    rank_confidence,
    round_digits,
)
from tollgauge.operators.estimates import best_quality_per_plan, score_quality
from tollgauge.operators.ordering import global_rank, latest, top_overall, top_per_group
from tollgauge.session import reused


def by_value() -> list[Column]:
    return [
        F.col("value_score").desc_nulls_last(),
        F.col("price").asc_nulls_last(),
        F.col("plan_id").asc(),
        F.col("model_id").asc(),
    ]


def model_index(models: DataFrame, plans: DataFrame) -> DataFrame:
    """Display name and owner of each model: the first offering provider that has a plan in scope."""
    offering = models.join(plans.select("provider_id").distinct(), "provider_id", "left_semi")
    return latest(offering, ["model_id"], [F.col("provider_id").asc()]).select("model_id", "display_name", "provider_id")


def usage_dates(limits: DataFrame, order: tuple[str, ...], plans: DataFrame) -> DataFrame:
    """Access date of each plan's first limit that has one, else the date the plan was last verified."""
    dated = limits.where(F.col("accessed_date").isNotNull())
    first = latest(dated, ["plan_id"], [F.col(c).asc() for c in order]).select("plan_id", "accessed_date")
    known = plans.select("plan_id", "last_verified").join(first, "plan_id", "left")
    return known.select("plan_id", F.coalesce("accessed_date", "last_verified").alias("usage_date"))


def plan_model_rows(
    estimates: DataFrame,
    plans: DataFrame,
    providers: DataFrame,
    models: DataFrame,
    scores: DataFrame,
    usage: DataFrame,
    min_confidence: str = "assumed",
) -> DataFrame:
    """Estimates with plan, provider and model details; weak rows dropped early."""
    kept = estimates.where(at_least(F.col("confidence"), min_confidence)).drop("price")
    info = plans.select(
        "plan_id", "plan_name", "provider_id", effective_price(F.col("monthly_usd"), F.col("annual_usd")).alias("price"),
        F.col("accessed_date").alias("pricing_date"),
    ).join(providers.select("provider_id", "provider_name"), "provider_id")
    names = model_index(models, plans).select("model_id", "display_name")
    dated = scores.select("model_id", F.col("observed_at").alias("score_date"), F.col("coding").alias("coding_index"))
    rows = (
        kept.join(info, "plan_id")
        .join(names, "model_id", "left")
        .join(dated, "model_id", "left")
        .join(usage, "plan_id", "left")
    )
    return rows.withColumns(
        {
            "model_name": F.coalesce("display_name", F.col("model_id").cast("string")),
            "price_band": price_band(F.col("price")),
            "value_ratio": C.value_ratio(F.col("quality_adjusted_1mo"), F.col("price")),
            "caveats": confidence_caveats(F.col("confidence")),
        }
    ).drop("display_name")


def value_by_band(rows: DataFrame, n: int = 10) -> DataFrame:
    """Top-N rows per price band by value; free and unscored rows are out."""
    ranked = rows.where(F.col("price_band").isin(K.PRICE_BANDS) & F.col("value_score").isNotNull())
    return top_per_group(ranked, ["price_band"], by_value(), n)


def quality_by_band(
    plans: DataFrame, plan_models: DataFrame, scores: DataFrame, min_confidence: str = "assumed", n: int = 10
) -> DataFrame:
    """Top-N plans per band by their best model's quality; needs no usage estimate."""
    priced = plans.withColumn("price", effective_price(F.col("monthly_usd"), F.col("annual_usd"))).withColumn(
        "price_band", price_band(F.col("price"))
    )
    priced = priced.where(F.col("price_band") != "free").select("plan_id", "plan_name", "provider_id", "price", "price_band")
    in_scope = plan_models.join(priced.select("plan_id"), "plan_id", "left_semi")
    best = best_quality_per_plan(in_scope, scores).where(at_least(F.col("wmq_confidence"), min_confidence))
    rows = priced.join(
        best.select(
            "plan_id", "model_id", "wmq", F.col("wmq_confidence").alias("confidence"), "cost_per_task",
            F.col("observed_at").alias("score_date"),
        ),
        "plan_id",
    )
    return top_per_group(
        rows, ["price_band"], [F.col("wmq").desc(), F.col("plan_id").asc(), F.col("model_id").asc()], n
    )


def metric_ranking(scores: DataFrame, index: DataFrame, metric: str, min_confidence: str = "assumed", n: int = 10) -> DataFrame:
    """Top-N models by one metric (intelligence, coding, agentic or wmq); untracked models are out."""
    if metric == "wmq":
        s = score_quality(scores).withColumn("confidence", F.col("wmq_confidence"))
    else:
        s = scores
    rows = (
        s.where(F.col(metric).isNotNull() & at_least(F.col("confidence"), min_confidence))
        .join(index, "model_id")
        .select(
            "model_id", "display_name", "provider_id", F.lit(metric).alias("metric"), F.col(metric).alias("metric_value"),
            "confidence", F.col("observed_at").alias("score_date"),
        )
    )
    return top_overall(rows, [F.col("metric_value").desc(), F.col("model_id").asc()], n)


def best_plan_per_model(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Per model: the best plan of each band side by side, with a caveat per missing band."""
    top = latest(
        rows.where(F.col("price_band").isin(K.PRICE_BANDS) & F.col("value_score").isNotNull()),
        ["model_id", "price_band"],
        by_value(),
    )
    pick = F.struct("plan_id", "price", "value_score")
    wide = top.groupBy("model_id").agg(
        *[F.max(F.when(F.col("price_band") == b, pick)).alias(f"best_{b}") for b in K.PRICE_BANDS]
    )
    seen = rows.groupBy("model_id").agg(F.max("model_name").alias("model_name"))
    quality = score_quality(scores).select("model_id", "wmq")
    out = seen.join(wide, "model_id", "left").join(quality, "model_id", "left")
    caveats = F.array_compact(F.array(*[F.when(F.col(f"best_{b}").isNull(), F.lit(K.CAVEAT_NO_BAND[b])) for b in K.PRICE_BANDS]))
    return out.withColumn("caveats", caveats)


def default_models(ranked: DataFrame, profiles: DataFrame, n: int = 5, least: int = 3) -> DataFrame:
    """Default comparison set: the first ``n`` of ``ranked`` (model_id, rank) that have a profile; under ``least`` of them, the first ``n`` profiles.

    ``profiles``: model_id, ord. Both branches are at most ``n`` rows.
    """
    chosen = ranked.where(F.col("rank") <= n).join(profiles.select("model_id"), "model_id", "left_semi").select("model_id", "rank")
    first = top_overall(profiles.select("model_id", "ord"), [F.col("ord").asc(), F.col("model_id").asc()], n).select("model_id", "rank")
    enough = chosen.agg(F.count("*") >= least).scalar()
    return chosen.where(enough).unionByName(first.where(~enough))


def ordered_models(per_model: DataFrame) -> DataFrame:
    """Models of :func:`best_plan_per_model` by quality, best first and unrated ones last, with their position."""
    return global_rank(reused(per_model), [F.col("wmq").desc_nulls_last(), F.col("model_id").asc()], "position")


def provider_peak(rows: DataFrame) -> DataFrame:
    """Best coding-weighted tokens per dollar of each provider; rounded only after the maximum is chosen."""
    worth = F.col("tokens_1mo") * (F.col("coding_index") / 100) / F.col("price")
    valued = rows.where(
        F.col("coding_index").isNotNull() & F.col("tokens_1mo").isNotNull() & (F.col("price") > 0)
    ).withColumn("worth", worth)
    peak = latest(
        valued, ["provider_id"], [F.col("worth").desc(), F.col("plan_id").asc(), F.col("model_id").asc()]
    ).withColumn("peak", round_digits(F.col("worth"), 2)).drop("price_band")
    return global_rank(reused(peak), [F.col("peak").desc(), F.col("provider_id").asc()])


def transparency(
    plans: DataFrame, representative: DataFrame, scores: DataFrame, limits: DataFrame, as_of: Column
) -> DataFrame:
    """All plans by data transparency. ``representative`` holds plan_id, model_id of its plan's best estimate."""
    counted = limits.where((F.col("limit_type") != "unknown") | F.col("limit_value").isNotNull())
    usage = counted.groupBy("plan_id").agg(
        F.min(
            confidence_rank(effective_confidence(F.col("confidence"), F.col("accessed_date"), as_of))
        ).alias("usage_rank")
    )
    model_conf = representative.join(
        scores.select("model_id", F.col("confidence").alias("score_confidence")), "model_id", "left"
    ).select("plan_id", "score_confidence")
    rows = (
        plans.select(
            "plan_id", "plan_name", "provider_id",
            effective_confidence(F.col("pricing_confidence"), F.col("accessed_date"), as_of).alias("pricing"),
        )
        .join(model_conf, "plan_id", "left")
        .join(usage, "plan_id", "left")
        .withColumns(
            {
                "score_confidence": F.coalesce("score_confidence", F.lit("unknown")),
                "usage": F.coalesce(rank_confidence(F.col("usage_rank")), F.lit("unknown")),
            }
        )
    )
    score, pricing, usage_c = F.col("score_confidence"), F.col("pricing"), F.col("usage")
    weakest = F.least(confidence_rank(score), confidence_rank(pricing), confidence_rank(usage_c))
    scored = rows.withColumn("uncertainty", C.uncertainty(score, pricing, usage_c)).withColumns(
        {
            "transparency": (100 - F.col("uncertainty")).cast("bigint"),
            "confidence": rank_confidence(weakest),
            "caveats": F.array_compact(
                F.array(
                    F.when(score != "observed", F.concat(F.lit("AA indices (agentic/coding/speed) confidence: "), score, F.lit("."))),
                    F.when(pricing != "observed", F.concat(F.lit("Pricing confidence: "), pricing, F.lit("."))),
                    F.when(usage_c != "observed", F.concat(F.lit("Usage-limit confidence: "), usage_c, F.lit("."))),
                )
            ),
        }
    )
    return global_rank(reused(scored.drop("usage_rank")), [F.col("transparency").desc(), F.col("plan_id").asc()])


LONG_COLUMNS = ["ranking_type", "price_band", "rank", "provider_id", "plan_id", "model_id", "metric_value", "confidence"]


def long_form(df: DataFrame, ranking_type: str | Column, metric: str) -> DataFrame:
    """One ranking in the shape of the shared long table."""
    kind = F.lit(ranking_type) if isinstance(ranking_type, str) else ranking_type
    have = set(df.columns)

    def pick(name: str, type_: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(type_).alias(name)

    return df.select(
        kind.alias("ranking_type"),
        pick("price_band", "string"),
        F.col("rank").cast("bigint").alias("rank"),
        pick("provider_id", "bigint"),
        pick("plan_id", "bigint"),
        pick("model_id", "bigint"),
        F.col(metric).cast("double").alias("metric_value"),
        pick("confidence", "string"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
