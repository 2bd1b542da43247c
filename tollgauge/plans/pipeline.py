"""Job-level plans: rankings end to end, crawl processing, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgauge import constants as K
from tollgauge.constants import NormalizationConfig
from tollgauge.operators.estimates import plan_estimates, representative
from tollgauge.operators.ordering import latest
from tollgauge.plans import rankings as R
from tollgauge.session import durable


def all_rankings(
    plans: DataFrame,
    plan_models: DataFrame,
    models: DataFrame,
    providers: DataFrame,
    limits: DataFrame,
    scores: DataFrame,
    limit_order: tuple[str, ...],
    as_of: Column,
    cfg: NormalizationConfig | None = None,
) -> DataFrame:
    """Every ranking in one long table: value and quality per band, four metrics, per model, providers, transparency.

    The estimates feed six of the rankings, so they are written once and read back by each.
    """
    scores = durable(scores)
    estimates = durable(plan_estimates(plans, plan_models, models, limits, scores, limit_order, cfg))
    rows = R.plan_model_rows(estimates, plans, providers, models, scores, R.usage_dates(limits, limit_order, plans))
    index = R.model_index(models, plans)
    per_model = latest(
        rows.where(F.col("price_band").isin(K.PRICE_BANDS) & F.col("value_score").isNotNull()), ["model_id", "price_band"], R.by_value()
    ).select("model_id", "price_band", "plan_id", F.lit(1).alias("rank"), "value_score")
    rep = representative(estimates).select("plan_id", "model_id")
    parts = [
        R.long_form(R.value_by_band(rows), "value", "value_score"),
        R.long_form(R.quality_by_band(plans, plan_models, scores), "quality", "wmq"),
        *[R.long_form(R.metric_ranking(scores, index, m), m, "metric_value") for m in ("intelligence", "coding", "agentic", "wmq")],
        R.long_form(per_model, "per_model", "value_score"),
        R.long_form(R.provider_peak(rows), "provider", "peak"),
        R.long_form(R.transparency(plans, rep, scores, limits, as_of), "transparency", "transparency"),
    ]
    return R.union_all(parts).withColumn("methodology_version", F.lit(K.RANKINGS_VERSION))
