"""Usage-window arithmetic and value-score formulas as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollgauge import constants as K
from tollgauge.constants import NormalizationConfig
from tollgauge.functions.basics import clamp, confidence_rank, half_up, lookup, round_digits, weaker

# --- windows -------------------------------------------------------------------


def monthly_equivalent(value: Column, window: Column, cfg: NormalizationConfig) -> Column:
    """Value per reset window -> value per month. Unknown windows count as monthly."""
    per_session = value * cfg.sessions_per_month
    return (
        F.when(window == "1h", value * cfg.hours_per_session * cfg.sessions_per_month)
        .when(window == "3h", half_up(value * cfg.working_days_per_month * cfg.hours_per_session / 3))
        .when(window == "5h", per_session)
        .when(window == "1d", value * cfg.working_days_per_month)
        .when(window == "1w", value * cfg.weeks_per_month)
        .when(window == "1y", half_up(value / 12))
        .otherwise(value)
    )


def _hours(window: Column, table: dict[str, int]) -> Column:
    return lookup({k: float(v) for k, v in table.items()}, window)


def _scale(value: Column, from_h: Column, to_h: Column) -> Column:
    """Proportional by wall clock: multiply by (to/from) going up, divide by (from/to) going down."""
    return (
        F.when((value == 0) | (from_h == to_h), value)
        .when(from_h < to_h, half_up(value * (to_h / from_h)))
        .otherwise(half_up(value / (from_h / to_h)))
    )


def _ratio_confidence(value: Column, from_h: Column, to_h: Column) -> Column:
    ratio = F.greatest(from_h / to_h, to_h / from_h)
    return (
        F.when(value == 0, "inferred")
        .when(ratio == 1, "observed")
        .when(ratio <= 5, "inferred")
        .when(ratio <= 50, "assumed")
        .otherwise("unknown")
    )


def convert_window(value: Column, from_window: Column, to_window: Column) -> Column:
    """Scale a value between windows; both are column codes."""
    return _scale(value, _hours(from_window, K.WINDOW_HOURS), _hours(to_window, {**K.WINDOW_HOURS, **K.TARGET_HOURS}))


def window_confidence(value: Column, from_window: Column, to_window: Column) -> Column:
    return _ratio_confidence(
        value, _hours(from_window, K.WINDOW_HOURS), _hours(to_window, {**K.WINDOW_HOURS, **K.TARGET_HOURS})
    )


def window_too_far(from_window: Column, to_window: Column) -> Column:
    """More than a thousandfold extrapolation."""
    a, b = _hours(from_window, K.WINDOW_HOURS), _hours(to_window, K.WINDOW_HOURS)
    return F.greatest(a, b) / F.least(a, b) > 1000


def month_to(value: Column, target: str) -> Column:
    """``convert_window`` from a month, with the ratio known up front."""
    if target == "1mo":
        return value
    return F.when(value == 0, value).otherwise(half_up(value / (K.WINDOW_HOURS["1mo"] / K.TARGET_HOURS[target])))


def month_confidence(value: Column, target: str) -> Column:
    ratio = K.WINDOW_HOURS["1mo"] / K.TARGET_HOURS[target]
    level = "observed" if ratio == 1 else "inferred" if ratio <= 5 else "assumed" if ratio <= 50 else "unknown"
    return F.when(value == 0, "inferred").otherwise(level)


# --- model quality ----------------------------------------------------------------


def model_quality(agentic: Column, coding: Column, speed: Column) -> Column:
    """Weighted quality, one decimal. Missing indices hand their weight over; none at all gives null."""
    zero = F.lit(0.0)
    weighted = (
        F.coalesce(agentic * K.WMQ_AGENTIC, zero)
        + F.coalesce(coding * K.WMQ_CODING, zero)
        + F.coalesce(speed, F.lit(K.SPEED_WHEN_MISSING)) * K.WMQ_SPEED
    )
    weight = (
        F.when(agentic.isNull(), zero).otherwise(K.WMQ_AGENTIC)
        + F.when(coding.isNull(), zero).otherwise(K.WMQ_CODING)
        + F.lit(K.WMQ_SPEED)
    )
    return F.when(agentic.isNotNull() | coding.isNotNull(), round_digits(weighted / weight, 1))


def quality_confidence(agentic: Column, coding: Column, declared: Column) -> Column:
    """Confidence after redistribution: one missing index caps it at inferred."""
    one_missing = agentic.isNull() != coding.isNull()
    return F.when(one_missing, weaker(declared, F.lit("inferred"))).otherwise(declared)


def quality_notes(agentic: Column, coding: Column, speed: Column) -> Column:
    missing = F.when(agentic.isNull() & coding.isNull(), F.lit(K.NOTE_NO_INDEX)).when(
        agentic.isNull() | coding.isNull(),
        F.concat(F.when(agentic.isNull(), "agentic").otherwise("coding"), F.lit(K.NOTE_REDISTRIBUTED)),
    )
    return F.array_compact(F.array(F.when(speed.isNull(), F.lit(K.NOTE_SPEED_MISSING)), missing))


def quality_adjusted(tokens: Column, quality: Column) -> Column:
    return half_up(tokens * (quality / 100))


def blended_price(price_in: Column, price_out: Column) -> Column:
    return price_in * K.BLEND_INPUT + price_out * K.BLEND_OUTPUT


def cost_adjusted_month(limit_type: Column, credits: Column, price_in: Column, price_out: Column) -> Column:
    """Tokens a credit budget buys at this model's blended price; null for other limit types."""
    blend = blended_price(price_in, price_out)
    dollars = F.coalesce(credits, F.lit(0.0)) * K.USD_PER_CREDIT
    return F.when((limit_type == "credits") & (blend > 0), half_up(dollars * (F.lit(1e6) / blend)))


def cost_adjusted_window(month_tokens: Column, target: str) -> Column:
    return half_up(month_tokens * float(K.TARGET_HOURS[target]) / float(K.TARGET_HOURS["1mo"]))


def efficiency_multiplier(cost_per_task: Column, reference: Column) -> Column:
    points = clamp(reference / cost_per_task * K.EFFICIENCY_MEDIAN_POINTS, 0, 100)
    scaled = F.lit(K.EFFICIENCY_FLOOR) + points / 100 * (K.EFFICIENCY_CEILING - K.EFFICIENCY_FLOOR)
    return F.when((cost_per_task > 0) & reference.isNotNull(), scaled).otherwise(F.lit(1.0))


def value_score(adjusted_month: Column, price: Column, multiplier: Column) -> Column:
    raw = adjusted_month * multiplier / price / K.CAPACITY_REFERENCE * 100
    return F.when(adjusted_month.isNotNull() & (price != 0), clamp(half_up(raw), 0, 100))


def value_ratio(adjusted_month: Column, price: Column) -> Column:
    return F.when(price > 0, round_digits(adjusted_month / price, 2))


def speed_score(tps: Column) -> Column:
    return F.least(F.lit(100.0), half_up(tps / K.SPEED_TPS_CEILING * 100))


# --- plan scores ----------------------------------------------------------------------


def cost_score(price: Column) -> Column:
    """50 when unknown, 100 when free, else a log decay with floor 10 (no upper clamp)."""
    decay = half_up(F.lit(100.0) - F.log2(price / K.COST_REFERENCE_USD + 0.5) * 30)
    return F.when(price.isNull(), 50.0).when(price == 0, 100.0).otherwise(F.greatest(F.lit(10.0), decay))


def feature_score(features: dict[str, Column], ide_count: Column) -> Column:
    """Weighted completeness. Booleans count when true, numbers when positive."""
    parts = []
    for name, weight in K.FEATURE_WEIGHTS.items():
        present = features[name] > 0 if name == "code_context_length_k" else features[name]
        parts.append(F.when(F.coalesce(present, F.lit(False)), float(weight)).otherwise(0.0))
    parts.append(F.least(F.lit(1.0), ide_count / 3) * float(K.IDE_WEIGHT))
    total = float(sum(K.FEATURE_WEIGHTS.values()) + K.IDE_WEIGHT)
    return half_up(reduce(lambda a, b: a + b, parts) / total * 100)


def plan_score(
    tokens: Column, quality: Column, price: Column, cost: Column, benchmark: Column, feature: Column
) -> Column:
    """Three branches: priced capacity, free capacity, or the three-weight fallback."""
    capacity = tokens * (quality / 100)
    priced = F.least(F.lit(100.0), half_up(capacity / price / K.CAPACITY_REFERENCE * 100))
    free = F.least(F.lit(100.0), half_up(quality * 0.6 + feature * 0.4))
    fallback = half_up(
        cost * K.PLAN_WEIGHT_COST + benchmark * K.PLAN_WEIGHT_BENCHMARK + feature * K.PLAN_WEIGHT_FEATURE
    )
    return F.when(tokens.isNotNull() & (price > 0), priced).when(tokens.isNotNull() & (price == 0), free).otherwise(fallback)


def uncertainty(score_conf: Column, pricing_conf: Column, usage_conf: Column) -> Column:
    """30+25+10 points for unobserved scores, 25 for pricing, 10 for usage."""
    return (
        F.when(score_conf == "observed", 0).otherwise(65)
        + F.when(pricing_conf == "observed", 0).otherwise(25)
        + F.when(usage_conf == "observed", 0).otherwise(10)
    ).cast("bigint")


def weakest_confidence_rank(conf: Column) -> Column:
    """Aggregate: lowest rank of a group."""
    return F.min(confidence_rank(conf))


def task_cost(price_in: Column, price_cache: Column, price_out: Column, out_tokens: Column) -> Column:
    """One task: 7k fresh and 3k cached input tokens plus the output tokens, per-million prices."""
    return (
        price_in * 7000 / 1_000_000
        + F.coalesce(price_cache, price_in) * 3000 / 1_000_000
        + out_tokens * price_out / 1_000_000
    )
