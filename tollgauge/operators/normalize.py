"""Heterogeneous limits -> comparable tokens per window, with confidence, range and audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgauge import constants as K
from tollgauge.constants import NormalizationConfig
from tollgauge.functions.basics import half_up, lookup, number_text, rank_confidence
from tollgauge.functions.capacity import month_confidence, month_to, monthly_equivalent
from tollgauge.operators.ordering import latest

KNOWN_WINDOWS = list(K.WINDOW_HOURS)
TARGETS = list(K.TARGET_HOURS)


def document_limit(df: DataFrame) -> DataFrame:
    """Declared document limits -> normaliser input.

    The type decides unit and window (a per-minute type counts per hour; ``_per_period`` has no window).
    The declared reset window is not used, and credits and compute units lose their monthly suffix.
    """
    t = F.col("limit_type")
    window = (
        F.when(t.endswith("_per_minute"), "1h")
        .when(t.endswith("_per_day"), "1d")
        .when(t.endswith("_per_week"), "1w")
        .when(t.endswith("_per_month"), "1mo")
    )
    unit = (
        F.when(t.startswith("tokens_"), "tokens")
        .when(t.startswith("messages_"), "messages")
        .when(t.startswith("requests_"), "requests")
        .when(t.startswith("completions_"), F.col("limit_unit"))
    )
    renamed = F.when(t == "credits_per_month", "credits").when(t == "compute_units_per_month", "compute_units").otherwise(t)
    return df.withColumns({"limit_unit": unit, "reset_window": window, "limit_type": renamed})


def mapped_by_prefix(key: Column, mapping: dict[str, float]) -> Column:
    """Exact key, else the first mapping key (in order) that prefixes it. Config-sized maps only."""
    if not mapping:
        return F.lit(None).cast("double")
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(float(v))) if out is None else out.when(key == k, F.lit(float(v)))
    for k, v in mapping.items():
        out = out.when(key.startswith(k), F.lit(float(v)))
    return out


def model_multiplier(model_id: Column, mapping: dict[str, float]) -> Column:
    """Exact model id, else the first key whose text before its first dash prefixes the id."""
    if not mapping:
        return F.lit(None).cast("double")
    out = None
    for k, v in mapping.items():
        out = F.when(model_id == k, F.lit(float(v))) if out is None else out.when(model_id == k, F.lit(float(v)))
    for k, v in mapping.items():
        family = k.split("-")[0]
        if family:
            out = out.when(model_id.startswith(family), F.lit(float(v)))
    return out


def lookup_by_prefix(df: DataFrame, key: str, mapping: DataFrame, value: str) -> DataFrame:
    """Prefix lookup against a mapping *table* (``key``, ``ord``, ``value``) of any size.

    Distinct keys meet the table once, through all their prefixes, whatever lengths the table holds; the exact hit
    wins, then the lowest ``ord``. The rows themselves only join the keys that were found.
    """
    ids = df.select(F.col(key).alias("__id")).distinct().where(F.col("__id").isNotNull())
    cut = ids.select("__id", F.explode(F.sequence(F.lit(0), F.length("__id"))).alias("__n"))
    cut = cut.withColumn("__prefix", F.left("__id", F.col("__n")))
    side = mapping.select(F.col("key").alias("__prefix"), F.col("ord").alias("__ord"), F.col(value).alias("__value"))
    order = F.struct(F.col("__n") < F.length("__id"), F.col("__ord"))
    best = cut.join(side, "__prefix").groupBy("__id").agg(F.min_by("__value", order).alias(value))
    kept = df.select(*[c for c in df.columns if c != value])
    return kept.join(best, F.col(key) == F.col("__id"), "left").drop("__id")


def normalize_limits(df: DataFrame, cfg: NormalizationConfig | None = None) -> DataFrame:
    """Adds layer, tokens/low/high per window, confidence and conversion count to limit rows.

    Expects plan_id, model_id, limit_type, limit_value, limit_unit, reset_window. All layers are column
    expressions chosen by one ``when`` chain, so the step is a narrow projection fused into the scan stage.
    """
    cfg = cfg or NormalizationConfig()
    v, t, w = F.col("limit_value"), F.col("limit_type"), F.col("reset_window")
    unit = F.lower("limit_unit")
    has = v.isNotNull()
    layer = (
        F.when(has & (unit == "tokens"), "direct_tokens")
        .when(has & (unit == "messages"), "messages")
        .when(has & unit.isin("requests", "calls"), "requests")
        .when(has & (t == "credits_per_month"), "credits")
        .when(has & (t == "usd_credits_per_month"), "usd_credits")
        .when(has & (t == "compute_units_per_month"), "compute_units")
        .when(has & w.isin(KNOWN_WINDOWS), "time_window")
        .otherwise("unknown")
    )
    plan_text, model_text = F.col("plan_id").cast("string"), F.col("model_id").cast("string")
    step1 = df.withColumns(
        {
            "layer": layer,
            "monthly": monthly_equivalent(v, w, cfg),
            "multiplier": model_multiplier(model_text, cfg.model_multipliers),
            "credit_factor": mapped_by_prefix(plan_text, cfg.credit_mappings),
            "unit_factor": mapped_by_prefix(plan_text, cfg.compute_unit_mappings),
            "usd_rate": _usd_rate(plan_text, cfg),
        }
    )
    ly, m, mult = F.col("layer"), F.col("monthly"), F.col("multiplier")
    rate = F.col("usd_rate")

    def scaled(base: float) -> Column:
        return F.when(mult.isNotNull(), half_up(F.lit(float(base)) * mult)).otherwise(F.lit(float(base)))

    per_unit = (
        F.when(ly == "messages", scaled(cfg.tokens_per_message.base))
        .when(ly.isin("requests", "time_window"), scaled(cfg.tokens_per_request.base))
        .when(ly == "credits", F.coalesce(F.col("credit_factor"), F.lit(float(cfg.tokens_per_credit))))
        .when(ly == "compute_units", F.coalesce(F.col("unit_factor"), F.lit(float(cfg.tokens_per_compute_unit))))
    )
    # the generic layer treats its value as monthly whatever the window says
    base = (
        F.when(ly == "direct_tokens", F.when(mult.isNotNull(), half_up(v * mult)).otherwise(v))
        .when(ly == "usd_credits", half_up(m * 1e6 / rate["base"]))
        .when(ly == "time_window", v * F.col("per_unit"))
        .otherwise(m * F.col("per_unit"))
    )

    def edge(name: str, usd: str) -> Column:
        return (
            F.when(ly == "messages", m * float(getattr(cfg.tokens_per_message, name)))
            .when(ly == "requests", m * float(getattr(cfg.tokens_per_request, name)))
            .when(ly == "usd_credits", half_up(m * 1e6 / rate[usd]))
        )

    cap = (
        F.when(ly.isin("messages", "requests", "usd_credits"), 3)
        .when(ly == "credits", F.when(F.col("credit_factor").isNotNull(), 3).otherwise(2))
        .when(ly == "compute_units", F.when(F.col("unit_factor").isNotNull(), 3).otherwise(2))
        .when(ly == "time_window", 2)
        .when(ly == "direct_tokens", 4)
    )
    step2 = step1.withColumn("per_unit", per_unit).withColumns(
        {"tokens_1mo": base, "__low": edge("low", "conservative"), "__high": edge("high", "optimistic"), "__cap": cap}
    )
    b = F.col("tokens_1mo")
    outer = ly == "usd_credits"
    step3 = step2.withColumns(
        {
            # message and request ranges are left out where they coincide with the estimate
            "__low": F.when(outer | (F.col("__low") != b), F.col("__low")),
            "__high": F.when(outer | (F.col("__high") != b), F.col("__high")),
            # the month itself is a direct match, so only a zero limit weakens it before the layer's cap
            "confidence": F.when(ly == "unknown", "unknown").otherwise(
                rank_confidence(F.least(F.when(b == 0, 3).otherwise(4), F.col("__cap")))
            ),
        }
    )
    out = {}
    for target in TARGETS:
        if target != "1mo":
            out[f"tokens_{target}"] = month_to(b, target)
        out[f"low_{target}"] = month_to(F.col("__low"), target)
        out[f"high_{target}"] = month_to(F.col("__high"), target)
    return step3.withColumns(out).drop("__low", "__high", "__cap", "credit_factor", "unit_factor", "usd_rate")


def _usd_rate(plan: Column, cfg: NormalizationConfig) -> Column:
    def one(field: str) -> Column:
        default = F.lit(float(getattr(cfg.default_usd_rate, field)))
        return lookup({k: float(getattr(r, field)) for k, r in cfg.usd_rates.items()}, plan, default)

    return F.struct(*[one(f).alias(f) for f in ("conservative", "base", "optimistic")])


def envelope(df: DataFrame) -> DataFrame:
    """Lowest low and highest high over the four windows; windows without a range are skipped."""
    return df.withColumns(
        {
            "uncertainty_low": F.least(*[F.col(f"low_{t}") for t in TARGETS]),
            "uncertainty_high": F.greatest(*[F.col(f"high_{t}") for t in TARGETS]),
        }
    )


def audit(df: DataFrame) -> DataFrame:
    """Adds ``conversion_chain``, ``assumptions`` and ``warnings`` arrays and the JSON ``window_detail``."""
    ly, v, b, m = F.col("layer"), F.col("limit_value"), F.col("tokens_1mo"), F.col("monthly")
    unit = F.lower("limit_unit")

    raw = ly.isin("direct_tokens", "time_window", "unknown")
    first = F.struct(
        ly.alias("layer"),
        F.when(raw, v).otherwise(m).alias("input_value"),
        F.when(raw, unit).when(ly == "usd_credits", "USD").otherwise(ly).alias("input_unit"),
        F.when(ly != "time_window", b).alias("output_tokens"),
        F.when(ly == "unknown", "N/A")
        .when(raw, F.coalesce("reset_window", F.lit("1mo")))
        .otherwise("1mo")
        .alias("target_window"),
    )
    # the generic layer records the window first and the unit conversion second
    second = F.struct(
        F.lit("requests").alias("layer"),
        v.alias("input_value"),
        unit.alias("input_unit"),
        b.alias("output_tokens"),
        F.col("reset_window").alias("target_window"),
    )
    chain = F.array_compact(F.array(first, F.when(ly == "time_window", second)))
    per_unit = F.col("per_unit")
    # fixed values: layer -> (text before the figure, text after it)
    texts = {
        "messages": ("Message-to-token: ", " tokens/message"),
        "requests": ("Request-to-token: ", " tokens/request"),
        "credits": ("Credit mapping: ", " tokens/credit"),
        "compute_units": ("Compute-unit mapping: ", " tokens/compute-unit"),
        "usd_credits": ("USD credit conversion: $", "/mo"),
        "time_window": ("Generic unit limit: ", " tokens/"),
    }
    figure = number_text(F.when(ly == "usd_credits", m).otherwise(per_unit))
    tail = F.when(ly == "time_window", F.coalesce(unit, F.lit("unit"))).otherwise("")
    note = F.concat(
        lookup({k: x[0] for k, x in texts.items()}, ly), figure, lookup({k: x[1] for k, x in texts.items()}, ly), tail
    )
    far = F.array_compact(
        F.array(
            *[
                F.when(
                    month_confidence(b, t) == "unknown",
                    F.lit(f"Window {t} has unknown confidence (large extrapolation)"),
                )
                for t in TARGETS
            ]
        )
    )
    detail = F.to_json(
        F.struct(
            *[
                F.concat(number_text(F.col(f"tokens_{t}")), F.lit(" tokens (confidence: "), month_confidence(b, t), F.lit(")")).alias(t)
                for t in TARGETS
            ]
        )
    )
    return df.withColumns(
        {
            "conversion_chain": chain,
            "assumptions": F.array_compact(F.array(note)),
            "warnings": F.when(ly == "unknown", F.array(F.lit(K.WARNING_UNKNOWN_LIMIT))).otherwise(far),
            "window_detail": F.when(ly != "unknown", detail).otherwise("{}"),
        }
    )


def audit_steps(df: DataFrame) -> DataFrame:
    """The conversion chain as rows (``step``, ``chain_layer``, input, output): same content as ``conversion_chain``.

    The step numbers are exploded, not the structs, so the row expressions stay small enough to compile.
    """
    ly, b, m, v = F.col("layer"), F.col("tokens_1mo"), F.col("monthly"), F.col("limit_value")
    rows = df.withColumn("step", F.explode(F.when(ly == "time_window", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    raw, unit = ly.isin("direct_tokens", "time_window", "unknown"), F.lower("limit_unit")
    window = F.when(ly == "time_window", F.col("reset_window")).when(ly == "direct_tokens", F.coalesce("reset_window", F.lit("1mo")))
    return rows.withColumns(
        {
            "chain_layer": F.when(F.col("step") == 1, "requests").otherwise(ly),
            "input_value": F.when(raw, v).otherwise(m),
            "input_unit": F.when(raw, unit).when(ly == "usd_credits", "USD").otherwise(ly),
            "output_tokens": F.when((ly != "time_window") | (F.col("step") == 1), b),
            "target_window": F.when(ly == "unknown", "N/A").otherwise(F.coalesce(window, F.lit("1mo"))),
        }
    )


def best_limit(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Most generous limit per plan: most tokens a month, the earliest limit on ties.

    ``df`` comes from ``normalize_limits``. row_number sits directly under its filter, so each map task keeps
    one row per plan before the shuffle, however many limits a plan has.
    """
    # nulls sort last, so dropping them after the choice is the same and keeps the long token
    # expression from being copied into a pushed-down filter
    first = latest(df, ["plan_id"], [F.col("tokens_1mo").desc_nulls_last(), *[F.col(c).asc() for c in order]])
    return first.where(F.col("tokens_1mo").isNotNull())


def refresh_estimates(
    limits: DataFrame, existing: DataFrame | None, order: tuple[str, ...], force: bool = False, cfg: NormalizationConfig | None = None
) -> DataFrame:
    """New estimate rows per (plan, model or 'unknown').

    Default: keys that already have an estimate are skipped, and the first limit of a new key wins.
    Forced: every key is rewritten, and the last limit wins.
    """
    keyed = limits.withColumn("model_key", F.coalesce(F.col("model_id").cast("string"), F.lit("unknown")))
    keys = ["plan_id", "model_key"]
    if not force and existing is not None:
        keyed = keyed.join(existing.select(*keys), keys, "left_anti")
    direction = [F.col(c).desc() if force else F.col(c).asc() for c in order]
    return envelope(normalize_limits(latest(keyed, keys, direction), cfg))


def config_errors(cfgs: DataFrame) -> DataFrame:
    """Rule check over configuration rows; one ``errors`` array per row, empty when valid."""

    def text(c: str) -> Column:
        return number_text(F.col(c).cast("double"))

    rules = []
    for name in ("tokensPerCodingMessage", "tokensPerAgenticRequest", "tokensPerAutocomplete"):
        low, base, high = (f"{name}_low", f"{name}_base", f"{name}_high")
        rules += [
            F.when(F.col(low) < 0, F.lit(f"{name}.low must be >= 0")),
            F.when(F.col(base) < 0, F.lit(f"{name}.base must be >= 0")),
            F.when(F.col(high) < 0, F.lit(f"{name}.high must be >= 0")),
            F.when(
                F.col(low) > F.col(base),
                F.concat(F.lit(f"{name}.low ("), text(low), F.lit(") > base ("), text(base), F.lit(")")),
            ),
            F.when(
                F.col(base) > F.col(high),
                F.concat(F.lit(f"{name}.base ("), text(base), F.lit(") > high ("), text(high), F.lit(")")),
            ),
        ]
    for name in ("tokensPerCredit", "tokensPerComputeUnit"):
        rules.append(F.when(F.col(f"{name}_base") < 0, F.lit(f"{name}.base must be >= 0")))
    rules.append(F.when(F.col("sessionsPerMonth") <= 0, F.lit("sessionsPerMonth must be > 0")))
    days = F.col("workingDaysPerMonth")
    rules.append(F.when((days <= 0) | (days > 31), F.lit("workingDaysPerMonth must be 1-31")))
    for name in ("weeksPerMonth", "hoursPerSession"):
        rules.append(F.when(F.col(name) <= 0, F.lit(f"{name} must be > 0")))
    return cfgs.withColumn("errors", F.array_compact(F.array(*rules)))


def summary(limits: DataFrame, estimates: DataFrame) -> DataFrame:
    """Counts of a refresh run: processed, written, skipped and unknown."""
    processed = limits.agg(F.count("*").alias("limits_processed"))
    written = estimates.agg(
        F.count("*").alias("estimates_written"), F.count_if(F.col("confidence") == "unknown").alias("unknown")
    )
    return processed.select(
        "limits_processed",
        written.select("estimates_written").scalar().alias("estimates_written"),
        (F.col("limits_processed") - written.select("estimates_written").scalar()).alias("skipped"),
        written.select("unknown").scalar().alias("unknown"),
    )
