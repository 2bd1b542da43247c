"""Data-quality checks and row validation. Every check yields rows of one issue schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgauge import constants as K
from tollgauge.functions.basics import days_old, number_text
from tollgauge.operators.history import PAGE, price_moves
from tollgauge.session import reused

# fixed values: bounds
COST_BOUNDS = (0.0001, 1000)
YEAR_BOUNDS = (1900, 2026)
ISSUE = ["check_id", "severity", "provider_id", "plan_id", "model_id", "field", "message"]


def issue(df: DataFrame, check: str, severity: str | Column, message: Column, field: str | Column | None = None) -> DataFrame:
    """Project rows to the issue schema; id columns the frame lacks become null."""
    have = set(df.columns)

    def ident(name: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast("string").alias(name)

    return df.select(
        F.lit(check).alias("check_id"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        ident("provider_id"), ident("plan_id"), ident("model_id"),
        (field if isinstance(field, Column) else F.lit(field)).cast("string").alias("field"),
        message.alias("message"),
    )


def _quoted(prefix: str, key: str, suffix: str | Column) -> Column:
    tail = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(F.lit(f'{prefix} "'), F.col(key).cast("string"), F.lit('"'), tail)


def old_providers(providers: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    age = days_old(F.col("last_verified"), as_of)
    text = F.concat(F.lit(" last verified "), age.cast("string"), F.lit(f" days ago (threshold: {days} days)"))
    return issue(providers.where(age > days), "provider-stale-source", "warning", _quoted("Provider", "provider_id", text), "last_verified")


def plans_without_price(plans: DataFrame, providers: DataFrame) -> DataFrame:
    """An error when the provider publishes prices, else a warning; pay-per-token plans are exempt."""
    missing = plans.where(F.col("monthly_usd").isNull() & ~F.col("tier").eqNullSafe("api"))
    j = missing.join(providers.select("provider_id", "pricing_url"), "provider_id", "left")
    severity = F.when(F.col("pricing_url").isNotNull(), "error").otherwise("warning")
    return issue(j, "plan-no-price", severity, _quoted("Plan", "plan_id", " has no monthly price (null)"), "pricing.monthly_usd")


def plans_without_usage(plans: DataFrame, limits: DataFrame, plan_models: DataFrame, estimated_models: DataFrame) -> DataFrame:
    """Plans without limits (unless one of their models has an estimate), or with unknown limits only."""
    per = limits.groupBy("plan_id").agg(F.max(F.col("limit_type") != "unknown").alias("known"))
    j = plans.select("plan_id", "provider_id").join(per, "plan_id", "left")
    covered = plan_models.join(estimated_models.select("model_id").distinct(), "model_id", "left_semi").select("plan_id").distinct()
    none = j.where(F.col("known").isNull()).join(covered, "plan_id", "left_anti")
    vague = j.where(~F.col("known"))
    a = issue(none, "plan-no-usage-estimate", "warning", _quoted("Plan", "plan_id", " has no usage limits defined"))
    b = issue(vague, "plan-no-usage-estimate", "warning", _quoted("Plan", "plan_id", ' usage limits are all "unknown" type'))
    return a.unionByName(b)


def banned_limits(limits: DataFrame) -> DataFrame:
    t = F.col("limit_type")
    text = F.concat(
        F.lit(' declares a banned "'), t, F.lit('" coding limit — replace with a real published limit or "unknown".')
    )
    return issue(
        limits.where(t.isin(K.BANNED_LIMIT_TYPES)).drop("model_id"), "unlimited-coding-limit", "error", _quoted("Plan", "plan_id", text), "usage_limits.type"
    )


def unmapped_models(models: DataFrame, scores: DataFrame) -> DataFrame:
    bare = models.where("is_active").join(scores.select("model_id"), "model_id", "left_anti").drop("provider_id")
    return issue(
        bare.withColumn("provider_id", F.lit("unknown")), "model-no-aa-mapping", "warning",
        _quoted("Model", "model_id", " has no AA score mapping in DB"),
    )


COST_SCHEMA = "costPerTaskUsd double, accessedDate string"


def cost_metrics(scores: DataFrame, column: str) -> DataFrame:
    """Parsed cost metrics; malformed JSON gives nulls and ``well_formed`` false."""
    parsed = F.from_json(F.col(column), COST_SCHEMA, {"mode": "PERMISSIVE"})
    ok = F.expr(f"try_parse_json({column})").isNotNull()
    return scores.withColumn("__m", parsed).withColumns(
        {
            "well_formed": F.col(column).isNull() | ok,
            "cost_per_task": F.when(ok, F.col("__m.costPerTaskUsd")),
            "cost_date": F.when(ok, F.expr("try_cast(__m.accessedDate as date)")),
        }
    ).drop("__m")


def cost_problems(scores: DataFrame, column: str, as_of: Column) -> DataFrame:
    """Malformed, out-of-bounds and outdated cost-per-task figures."""
    m = cost_metrics(scores, column).drop("provider_id").withColumn("provider_id", F.lit("unknown"))
    low, high = COST_BOUNDS
    cost = F.col("cost_per_task")
    bad = m.where(~F.col("well_formed"))
    out = m.where((cost < low) | (cost > high))
    age = days_old(F.col("cost_date"), as_of)
    old = m.where(cost.isNotNull() & (age > K.STALE_AFTER_DAYS))
    return reduce(
        DataFrame.unionByName,
        [
            issue(bad, "aa-cost-per-task-malformed", "warning", _quoted("Model", "model_id", " price_efficiency_metrics_json is not valid JSON")),
            issue(
                out, "aa-cost-per-task-bounds", "error",
                _quoted("Model", "model_id", F.concat(F.lit(" cost-per-task $"), number_text(cost), F.lit(f" out of bounds [${low}, ${high}]"))),
            ),
            issue(
                old, "aa-cost-per-task-stale", "warning",
                _quoted("Model", "model_id", F.concat(F.lit(" cost-per-task observed "), age.cast("string"), F.lit("d ago (>90d) — refresh from AA"))),
            ),
        ],
    )


def ranking_on_old_data(providers: DataFrame, rankings: DataFrame | None, as_of: Column, days: int = 30) -> DataFrame:
    """Old sources behind rankings; one system warning instead when no ranking exists."""
    age = days_old(F.col("last_verified"), as_of)
    text = F.concat(
        F.lit('Rankings may include stale data from "'), F.col("provider_id").cast("string"), F.lit('" (last verified '),
        age.cast("string"), F.lit(" days ago)"),
    )
    old = issue(providers.where(age > days), "ranking-stale-data", "warning", text, "last_verified")
    if rankings is None:
        one = providers.agg(F.count("*")).select(F.lit("system").alias("provider_id"))
        return issue(one, "ranking-stale-data", "warning", F.lit("rankings.json not found — rankings not yet generated"))
    return old


def weak_confidence(df: DataFrame, kind: str, field: str) -> DataFrame:
    """Unknown is an error, assumed and stale are warnings. ``kind`` is Provider or Model."""
    c = F.col("confidence")
    key = f"{kind.lower()}_id"
    text = F.when(c == "unknown", F.lit(' has confidence "unknown"')).otherwise(F.concat(F.lit(' has low confidence: "'), c, F.lit('"')))
    return issue(
        df.where(c.isin("unknown", "assumed", "stale")), "confidence-below-threshold",
        F.when(c == "unknown", "error").otherwise("warning"), _quoted(kind, key, text), field,
    )


def impossible_values(providers: DataFrame, plans: DataFrame, models: DataFrame) -> DataFrame:
    check = "impossible-values"
    year, country = F.col("founded_year"), F.col("headquarters_country")
    price, currency, ctx = F.col("monthly_usd"), F.col("currency"), F.col("context_length_k")
    low, high = YEAR_BOUNDS
    frames = [
        issue(
            providers.where((year < low) | (year > high)), check, "error",
            _quoted("Provider", "provider_id", F.concat(F.lit(" has impossible founded_year: "), year.cast("string"))), "founded_year",
        ),
        issue(
            providers.where((country != "") & ~country.rlike("^[A-Z]{2}\\z")), check, "warning",
            _quoted("Provider", "provider_id", F.concat(F.lit(' has non-standard country code: "'), country, F.lit('"'))), "headquarters_country",
        ),
        issue(
            plans.where(price < 0), check, "error",
            _quoted("Plan", "plan_id", F.concat(F.lit(" has negative price: $"), number_text(price))), "pricing.monthly_usd",
        ),
        issue(
            plans.where((currency != "") & ~currency.rlike("^[A-Z]{3}\\z")), check, "warning",
            _quoted("Plan", "plan_id", F.concat(F.lit(' has non-standard currency: "'), currency, F.lit('"'))), "pricing.currency",
        ),
        issue(
            models.where(ctx <= 0), check, "error",
            _quoted("Model", "model_id", F.concat(F.lit(" has context_length_k <= 0: "), number_text(ctx))), "context_length_k",
        ),
    ]
    return reduce(DataFrame.unionByName, frames)


def price_jumps(current: DataFrame, baseline: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Prices that moved more than the threshold; the provider is the part of the plan id before its first dash."""
    moved = price_moves(current, baseline, threshold)
    # nearest whole percent, halves away from zero as in fixed-point printing
    pct = F.format_string("%.0f", F.col("change") * 100)
    text = F.concat(
        F.lit(" price changed "), pct, F.lit("% ($"), number_text(F.col("from_price")), F.lit(" → $"), number_text(F.col("to_price")), F.lit(")")
    )
    owner = moved.withColumn("provider_id", F.split_part(F.col("plan_id").cast("string"), F.lit("-"), F.lit(1)))
    return issue(owner, "day-over-day-change", "warning", _quoted("Plan", "plan_id", text), "pricing.monthly_usd")


def silent_changes(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changed pages that left no text, one row per run."""
    key = [*PAGE, "observed_at"]
    j = runs.where("change_detected").join(snapshots.select(*key, "extracted_text"), key, "left").where(F.col("extracted_text").isNull())
    text = F.concat(F.lit('Source page changed but no extracted text recorded for "'), F.col("provider_id").cast("string"), F.lit('"'))
    return issue(j, "page-changed-no-extraction", "warning", text)


def summarize(issues: DataFrame) -> DataFrame:
    """Per check: issues, whether any is an error, severities; errors print in full, the rest on request."""
    return issues.groupBy("check_id").agg(
        F.count("*").alias("issues"), F.max(F.col("severity") == "error").alias("has_error"),
        F.array_join(F.array_sort(F.collect_set("severity")), "/").alias("severities"),
    )


def report(issues: DataFrame, verbose: bool = False) -> DataFrame:
    """Issue rows to show: everything when verbose, else only checks that contain an error."""
    if verbose:
        return issues
    kept = reused(issues)
    # one array of check names, of which there are as many as checks, instead of a join: a branch of one check knows its name as a constant
    failing = kept.where(F.col("severity") == "error").agg(F.collect_set("check_id")).scalar()
    return kept.where(F.array_contains(failing, F.col("check_id")))


# --- integrity and row rules ------------------------------------------------------------


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference has no parent; null references are fine."""
    p = parent.select(F.col(key).alias("__key")).distinct()
    return child.where(F.col(column).isNotNull()).join(p, F.col(column) == F.col("__key"), "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def _problems(df: DataFrame, key: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """(path, message) rows of the rules whose condition does not hold; a null condition counts as broken."""
    items = [
        F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))) for path, ok, message in rules
    ]
    return df.select(key, F.explode(F.array_compact(F.array(*items))).alias("p")).select(key, "p.*")


def _text(c: str, low: int, high: int | None = None) -> Column:
    ok = F.length(c) >= low
    return ok if high is None else ok & (F.length(c) <= high)


URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+\S*\z"


def _url(c: str, required: bool = True) -> tuple[str, Column, str]:
    ok = F.col(c).rlike(URL)
    return c, ok if required else F.col(c).isNull() | ok, "Invalid url"


def provider_row_problems(df: DataFrame) -> DataFrame:
    return _problems(
        df, "id",
        [
            ("id", _text("id", 2, 50), "length 2-50"), ("slug", _text("slug", 2, 50), "length 2-50"), ("name", _text("name", 1, 200), "length 1-200"),
            _url("website_url"), _url("pricing_url"), _url("docs_url", False),
        ],
    )


# fixed values: billing intervals a plan row may carry
BILLING_INTERVALS = ["monthly", "annual", "one-time", "weekly", "daily"]


def plan_row_problems(df: DataFrame) -> DataFrame:
    return _problems(
        df, "id",
        [
            ("id", _text("id", 2, 100), "length 2-100"), ("slug", _text("slug", 2, 100), "length 2-100"),
            ("plan_name", _text("plan_name", 1, 200), "length 1-200"),
            ("billing_interval", F.col("billing_interval").isin(BILLING_INTERVALS), "Must be a valid billing interval"),
            ("currency", F.length("currency") == 3, "length 3"), _url("plan_url", False),
        ],
    )


def model_row_problems(df: DataFrame) -> DataFrame:
    return _problems(
        df, "id",
        [
            ("id", _text("id", 2, 100), "length 2-100"), ("canonical_model_id", _text("canonical_model_id", 2, 100), "length 2-100"),
            ("display_name", _text("display_name", 1, 200), "length 1-200"),
        ],
    )


def ranking_row_problems(df: DataFrame) -> DataFrame:
    return _problems(df, "id", [("ranking_type", _text("ranking_type", 2, 50), "length 2-50")])


def unknown_columns(df: DataFrame, allowed: list[str]) -> list[str]:
    """Columns a strict table does not accept."""
    return sorted(set(df.columns) - set(allowed))


def provenance_census(plans: DataFrame, limits: DataFrame, models: DataFrame) -> DataFrame:
    """Every provenance record with its path, once each."""
    return reduce(
        DataFrame.unionByName,
        [
            plans.select(F.col("plan_id").alias("owner"), F.lit("plans[].pricing.provenance").alias("path"), F.col("pricing_confidence").alias("confidence"), "accessed_date"),
            limits.select(F.col("plan_id").alias("owner"), F.lit("plans[].usage_limits[].provenance").alias("path"), "confidence", "accessed_date"),
            models.select(F.col("model_id").alias("owner"), F.lit("models[].provenance").alias("path"), "confidence", "accessed_date"),
        ],
    )
