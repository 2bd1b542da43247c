"""Snapshot history: latest rows, change detection, price moves, trends and freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgauge import constants as K
from tollgauge.functions.basics import days_old, effective_confidence
from tollgauge.operators.ordering import latest, previous_value

PAGE = ["provider_id", "source_url"]


def since(df: DataFrame, column: str, start: Column) -> DataFrame:
    """Rows observed on or after ``start``; the bound reaches the scan, or prunes date partitions."""
    return df.where(F.col(column) >= start)


def latest_snapshot(df: DataFrame, keys: Sequence[str], observed: str = "observed_at", tiebreak: str = "snapshot_id") -> DataFrame:
    return latest(df, keys, [F.col(observed).desc(), F.col(tiebreak).desc()])


def latest_finished_run(runs: DataFrame, keys: Sequence[str], tiebreak: str = "run_id") -> DataFrame:
    """Newest run per key that is not still running."""
    return latest(runs.where(F.col("status") != "running"), keys, [F.col("started_at").desc(), F.col(tiebreak).desc()])


def content_changes(snapshots: DataFrame) -> DataFrame:
    """``changed``: no earlier snapshot of the page, or another hash than the one before."""
    prev = previous_value(snapshots, PAGE, ["observed_at", "snapshot_id"], ["content_hash"])
    changed = ~F.col("has_previous") | ~F.col("content_hash").eqNullSafe(F.col("prev_content_hash"))
    return prev.withColumn("changed", changed)


def changed_now(incoming: DataFrame, history: DataFrame, content_hash: Column | None = None) -> DataFrame:
    """Incoming pages whose hash differs from the newest stored one.

    With ``content_hash``, the lower-case hex SHA-256 of a body, the hash is made beside the stored one: it does not travel with
    the body, and the stored one travels as bytes.
    """
    newest = latest_snapshot(history, PAGE)
    if content_hash is None:
        own, stored_hash = F.col("content_hash"), F.col("content_hash")
    else:
        own = F.unhex("content_hash")
        # a stored hash of another form equals none
        stored_hash = F.when(F.col("content_hash").rlike("^[0-9a-f]{64}\\z"), F.unhex("content_hash"))
    stored = newest.select(*PAGE, stored_hash.alias("stored_hash"), F.lit(True).alias("known"))
    joined = incoming.join(stored, PAGE, "left")
    if content_hash is not None:
        joined = joined.withColumn("content_hash", content_hash)
    return joined.withColumn("changed", F.col("known").isNull() | ~own.eqNullSafe(F.col("stored_hash"))).drop("known", "stored_hash")


def price_moves(current: DataFrame, baseline: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Plans whose price moved by more than ``threshold`` against the baseline; null and zero baselines are skipped."""
    base = baseline.where(F.col("price").isNotNull() & (F.col("price") != 0)).select("plan_id", F.col("price").alias("from_price"))
    now = current.where(F.col("price").isNotNull()).select("plan_id", F.col("price").alias("to_price"))
    change = F.abs((F.col("to_price") - F.col("from_price")) / F.col("from_price"))
    return base.join(now, "plan_id").withColumn("change", change).where(F.col("change") > threshold)


def trend(points: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Points scaled to 0-1 inside their series, plus a rising flag; series under three points are dropped.

    Bounds come from one partial aggregation and are joined back, so a long series is not held by one task.
    """
    at = F.struct(*order)
    bounds = points.groupBy(*keys).agg(
        F.count("*").alias("points"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"),
    ).where(F.col("points") >= 3)
    spread = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise(F.col("high") - F.col("low"))
    return (
        points.join(bounds, list(keys))
        .withColumn("scaled", (F.col(value) - F.col("low")) / spread)
        .withColumn("rising", F.col("last") >= F.col("first"))
    )


def changed_without_text(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Runs that saw a change but stored no text, matched on page and time."""
    key = [*PAGE, "observed_at"]
    return (
        runs.where(F.col("change_detected"))
        .join(snapshots.select(*key, "extracted_text"), key, "left")
        .where(F.col("extracted_text").isNull())
        .drop("extracted_text")
    )


def freshness(df: DataFrame, verified: str, as_of: Column) -> DataFrame:
    """Age in days, stale flag and console band."""
    age = days_old(F.col(verified), as_of)
    return df.withColumns(
        {
            "age_days": age.cast("bigint"),
            "stale": age > K.STALE_AFTER_DAYS,
            "freshness": F.when(age > 30, "red").when(age > 14, "yellow").otherwise("green"),
        }
    )


def review_list(plans: DataFrame, limits: DataFrame, as_of: Column) -> DataFrame:
    """Plan prices and limits that rest on assumed or stale confidence."""
    pricing = plans.select(
        "plan_id", F.lit("Pricing").alias("field"), F.lit(0).cast("bigint").alias("order_id"), F.lit(0).alias("line"),
        effective_confidence(F.col("pricing_confidence"), F.col("accessed_date"), as_of).alias("confidence"),
        "accessed_date",
    )
    disclosed = limits.join(plans.select("plan_id"), "plan_id", "left_semi").select(
        "plan_id", F.translate("limit_type", "_", " ").alias("field"), "order_id", "line",
        effective_confidence(F.col("confidence"), F.col("accessed_date"), as_of).alias("confidence"), "accessed_date",
    )
    return pricing.unionByName(disclosed).where(F.col("confidence").isin("assumed", "stale"))


def score_age(rows: DataFrame, as_of: Column, limit_days: int = 14) -> DataFrame:
    """Oldest and newest score date in ranked rows and whether the oldest is too old; one row."""
    return rows.agg(F.min("score_date").alias("oldest"), F.max("score_date").alias("newest")).withColumn(
        "stale", days_old(F.col("oldest"), as_of) > limit_days
    )


def needs_refresh(table: DataFrame, observed: str, as_of: Column, max_days: int = 7, force: bool = False) -> DataFrame:
    """One-row verdict: forced, empty, or newest row older than ``max_days``."""
    newest = table.agg(F.max(observed).alias("newest"))
    return newest.withColumn(
        "refresh", F.lit(force) | F.col("newest").isNull() | F.coalesce(days_old(F.col("newest"), as_of) > max_days, F.lit(True))
    )


# --- run ledger ------------------------------------------------------------------


def newest_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The run ledger keeps its ``n`` newest entries."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(n)


def run_problems(runs: DataFrame) -> DataFrame:
    """Ledger validation: one row per broken rule."""
    rules = [
        F.when(F.col("run_id").isNull(), "runId required"),
        F.when(F.col("started_at").isNull(), "startedAt required"),
        F.when(F.col("completed_at").isNull(), "completedAt required"),
        F.when(F.col("duration_ms").isNull() | (F.col("duration_ms") < 0), "durationMs must be >= 0"),
        F.when(F.col("low_confidence").isNull() | (F.col("low_confidence") < 0), "lowConfidenceEstimates must be >= 0"),
        F.when(~F.coalesce(F.col("status").isin("ok", "changed", "failed", "skipped", "stale"), F.lit(False)), "status not allowed"),
        F.when(F.col("success").isNull(), "success required"),
    ]
    return runs.select("run_id", F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def at_level(logs: DataFrame, level: str) -> DataFrame:
    """Log rows at or above a severity."""
    # fixed values: severity order
    order = ["debug", "info", "warn", "error"]
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("level"))
    return logs.where(rank >= order.index(level) + 1)
