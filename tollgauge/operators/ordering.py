"""Ordered operators that hold up when one key owns a large share of the rows.

* ``latest`` / ``top_per_group``: row_number filtered directly above the window, so Spark keeps only
  the leading rows of each key on the map side before shuffling.
* ``running_total`` / ``global_rank`` / ``previous_value``: rows are dealt to ranges of the total order by explicit
  splitters; only one summary row per range meets in an ordered step.

Splitters come from the rows of smallest key hash, so they depend on the rows alone: every branch of a plan that deals by them sees
the same ranges, and nothing runs while a plan is built. Such a plan reads its input three times (splitters, summaries, rows); the
input must give the same rows each time, and one that is costly is better stored first.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollgauge.session import reused

_PART, _RN, _BASE, _BOUNDS = "__part", "__rn", "__base", "__bounds"
#: Ranges of a total order, and rows sampled for each splitter between them.
RANGES, PER_RANGE = 1024, 8


def recency_key(ts: Column, tiebreak: Column) -> Column:
    """(timestamp, id) as one decimal(38,0): a fixed-width ordering that keeps max_by in hash aggregation.

    ``tiebreak`` must be a non-negative bigint.
    """
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(18,0)")
    return (micros * F.expr("10000000000000000000BD") + tiebreak.cast("decimal(19,0)")).cast("decimal(38,0)")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key in ``order`` (which must end in a unique column)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_per_group(df, keys, order, 1, _RN).drop(_RN)


def top_overall(df: DataFrame, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Global top-N: a take-ordered step, then ranks on those N rows only."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


@dataclass(frozen=True)
class Key:
    """One column of a total order."""

    name: str
    down: bool = False
    nulls_last: bool = False

    @staticmethod
    def of(column: Column) -> Key:
        """From a named column with or without a direction, as ``F.col("x").desc()``."""
        text = re.fullmatch(r"Column<'`?([^`\s()]+)`?(?: (ASC|DESC) NULLS (FIRST|LAST))?'>", str(column))
        if not text:
            raise ValueError(f"a total order needs named columns, not {column}")
        return Key(text[1], text[2] == "DESC", text[3] == "LAST")

    def beyond(self, bound: Column) -> Column:
        """Whether the row's value comes after ``bound``."""
        value = F.col(self.name)
        more = value < bound if self.down else value > bound
        missing = value.isNull() & bound.isNotNull() if self.nulls_last else value.isNotNull() & bound.isNull()
        return missing | F.coalesce(more, F.lit(False))


def with_range(df: DataFrame, order: Sequence[Column], name: str = _PART) -> DataFrame:
    """Number of the range a row falls into, rising with ``order``, whose columns must be unique together.

    The splitters are every eighth of the rows with the smallest hashes: at most 1023 keys in a one-value subquery, searched by halves.
    """
    keys = [Key.of(c) for c in order]
    names = [k.name for k in keys]
    sample = df.select(*names).orderBy(F.xxhash64(*names), *names).limit(RANGES * PER_RANGE)
    # a bounded number of rows, so one task may order them
    placed = sample.withColumn(_RN, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    kept = placed.where(F.col(_RN) % PER_RANGE == 0).select(_RN, F.struct(*[F.col(k.name).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"))
    bounds = kept.agg(F.transform(F.array_sort(F.collect_list(F.struct(_RN, "key"))), lambda x: x["key"])).scalar()

    def reaches(bound: Column) -> Column:
        out = F.lit(True)
        for i, key in reversed(list(enumerate(keys))):
            b = bound[f"k{i}"]
            out = key.beyond(b) | (F.col(key.name).eqNullSafe(b) & out)
        return out

    own = F.col(_BOUNDS)

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        go = s["low"] < s["high"]
        up = go & reaches(F.get(own, mid))
        return F.struct(F.when(up, mid + 1).otherwise(s["low"]).alias("low"), F.when(go & ~up, mid).otherwise(s["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size(own).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(RANGES.bit_length())), start, halve, lambda s: s["low"])
    return df.withColumn(_BOUNDS, bounds).withColumn(name, found).drop(_BOUNDS)


def running_total(df: DataFrame, order: Sequence[Column], amount: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``amount`` over a total order of named columns, without a single-task window.

    The order must be unique, so even one value that fills most of the table is split over ranges.
    """
    dealt = with_range(df.withColumn("__amount", amount), order)
    totals = dealt.groupBy(_PART).agg(F.sum("__amount").alias("__total"))
    # at most one row per range, so this frame and the broadcast below are bounded
    before = W.partitionBy(F.lit(0)).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(_PART, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias(_BASE))
    inside = W.partitionBy(_PART).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        dealt.withColumn("__inside", F.sum("__amount").over(inside))
        .join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col(_BASE) + F.col("__inside"))
        .drop(_PART, _BASE, "__amount", "__inside")
    )


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Position 1..n of every row in a unique total order."""
    return running_total(df, order, F.lit(1).cast("bigint"), rank)


def group_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Position 1..n of every row inside its key, where one key may hold a large share of the rows.

    Rows are dealt to ranges of (keys, order) and counted there; a key that goes on from earlier ranges adds what those hold of it.
    """
    dealt = with_range(df, [*map(F.col, keys), *order])
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    sizes = dealt.groupBy(_PART, *keys).agg(F.count("*").alias("__n"))
    # one row per range: its last key and how many rows of it the range holds
    last = sizes.groupBy(_PART).agg(F.max_by(F.struct(key.alias("key"), F.col("__n").alias("n")), key).alias("__last"))
    upto = F.sum("__last.n").over(W.partitionBy("__last.key").orderBy(_PART).rowsBetween(W.unboundedPreceding, W.currentRow))
    carried = last.withColumn("__upto", F.struct("__last.key", upto.alias("n"))).select(
        _PART, F.lag("__upto").over(W.partitionBy(F.lit(0)).orderBy(_PART)).alias("__carry")
    )
    goes_on = F.lit(True)
    for i, k in enumerate(keys):
        goes_on = goes_on & F.col(f"__carry.key.k{i}").eqNullSafe(F.col(k))
    local = dealt.withColumn("__inside", F.row_number().over(W.partitionBy(_PART, *keys).orderBy(*order)))
    before = F.when(F.col("__carry").isNotNull() & goes_on, F.col("__carry.n")).otherwise(0)
    return local.join(F.broadcast(carried), _PART).withColumn(rank, F.col("__inside") + before).drop(_PART, "__inside", "__carry")


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One-row frame ``median``: middle value, or the mean of the two middle values; null when empty."""
    counts = reused(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n")))
    run = running_total(counts, [F.col(value)], F.col("__n"), "__upto")
    total = run.agg(F.sum("__n").alias("t"))
    t = total.scalar()
    low_pos, high_pos = F.floor((t + 1) / 2), F.floor(t / 2) + 1
    first = F.col("__upto") - F.col("__n") + 1
    middle = run.where(((first <= low_pos) & (F.col("__upto") >= low_pos)) | ((first <= high_pos) & (F.col("__upto") >= high_pos)))
    return middle.agg(((F.min(value) + F.max(value)) / 2).alias("median"))


def percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Distinct values of ``value`` with the share of rows at or below, 0-100. Join back on the value."""
    counts = reused(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n")))
    run = running_total(counts, [F.col(value)], F.col("__n"), "__upto")
    total = run.agg(F.sum("__n")).scalar()
    return run.select(value, (F.col("__upto") / total * 100).alias(name))


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Lag of ``values`` per key in rising ``order``, unique inside a key.

    Rows are dealt to ranges of (keys, order), so a key holding a third of the table, or of one moment, is spread over its ranges. A
    range hands its last row to the next one, which uses it if the key goes on there. ``has_previous`` tells a missing predecessor
    from a null value.
    """
    whole = [F.col(c) for c in (*keys, *order)]
    dealt = with_range(df, whole)
    payload = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    local = dealt.withColumn("__lag", F.lag(payload).over(W.partitionBy(_PART, *keys).orderBy(*order)))
    own = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    last = dealt.groupBy(_PART).agg(F.max_by(F.struct(own.alias("key"), payload.alias("payload")), F.struct(*whole)).alias("__last"))
    # at most one row per range
    carried = last.select(_PART, F.lag("__last").over(W.partitionBy(F.lit(0)).orderBy(_PART)).alias("__carry"))
    goes_on = F.lit(True)
    for i, k in enumerate(keys):
        goes_on = goes_on & F.col(f"__carry.key.k{i}").eqNullSafe(F.col(k))
    out = local.join(F.broadcast(carried), _PART).withColumn(
        "__prev", F.coalesce(F.col("__lag"), F.when(F.col("__carry").isNotNull() & goes_on, F.col("__carry.payload")))
    )
    for i, v in enumerate(values):
        out = out.withColumn(prefix + v, F.col(f"__prev.v{i}"))
    return out.withColumn("has_previous", F.col("__prev").isNotNull()).drop(_PART, "__lag", "__carry", "__prev")
