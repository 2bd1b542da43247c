"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (a keyed hash). A document's virtual finish time is the source's cumulative words up to
and with it, divided by the source's target. The mix is all sources' documents in order of finish time, cut at the total budget: each
source advances in proportion to its weight at every point of the mix. A source whose target exceeds its size goes round again, in the
same order.

Cumulative sums run in two levels. Documents fall into hash buckets per source; bucket sums give offsets and only documents of one bucket
meet in a task. Finish times are spread evenly over the mix by construction, so equal slices of finish time are equal ranges of the
global order: their sums say in which slice the budget ends, and only that slice is ordered document by document.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; an empty table gives an empty result; repeated
rows are separate documents (they take the same place in the shuffle and are told apart by their running number); documents of size 0
are never taken; with a total of 0 all targets are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgauge.llm.tables import WORDS, row_key, stored

ROWS_PER_BUCKET = 4096


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, null: 0."""
    parts = F.split(text, WORDS, -1)
    edges = text.rlike(r"^[\x20\x09-\x0D]").cast("int") + text.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(text.isNull() | blank, F.lit(0)).otherwise(F.size(parts) - edges).cast("long")


def targets(sizes: DataFrame, cycle: tuple[float, ...] = (5, 2, 1), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, docs, target) from one row per source (source, source_size, docs): shares of the budget by weight, at most ``most``
    times the source's size, with the excess given to the others by weight until none is above.

    Sources are in code-point order, null last, and take the weights of ``cycle`` in turn. The common level t with
    sum(min(weight * t, cap)) = budget is found in one sorted pass over the sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    cap = F.col("source_size") * F.lit(float(most))
    w = sizes.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("int"))).withColumn("cap", cap)
    # sources fill up in order of cap / weight; before a source fills, all earlier ones stand at their cap
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    w = (
        w.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
        # levels rise while sources fill up and fall after the first that does not: the highest is the common one
        .withColumn("common", F.max("level").over(everything))
    )
    target = F.least(F.col("cap"), F.col("weight") * F.greatest(F.col("common"), F.lit(0.0)))
    return w.select("source", "source_size", "docs", target.alias("target"))


def mix(docs: DataFrame, key: str = "mix", cycle: tuple[float, ...] = (5, 2, 1), most: int = 3, share: float = 1.0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, k, source, size, source_size, target, copies, taken, finish.

    ``copies`` is how often the mix takes the document, ``finish`` the virtual finish time of its first copy (null for size 0), ``k`` the
    row's content key. Nothing that would finish after time 2, twice the time at which all reach their targets, is taken.
    """
    sized = stored(docs.select(row_key("doc_id", "text").alias("k"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit(key), "doc_id", "text"), 1).alias("place")))
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), cycle, most, share).withColumnRenamed("source", "s")
    placed = sized.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # hash ranges of a source, about ROWS_PER_BUCKET documents each
    many = F.greatest(F.lit(1), F.ceil(F.col("docs") / ROWS_PER_BUCKET)).cast("double")
    placed = stored(placed.withColumn("bucket", F.floor(F.shiftright("place", 10).cast("double") / float(1 << 53) * many).cast("long")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy(*[F.col(c).asc_nulls_last() for c in ("place", "doc_id", "size", "k")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("inside", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = stored(placed.select("doc_id", "k", "source", "size", "place", "nth", "source_size", "docs", "target", (F.col("offset") + F.col("inside")).alias("upto")))
    return _truncated(placed, most)


def _truncated(placed: DataFrame, most: int) -> DataFrame:
    """Cut the global order of copies at the budget: the cut is one row, and every document compares its copies with it."""
    per = placed.groupBy("source").agg(F.first("target").alias("target"), F.first("docs").alias("docs"))
    budget, docs = per.agg(F.sum("target"), F.sum("docs")).first()
    budget, slots = float(budget or 0.0), max(16, math.ceil((docs or 0) / ROWS_PER_BUCKET))
    finish = lambda turn: (F.col("upto") + turn * F.col("source_size")) / F.col("target")
    rank = lambda turn: F.struct(finish(turn).alias("finish"), F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("none"), "place", "nth", F.coalesce("doc_id", F.lit(0)).alias("id"))
    counts = (F.col("size") > 0) & (F.col("target") > 0)
    copies = placed.where(counts).select("size", F.explode(F.array(*[F.struct(rank(F.lit(t)).alias("rank"), F.lit(t).alias("turn")) for t in range(most)])).alias("c")).select("size", "c.rank", "c.turn").where("rank.finish <= 2")
    copies = copies.withColumn("slot", F.floor(F.col("rank.finish") * slots))
    running = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = copies.groupBy("slot").agg(F.sum("size").alias("sum")).withColumn("total", F.sum("sum").over(running))
    over = sums.where(F.col("total") > budget + 1e-6 * budget).orderBy("slot").first()
    if over is not None:
        order = Window.partitionBy("slot").orderBy("rank", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = copies.where(F.col("slot") == over["slot"]).withColumn("total", F.sum("size").over(order) + F.lit(over["total"] - over["sum"]))
        last = last.where(F.col("total") <= budget + 1e-6 * budget).agg(F.max("rank").alias("cut")).select("cut.*").first()
        if last["finish"] is None:  # the slice's first copy is already too much
            taken = lambda turn: F.floor(finish(turn) * slots) < over["slot"]
        else:
            end = F.struct(*[F.lit(last[c]).alias(c) for c in ("finish", "source", "none", "place", "nth", "id")])
            taken = lambda turn: rank(turn) <= end
    else:
        taken = lambda turn: finish(turn) <= 2
    number = sum((F.when(counts & taken(F.lit(t)), 1).otherwise(0) for t in range(most)), F.lit(0))
    out = placed.withColumn("copies", number).withColumn("finish", F.when(counts, finish(F.lit(0))))
    return out.select("doc_id", "k", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "finish", "place", "nth", "upto")


def op4_fair_mix(docs: DataFrame) -> DataFrame:
    """The contract's columns: weights 5, 2, 1 in turn, the whole budget, at most three times a source's size."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
