"""Page corpus processing: change detection, text, extraction, candidate tables and run counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tollgauge.functions.text import content_hash, readable_text
from tollgauge.operators import extract as X
from tollgauge.operators.history import PAGE, changed_now
from tollgauge.operators.mentions import hits, mention_rows
from tollgauge.session import filed


@dataclass
class CrawlResult:
    """Tables one corpus run appends, its one-row counter summary, and all counters by name (``errors`` among them)."""

    snapshots: DataFrame
    prices: DataFrame
    limits: DataFrame
    mentions: DataFrame
    summary: DataFrame
    counters: dict[str, int]


def _filed(run: DataFrame) -> DataFrame:
    """Stores a run's rows; an address that is the page's key as well is written once."""
    if run.schema["page_key"].dataType != run.schema["source_url"].dataType:
        return filed(run)
    key, url, same = F.col("page_key"), F.col("source_url"), F.col("__same")
    stored = filed(run.withColumn("__same", url.eqNullSafe(key)).withColumn("source_url", F.when(~same, url)))
    return stored.withColumn("source_url", F.when(same, key).otherwise(url)).drop("__same")


def process_pages(pages: DataFrame, history: DataFrame, names: DataFrame, force: bool = False) -> CrawlResult:
    """Process fetched pages. ``pages``: page_key, provider_id, source_url, page_type, html, observed_at, allowed.

    Unchanged pages only get a snapshot without text; extraction runs on changed pages alone, after one hash
    comparison against the newest stored snapshot of each page. Prices come from pricing pages, limits and
    mentions from pricing and docs pages. One pass over the pages leaves everything behind: texts and hits are
    stored once, as arrays of a page's row, and the counters are observed on the way.

    An allowed page whose body is missing or no valid UTF-8 is an error: it is counted, leaves no rows, and the run goes on.
    """
    broken = F.col("html").isNull() | ~F.is_valid_utf8("html")
    seen, done = Observation("pages"), Observation("extracted")
    allowed = F.coalesce("allowed", F.lit(False))
    watched = pages.withColumns({"__broken": broken, "allowed": allowed}).observe(
        seen, F.count_if("allowed").alias("processed"), F.count_if(~F.col("allowed")).alias("skipped"), F.count_if(F.col("allowed") & F.col("__broken")).alias("errors")
    )
    fetched = watched.where(F.col("allowed") & ~F.col("__broken")).drop("__broken")
    compared = changed_now(fetched, history, content_hash(F.col("html")))
    if force:
        compared = compared.withColumn("changed", F.lit(True))
    text = F.when(F.col("changed"), readable_text(F.col("html")))
    extracted = X.with_extractions(compared.withColumn("text", text).drop("html"), "text", "page_type")
    disclosed = F.when(F.col("page_type").isin("pricing", "docs"), F.col("text"))
    extracted = extracted.withColumn("mentions", hits(names, disclosed))
    size = lambda c: F.coalesce(F.sum(F.when(F.col("changed"), F.size(c))), F.lit(0)).alias(c)
    extracted = _filed(extracted.observe(done, F.count_if("changed").alias("changed"), size("prices"), size("limits"), size("mentions")))
    counters = {**seen.get, **done.get}

    changed = F.col("changed")
    notes = F.to_json(
        F.struct("footnotes", X.assumptions(F.col("text"), F.col("prices"), F.col("limits"), F.size("mentions")).alias("assumptions"))
    )
    snapshots = extracted.select(
        "page_key", *PAGE, "observed_at", "content_hash", F.col("text").alias("extracted_text"), F.when(changed, notes).alias("notes")
    )
    live = extracted.where(changed)
    names_of = ("processed", "skipped", "changed", "prices", "limits", "mentions")
    summary = pages.sparkSession.createDataFrame([tuple(counters[c] for c in names_of)], ", ".join(f"{c} bigint" for c in names_of))
    return CrawlResult(
        snapshots, X.price_rows(live, ["page_key"]), X.limit_rows(live, ["page_key"]), mention_rows(X.exploded(live, ["page_key"], F.col("mentions"), "m"), ["page_key"]), summary, counters
    )
