"""Model catalog curation, upserts, filters, sorts and comparison operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollgauge import constants as K
from tollgauge.functions.basics import current_model, effective_price, price_band, round_digits
from tollgauge.functions.text import base_key, clean_name
from tollgauge.operators.ordering import global_rank, group_rank, latest, top_overall, top_per_group
from tollgauge.session import reused

# --- curation ---------------------------------------------------------------------


def curate(
    offers: DataFrame, as_of: Column, months: int = K.CATALOG_RECENCY_MONTHS, per_creator: int = K.CATALOG_PER_PROVIDER, n: int = K.CATALOG_TOP_N
) -> DataFrame:
    """Recent models, one per (creator, base name), capped per creator, then the global top N.

    Expects creator, slug, name, released, intelligence, ord. A missing index sorts as -1; ``ord`` settles ties.
    """
    recent = offers.where(F.col("creator").isNotNull() & current_model(F.col("released"), as_of, months))
    keyed = recent.withColumns({"base": base_key(F.col("slug")), "strength": F.coalesce("intelligence", F.lit(-1.0))})
    order = [F.col("strength").desc(), F.col("ord").asc()]
    unique = latest(keyed, ["creator", "base"], order)
    capped = top_per_group(unique, ["creator"], order, per_creator, "creator_rank")
    return top_overall(capped, order, n).withColumn("display_name", clean_name(F.col("name")))


def with_provider(offers: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Creator code -> provider code; unmapped creators keep their own code."""
    out = F.col("creator")
    for creator, provider in (mapping or K.CREATOR_PROVIDER).items():
        out = F.when(F.col("creator") == creator, provider).otherwise(out)
    return offers.withColumn("provider", out)


def strengths(coding: Column, intelligence: Column, math: Column) -> Column:
    tags = F.array_compact(
        F.array(F.when(coding.isNotNull(), "coding"), F.when(intelligence.isNotNull(), "reasoning"), F.when(math >= 40, "math"))
    )
    return F.when(F.size(tags) == 0, F.array(F.lit("general"))).otherwise(tags)


def index_benchmarks(models: DataFrame, key: str) -> DataFrame:
    """Index columns as benchmark rows; out-of-range and missing scores are dropped."""
    # fixed values: index column -> benchmark name
    pairs = {"intelligence": "AA Intelligence Index", "coding": "AA Coding Index", "math": "AA Math Index"}
    items = [F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("score")) for c, name in pairs.items()]
    rows = models.select(key, F.explode(F.array(*items)).alias("b")).select(key, "b.name", "b.score")
    return rows.where(F.col("score").between(0, 200)).select(
        key, "name", round_digits(F.col("score"), 1).alias("score"), F.lit("normalized").alias("unit"), F.lit(True).alias("higher_is_better")
    )


# --- upserts ------------------------------------------------------------------------


def upsert_models(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New catalog version by model id.

    Name, date and source come from the incoming row; strengths stay unless empty; benchmarks are replaced
    unless the incoming list is empty; a context length is only filled when missing.
    """
    e, i = existing.alias("e"), incoming.alias("i")
    j = e.join(i, "model_id", "full")
    seen = F.col("i.display_name").isNotNull()

    def newer(c: str) -> Column:
        return F.when(seen, F.col(f"i.{c}")).otherwise(F.col(f"e.{c}")).alias(c)

    def has(c: str) -> Column:
        return F.coalesce(F.size(c) > 0, F.lit(False))

    return j.select(
        "model_id",
        newer("display_name"), newer("released_date"), newer("source"),
        F.when(has("e.strengths"), F.col("e.strengths")).otherwise(F.coalesce("i.strengths", "e.strengths")).alias("strengths"),
        F.when(has("i.benchmarks"), F.col("i.benchmarks")).otherwise(F.coalesce("e.benchmarks", "i.benchmarks")).alias("benchmarks"),
        F.coalesce("e.context_length_k", "i.context_length_k").alias("context_length_k"),
    )


def replace_refs(refs: DataFrame, listed: DataFrame) -> DataFrame:
    """Swap in the model references of the listed plans; the first reference of a plan is its default.

    Both sides hold plan_id, model_id, access_type, ord.
    """
    kept = refs.join(listed.select("plan_id").distinct(), "plan_id", "left_anti").withColumn("is_default", F.lit(False))
    first = listed.groupBy("plan_id").agg(F.min("ord").alias("first_ord"))
    new = listed.join(first, "plan_id").withColumn("is_default", F.col("ord") == F.col("first_ord")).drop("first_ord")
    return kept.unionByName(new)


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rows`` whose key the table does not hold yet."""
    return rows.join(table.select(*keys), keys, "left_anti")


# --- filters ---------------------------------------------------------------------------


def grid_filter(plans: DataFrame, tier: str | None = None, max_price: float | None = None) -> DataFrame:
    """Tier and price cap; with a cap, unknown prices are out. Expects ``price``."""
    out = plans if tier is None else plans.where(F.col("tier") == tier)
    return out if max_price is None else out.where(F.col("price") <= max_price)


def compare_filter(
    plans: DataFrame, text: str | None = None, provider_id: int | None = None, band: str | None = None, confidence: str | None = None
) -> DataFrame:
    """Substring on 'plan provider', provider, display band and best-estimate confidence (missing counts as unknown)."""
    out = plans
    if text and text.strip():
        hay = F.lower(F.concat_ws(" ", "plan_name", "provider_name"))
        out = out.where(hay.contains(text.strip().lower()))
    if provider_id is not None:
        out = out.where(F.col("provider_id") == provider_id)
    if band is not None:
        out = out.where(price_band(F.col("price"), "display") == band)
    if confidence is not None:
        out = out.where(F.coalesce("confidence", F.lit("unknown")) == confidence)
    return out


def search(providers: DataFrame, text: str) -> DataFrame:
    q = text.lower()
    return providers.where(F.lower("display_name").contains(q) | F.lower("description").contains(q)) if q else providers


def by_tier(plans: DataFrame, tier: str) -> DataFrame:
    return plans.where(F.col("tier") == tier)


def free_plans(plans: DataFrame) -> DataFrame:
    return plans.where(F.col("monthly_usd") == 0)


def api_plans(plans: DataFrame) -> DataFrame:
    return plans.where((F.col("tier") == "api") & F.col("is_active"))


# --- sorts -----------------------------------------------------------------------------


def grid_order(by: str) -> list[Column]:
    orders = {
        "value_score": [F.col("overall").desc_nulls_last()],
        "price": [F.col("price").asc_nulls_last()],
        "benchmark": [F.col("benchmark_index").desc_nulls_last()],
        "provider": [name_order("provider_name")],
    }
    return [*orders[by], F.col("plan_id").asc()]


def metric_order(column: str, ascending: bool) -> list[Column]:
    """Missing metrics go last in both directions."""
    c = F.col(column)
    return [c.asc_nulls_last() if ascending else c.desc_nulls_last(), F.col("model_id").asc()]


def name_order(column: str) -> Column:
    """Locale-aware name order."""
    return F.collate(F.col(column), "UNICODE").asc()


def grid(plans: DataFrame, by: str, tier: str | None = None, max_price: float | None = None) -> DataFrame:
    """The plan grid: filtered by tier and price cap, in one of the four orders, with ``position``.

    Expects plan_id, tier, price and what the order reads: overall, benchmark_index or provider_name.
    """
    kept = reused(grid_filter(plans, tier, max_price))
    if by != "provider":
        return global_rank(kept, grid_order(by), "position")
    # providers are far fewer than plans, but no bound is known: their names get positions first, plans follow them
    names = kept.select("provider_name").distinct().withColumn("__sort", F.collate("provider_name", "UNICODE").cast("string"))
    named = kept.join(global_rank(names, [F.col("__sort"), F.col("provider_name")], "__name"), "provider_name")
    return global_rank(reused(named), [F.col("__name"), F.col("plan_id")], "position").drop("__name", "__sort")


def catalog_groups(providers: DataFrame, categories: list[str], by: str = "index") -> DataFrame:
    """Providers per category, categories in the given order: by best coding index (missing counts as -1) or by name.

    Expects provider_id, provider_name, category, best_coding; adds group (of the category, from 1) and position inside it.
    """
    group = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category")).cast("int")
    rows = providers.withColumn("group", group).where(F.col("group") > 0).withColumn("strength", F.coalesce("best_coding", F.lit(-1.0)))
    order = [F.col("provider_name").asc()] if by == "name" else [F.col("strength").desc()]
    return group_rank(reused(rows), ["group"], [*order, F.col("provider_id").asc()], "position").drop("strength")


def provider_options(entries: DataFrame) -> DataFrame:
    """Distinct providers of the entries in name order, with position; of several names the last entry's counts.

    Expects provider_id, provider_name and ord, the order of the entries.
    """
    last = entries.groupBy("provider_id").agg(F.max_by("provider_name", "ord").alias("provider_name"))
    return global_rank(reused(last), [F.col("provider_name").asc(), F.col("provider_id").asc()], "position")


def provider_upserts(offers: DataFrame, providers: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Offers with the provider their creator maps to and ``known``: whether that provider is there to take the model.

    An unknown creator keeps its code; its offers stay as score rows but reach no provider. ``providers``: provider (code).
    """
    there = providers.select("provider", F.lit(True).alias("known")).distinct()
    return with_provider(offers, mapping).join(there, "provider", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def selection(plans: DataFrame, requested: DataFrame, low: int = 2, high: int = 6) -> DataFrame:
    """Requested plan ids that exist, at most ``high``; fewer than ``low`` falls back to the three best by score.

    ``requested``: plan_id, ord. Both branches are at most a handful of rows.
    """
    known = requested.join(plans.select("plan_id"), "plan_id", "left_semi").orderBy("ord").limit(high).select("plan_id")
    default = plans.orderBy(F.col("overall").desc(), F.col("plan_id").asc()).limit(3).select("plan_id")
    enough = known.agg(F.count("*") >= low).scalar()
    return known.where(enough).unionByName(default.where(~enough))


# --- comparison --------------------------------------------------------------------------


def feature_rows(plans: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """Features of the selected plans as text rows: plan_id, section, feature, value."""
    items = [
        F.struct(F.lit(sec).alias("section"), F.lit(f).alias("feature"), F.col(f).cast("string").alias("value"))
        for sec, fs in sections.items()
        for f in fs
    ]
    return plans.select("plan_id", F.explode(F.array(*items)).alias("r")).select("plan_id", "r.*")


def feature_differences(rows: DataFrame) -> DataFrame:
    """Per feature whether the plans disagree (null counts as a value), and per section whether anything does."""
    marked = F.coalesce("value", F.lit("\u0000"))
    per = rows.groupBy("section", "feature").agg((F.min(marked) != F.max(marked)).alias("differs"))
    shown = per.groupBy("section").agg(F.max("differs").alias("section_differs"))
    return per.join(shown, "section")


def provider_summary(providers: DataFrame, plans: DataFrame, coding: DataFrame) -> DataFrame:
    """Per provider: plan count, cheapest paid plan, tiers shown (first four in order), best coding index, last check.

    ``plans`` holds provider_id, plan_id, tier, monthly_usd, accessed_date; ``coding`` provider_id, best_coding.
    """
    paid = F.col("is_active") & (F.col("monthly_usd") > 0)
    per = plans.groupBy("provider_id").agg(
        F.count("*").alias("plans"),
        F.min(F.when(paid, F.struct("monthly_usd", "plan_id"))).alias("cheapest"),
        F.collect_set("tier").alias("tiers"),
        F.max("accessed_date").alias("last_verified"),
    )
    order = F.array(*[F.lit(t) for t in K.TIERS])
    shown = F.slice(F.filter(order, lambda t: F.array_contains("tiers", t)), 1, 4)
    return (
        providers.join(per, "provider_id", "left")
        .join(coding, "provider_id", "left")
        .select(
            "provider_id", "provider_name", "category", F.coalesce("plans", F.lit(0)).alias("plans"),
            F.col("cheapest.plan_id").alias("cheapest_plan"), F.col("cheapest.monthly_usd").alias("cheapest_price"),
            F.array_join(F.coalesce(shown, F.array().cast("array<string>")), ",").alias("tiers"), "best_coding", "last_verified",
        )
    )


def tier_plans(plans: DataFrame) -> DataFrame:
    """Plan shown for each (provider, tier): the last one listed."""
    return plans.groupBy("provider_id", "tier").agg(F.max("plan_id").alias("plan_id"))


def api_offer(plans: DataFrame, plan_models: DataFrame, models: DataFrame, scores: DataFrame) -> DataFrame:
    """First API plan per provider with its best-scored model, over plan references and provider models."""
    first = latest(api_plans(plans), ["provider_id"], [F.col("plan_id").asc()]).select("provider_id", "plan_id")
    refs = plan_models.select("plan_id", "model_id").join(first, "plan_id").select("provider_id", "model_id")
    own = models.join(first.select("provider_id"), "provider_id", "left_semi").select("provider_id", "model_id")
    scored = refs.unionByName(own).distinct().join(scores.select("model_id", "intelligence"), "model_id")
    best = latest(
        scored, ["provider_id"], [F.coalesce("intelligence", F.lit(0.0)).desc(), F.col("model_id").asc()]
    ).select("provider_id", F.col("model_id").alias("best_model"), "intelligence")
    return first.join(best, "provider_id", "left")


def active_providers_nested(providers: DataFrame, plans: DataFrame) -> DataFrame:
    """Active providers with their active plans nested in id order; providers without plans stay."""
    p = providers.where("is_active")
    live = plans.where("is_active").select("provider_id", F.struct("plan_id", "plan_name", "monthly_usd").alias("plan"))
    nested = live.groupBy("provider_id").agg(F.array_sort(F.collect_list("plan")).alias("plans"))
    empty = F.array().cast("array<struct<plan_id:bigint,plan_name:string,monthly_usd:double>>")
    return p.join(nested, "provider_id", "left").withColumn("plans", F.coalesce("plans", empty))


def write_nested(providers: DataFrame, plans: DataFrame, path: str) -> None:
    """The documents of :func:`active_providers_nested` as JSON, one folder ``provider_id=...`` each, of any size.

    A document is written line by line from ordered rows (opening, one line per plan, closing), so a sort that may spill takes the
    place of an array per provider. ``read_nested`` reads them back.
    """
    p = providers.where("is_active")
    live = plans.where("is_active").join(p.select("provider_id"), "provider_id", "left_semi")
    place = F.row_number().over(W.partitionBy("provider_id").orderBy("plan_id"))
    line = F.concat(F.when(place > 1, ",").otherwise(""), F.to_json(F.struct("plan_id", "plan_name", "monthly_usd")))
    own = F.to_json(F.struct(*[c for c in p.columns if c != "provider_id"]))
    # the opening takes the provider's own fields without their closing brace
    head = F.concat(F.left(own, F.length(own) - 1), F.when(F.length(own) > 2, ",").otherwise(""), F.lit('"plans":['))
    rows = (
        p.select("provider_id", F.lit(0).alias("part"), F.lit(0).alias("place"), head.alias("line"))
        .unionByName(live.select("provider_id", F.lit(1).alias("part"), place.alias("place"), line.alias("line")))
        .unionByName(p.select("provider_id", F.lit(2).alias("part"), F.lit(0).alias("place"), F.lit("]}").alias("line")))
    )
    ordered = rows.repartition("provider_id").sortWithinPartitions("provider_id", "part", "place")
    ordered.select("provider_id", "line").write.mode("overwrite").partitionBy("provider_id").text(path)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("basePath", path).json(path)


def priced(plans: DataFrame) -> DataFrame:
    return plans.withColumn("price", effective_price(F.col("monthly_usd"), F.col("annual_usd")))
