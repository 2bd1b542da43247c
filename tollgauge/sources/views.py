"""Domain views over the star-schema tables: providers, models, plans, limits, scores, histories.

Each view is a plain projection or one aggregation, so filters and column pruning reach the Parquet scan.
The matching SQL lives in ``queries/sql_views.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgauge import constants as K
from tollgauge.functions.basics import lookup
from tollgauge.operators.ordering import recency_key
from tollgauge.session import spread

AS_OF = "2001-08-02"
SCORES_AS_OF = "2024-01-31"

# fixed values: how table codes map onto the domain
TIER_OF_TYPE = {
    "ECONOMY": "individual",
    "STANDARD": "pro",
    "SMALL": "free",
    "MEDIUM": "team",
    "LARGE": "enterprise",
    "PROMO": "api",
}
WINDOW_OF_LINE = {1: "1h", 2: "3h", 3: "5h", 4: "1d", 5: "1w", 6: "1mo", 7: "1y"}


# fixed values: words of an offer after its amount, after its quantity and at its end
OFFER_BILLING = ("/mo", " per year", "")
OFFER_KIND = (" messages per day", " credits/month", "x more usage")
OFFER_CLOSE = (
    ". Free tier available, limits reset every 24 hours.",
    ". Heavy use is throttled; usage limits apply and vary, capped by model.",
)


def offer_words() -> Column:
    """Text of an offer, from ``amount``, ``whole`` and ``wording``; no two of these triples share a text."""

    def one(words: tuple[str, ...], step: int) -> Column:
        return F.get(F.array(*[F.lit(w) for w in words]), F.expr(f"wording div {step} % {len(words)}"))

    amount, whole = F.col("amount").cast("string"), F.col("whole").cast("string")
    return F.concat(F.lit("Plan costs $"), amount, one(OFFER_BILLING, 6), F.lit(", "), whole, one(OFFER_KIND, 2), one(OFFER_CLOSE, 1))


def as_of(date: str = AS_OF) -> Column:
    return F.lit(date).cast("date")


class Views:
    """Lazily built views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, name: str, *columns: str) -> DataFrame:
        """Columns for CPU-heavy row work, spread over the cores when the file itself gives too few splits."""
        return spread(self.table(name).select(*columns))

    @cached_property
    def provider(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").cast("bigint").alias("provider_id"),
            F.col("n_name").alias("provider_name"),
            F.col("r_name").alias("category"),
            (F.col("r_name") != "AFRICA").alias("is_active"),
        )

    @cached_property
    def model(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("model_id"),
            F.col("s_nationkey").cast("bigint").alias("provider_id"),
            F.col("s_name").alias("display_name"),
            (F.col("s_acctbal") >= 0).alias("is_active"),
            F.date_sub(as_of(), F.floor(F.abs("s_acctbal") / 20).cast("int")).alias("released_date"),
        )

    @cached_property
    def plan(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size").cast("double")
        tier = lookup(TIER_OF_TYPE, F.col("p_type"))
        monthly = F.when(tier == "api", F.lit(None).cast("double")).when(tier == "free", 0.0).otherwise(size * 2.0)
        level = F.col("p_size") % 8
        conf = F.when(level < 4, "observed").when(level == 4, "inferred").when(level == 5, "assumed")
        return self.table("part").select(
            key.alias("plan_id"),
            (F.regexp_extract("p_brand", "[0-9]+", 0).cast("bigint") % 25).alias("provider_id"),
            F.col("p_name").alias("plan_name"),
            F.concat_ws("-", "p_brand", key.cast("string")).alias("plan_slug"),
            tier.alias("tier"),
            monthly.alias("monthly_usd"),
            F.when(F.col("p_size") % 3 == 0, F.when(tier == "free", 0.0).when(tier != "api", size * 1.6)).alias("annual_usd"),
            (~F.col("p_name").startswith("old")).alias("is_active"),
            conf.when(level == 6, "stale").otherwise("unknown").alias("pricing_confidence"),
            F.date_sub(as_of(), F.floor((F.col("p_retailprice") - 900) * 1.5).cast("int")).alias("accessed_date"),
            F.when(F.col("p_size") != 7, F.date_sub(as_of(), F.col("p_size").cast("int"))).alias("last_verified"),
        )

    @cached_property
    def scoped_plan(self) -> DataFrame:
        """Active, paid individual and pro plans."""
        p = self.plan
        return p.where(p.is_active & p.tier.isin(K.IN_SCOPE_TIERS) & (p.monthly_usd > 0))

    @cached_property
    def plan_model(self) -> DataFrame:
        """Distinct plan-model pairs; ``ord`` orders the models of a plan."""
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("plan_id"), F.col("l_suppkey").alias("model_id"))
            .agg(F.when(F.min("l_returnflag") == "R", "legacy").otherwise("full").alias("access_type"))
            .withColumn("ord", F.col("model_id"))
        )

    @cached_property
    def limit(self) -> DataFrame:
        """One declared usage limit per line item, all fourteen types and seven windows."""
        li = self.texts(
            "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"
        )
        line = F.col("l_linenumber")
        pair = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4) + F.when(
            F.col("l_linestatus") == "F", 0
        ).otherwise(1)
        typed = li.withColumn("limit_type", F.get(F.array(*[F.lit(t) for t in K.LIMIT_TYPES]), (pair + (line - 1) * 6) % 14))
        type_ = F.col("limit_type")
        unit = (
            F.when(type_.startswith("messages"), "Messages")
            .when(type_.startswith("tokens"), "tokens")
            .when(type_.startswith("requests"), F.when(line % 2 == 0, "requests").otherwise("calls"))
            .when(type_.startswith("completions"), "completions")
        )
        part = F.col("l_partkey")
        conf = F.when(part % 3 == 0, "observed").when(part % 3 == 1, "inferred")
        return typed.select(
            part.alias("plan_id"),
            F.col("l_suppkey").alias("model_id"),
            F.col("l_orderkey").alias("order_id"),
            line.alias("line"),
            type_,
            F.when((type_ == "unknown") & (F.col("l_quantity") < 25), F.lit(None).cast("double"))
            .otherwise(F.col("l_quantity"))
            .alias("limit_value"),
            unit.alias("limit_unit"),
            F.when(line == 6, F.lit(None).cast("string")).otherwise(lookup(WINDOW_OF_LINE, line)).alias("reset_window"),
            conf.when(F.col("l_tax") < 0.05, "assumed").otherwise("unknown").alias("confidence"),
            F.date_sub(as_of(), (part % 120 + line).cast("int")).alias("accessed_date"),
        )

    LIMIT_ORDER = ("order_id", "line", "model_id", "limit_value", "limit_type")

    @cached_property
    def score(self) -> DataFrame:
        """Latest event value per model and kind, pivoted into index columns by one hash aggregation."""
        e = self.table("events")
        key = recency_key(F.col("ts"), F.col("event_id"))
        indexed = F.when(F.col("value").isNotNull(), F.least(F.lit(100.0), F.col("value")))

        def newest(kind: str) -> Column:
            return F.max_by(indexed, F.when(F.col("event_type") == kind, key))

        k = F.get_json_object("props", "$.k").cast("double")
        agg = e.groupBy(F.col("user_id").alias("model_id")).agg(
            newest("purchase").alias("intelligence"),
            newest("view").alias("coding"),
            newest("click").alias("agentic"),
            newest("signup").alias("speed"),
            F.max_by(F.col("value"), F.when(F.col("event_type") == "error", key)).alias("price"),
            F.max_by(k, key).alias("k"),
            F.max_by("event_id", key).alias("last_id"),
            F.max("ts").cast("date").alias("observed_at"),
        )

        conf = F.when(F.col("last_id") % 11 == 0, "unknown").when(F.col("last_id") % 5 < 3, "observed")
        return agg.select(
            "model_id",
            "intelligence",
            "coding",
            "agentic",
            "speed",
            (F.col("price") / 10).alias("price_in"),
            (F.col("price") / 10 * 3).alias("price_out"),
            (F.col("k") / 100).alias("cost_per_task"),
            "observed_at",
            conf.when(F.col("last_id") % 5 == 3, "inferred").otherwise("assumed").alias("confidence"),
        )

    @cached_property
    def snapshot(self) -> DataFrame:
        """Page snapshots: (user, event type) stands for (provider, url); the hash covers the body."""
        return self.table("events").select(
            F.col("user_id").alias("provider_id"),
            F.col("event_type").alias("source_url"),
            F.col("ts").alias("observed_at"),
            F.col("event_id").alias("snapshot_id"),
            F.sha2("props", 256).alias("content_hash"),
            F.when(F.col("event_type") != "error", F.col("props")).alias("extracted_text"),
        )

    @cached_property
    def price_history(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("plan_id"),
            F.col("o_orderdate").cast("date").alias("observed_date"),
            F.col("o_orderkey").alias("snapshot_id"),
            F.col("o_totalprice").alias("price"),
        )

    @cached_property
    def offer(self) -> DataFrame:
        """One price-and-limit offer per line item, in narrow columns that ``offer_words`` makes a text of."""
        o = self.table("orders").select("o_orderkey", (F.floor("o_totalprice") % 2000).alias("amount"))
        li = self.texts(
            "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"
        )
        line = F.col("l_linenumber") % 3
        billing = F.when(line == 0, 0).when(line == 1, 1).otherwise(2)
        kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
        close = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
        li = li.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_quantity").alias("whole"),
            (billing * 6 + kind * 2 + close).alias("wording"),
        )
        return li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey")

    @cached_property
    def offer_text(self) -> DataFrame:
        """One price-and-limit text per line item, built from its own values."""
        return self.offer.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").alias("plan_id"), offer_words().alias("text")
        )
