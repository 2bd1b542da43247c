"""Orders, fallbacks and options of the list views, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgauge.operators import catalog as G
from tollgauge.operators import estimates as E
from tollgauge.operators import provenance as PV
from tollgauge.plans import rankings as R
from tollgauge.queries import catalog as CQ
from tollgauge.queries import ranking as Q
from tollgauge.queries.registry import query
from tollgauge.queries.sql_views import AS_OF, sql
from tollgauge.sources.views import Views, as_of

_BASE = ("plan", "best_limit", "plan_quality", "plan_limit")
_ENTRY = """SELECT s.plan_id, s.price, s.overall, s.benchmark_index, p.tier, v.provider_name FROM scored s JOIN plan p ON p.plan_id = s.plan_id
    JOIN provider v ON v.provider_id = p.provider_id"""
_GRID_ORDERS = {
    "value_score": "overall DESC, plan_id", "price": "price NULLS LAST, plan_id", "benchmark": "benchmark_index DESC NULLS LAST, plan_id",
    "provider": "provider_name, plan_id",
}


def entries(v: Views):
    plans = v.plan.select("plan_id", "tier", "provider_id").join(v.provider.select("provider_id", "provider_name"), "provider_id")
    return Q.scored_plans(v).select("plan_id", "price", "overall", "benchmark_index").join(plans, "plan_id")


def _grid_sql(by: str) -> str:
    return sql(
        f"""SELECT plan_id, tier, price, overall, benchmark_index, provider_name, CAST(row_number() OVER (ORDER BY {_GRID_ORDERS[by]}) AS BIGINT) AS position
           FROM entry""",
        "provider", *_BASE, **Q.SCORED, entry=_ENTRY,
    )


def _grid(by: str):
    def build(v: Views):
        return G.grid(entries(v), by).select("plan_id", "tier", "price", "overall", "benchmark_index", "provider_name", F.col("position").cast("bigint").alias("position"))

    return build


for _by in _GRID_ORDERS:
    query(f"grid_by_{_by}", _grid_sql(_by))(_grid(_by))


@query(
    "grid_of_tier",
    sql(
        """SELECT plan_id, price, CAST(row_number() OVER (ORDER BY price NULLS LAST, plan_id) AS BIGINT) AS position FROM (SELECT *, least(monthly_usd, annual_usd) AS price
           FROM plan) WHERE tier = 'pro' AND price <= 60""",
        "plan",
    ),
)
def grid_of_tier(v: Views):
    """Tier and price cap together."""
    return G.grid(G.priced(v.plan), "price", "pro", 60).select("plan_id", "price", F.col("position").cast("bigint").alias("position"))


@query(
    "plans_by_score",
    sql(
        "SELECT plan_id, overall, CAST(row_number() OVER (ORDER BY overall DESC, plan_id) AS BIGINT) AS position FROM scored", *_BASE, **Q.SCORED,
    ),
)
def plans_by_score(v: Views):
    return E.ordered_plans(Q.scored_plans(v)).select("plan_id", "overall", F.col("position").cast("bigint").alias("position"))


@query(
    "efficiency_order",
    sql(
        "SELECT model_id, composite, CAST(row_number() OVER (ORDER BY composite DESC NULLS LAST, model_id) AS BIGINT) AS position FROM tasks", "score", **Q.TASKS,
    ),
)
def efficiency_order(v: Views):
    return E.ordered_efficiency(E.task_efficiency(Q.task_models(v))).select("model_id", "composite", F.col("position").cast("bigint").alias("position"))


@query(
    "best_plans_order",
    sql(
        """SELECT m.model_id, r.wmq, l.plan_id AS low_plan, d.plan_id AS mid_plan, h.plan_id AS high_plan,
             CAST(row_number() OVER (ORDER BY r.wmq DESC NULLS LAST, m.model_id) AS BIGINT) AS position
           FROM (SELECT DISTINCT model_id FROM plan_model_row) m LEFT JOIN rated r ON r.model_id = m.model_id
           LEFT JOIN best_per_model l ON l.model_id = m.model_id AND l.price_band = 'low' LEFT JOIN best_per_model d ON d.model_id = m.model_id AND d.price_band = 'mid'
           LEFT JOIN best_per_model h ON h.model_id = m.model_id AND h.price_band = 'high'""",
        "plan_model_row", "best_per_model", "rated",
    ),
)
def best_plans_order(v: Views):
    """Every model with its best plan per band, models without a valued band too, in the published order."""
    out = R.ordered_models(R.best_plan_per_model(Q.rows(v), v.score))
    return out.select("model_id", "wmq", *[F.col(f"best_{b}.plan_id").alias(f"{b}_plan") for b in ("low", "mid", "high")], F.col("position").cast("bigint").alias("position"))


_CATEGORIES = ["EUROPE", "ASIA", "AMERICA", "AFRICA", "MIDDLE EAST"]
_GROUPED = f"""SELECT v.provider_id, v.provider_name, v.category, max(s.coding) AS b, list_position({_CATEGORIES}, v.category) AS "group" FROM provider v
    LEFT JOIN model m ON m.provider_id = v.provider_id LEFT JOIN score s ON s.model_id = m.model_id GROUP BY ALL"""


@query(
    "catalog_groups",
    sql(
        """SELECT 'index' AS sort_by, "group", provider_id, CAST(row_number() OVER (PARTITION BY "group" ORDER BY coalesce(b, -1e0) DESC, provider_id) AS BIGINT) AS position FROM grouped
           UNION ALL SELECT 'name', "group", provider_id, CAST(row_number() OVER (PARTITION BY "group" ORDER BY provider_name, provider_id) AS BIGINT) FROM grouped""",
        "provider", "model", "score", grouped=_GROUPED,
    ),
)
def catalog_groups(v: Views):
    """Providers in category order, by index and by name."""
    best = v.model.join(v.score.select("model_id", "coding"), "model_id").groupBy("provider_id").agg(F.max("coding").alias("best_coding"))
    p = v.provider.join(best, "provider_id", "left")
    both = [G.catalog_groups(p, _CATEGORIES, by).select(F.lit(by).alias("sort_by"), "group", "provider_id", F.col("position").cast("bigint").alias("position")) for by in ("index", "name")]
    return both[0].unionByName(both[1])


@query(
    "provider_options",
    sql(
        """SELECT provider_id, provider_name, CAST(row_number() OVER (ORDER BY provider_name, provider_id) AS BIGINT) AS position FROM (
           SELECT p.provider_id, arg_max(v.provider_name || CASE WHEN p.is_active THEN '' ELSE ' (old)' END, p.plan_id) AS provider_name
           FROM plan p JOIN provider v ON v.provider_id = p.provider_id GROUP BY p.provider_id)""",
        "plan", "provider",
    ),
)
def provider_options(v: Views):
    """Options of the provider filter; a provider is called as its last plan says."""
    e = v.plan.select("plan_id", "provider_id", "is_active").join(v.provider.select("provider_id", "provider_name"), "provider_id")
    named = e.withColumn("provider_name", F.concat("provider_name", F.when(F.col("is_active"), "").otherwise(" (old)"))).withColumn("ord", F.col("plan_id"))
    return G.provider_options(named).select("provider_id", "provider_name", F.col("position").cast("bigint").alias("position"))


_MAPPED = {f"creator{i}": f"nation_{i}" for i in range(25)}


@query(
    "provider_upserts",
    sql(
        """SELECT creator, provider, provider IN (SELECT lower(provider_name) FROM provider) AS known, count(*) AS offers FROM (
           SELECT creator, CASE WHEN CAST(substr(creator, 8) AS BIGINT) < 25 THEN 'nation_' || substr(creator, 8) ELSE creator END AS provider FROM offer) GROUP BY ALL""",
        "provider", offer=CQ._OFFER,
    ),
)
def provider_upserts(v: Views):
    """Offers per creator, and whether its provider takes them."""
    found = G.provider_upserts(CQ.offers(v), v.provider.select(F.lower("provider_name").alias("provider")), _MAPPED)
    return found.groupBy("creator", "provider", "known").agg(F.count("*").alias("offers"))


@query(
    "radar_fallback_models",
    sql(
        """SELECT model_id, CAST(rank AS BIGINT) AS rank FROM model_metric WHERE metric = 'wmq' AND rank <= 5 AND model_id IN (SELECT model_id FROM prof)
             AND (SELECT count(*) FROM model_metric WHERE metric = 'wmq' AND rank <= 5 AND model_id IN (SELECT model_id FROM prof)) >= 3
           UNION ALL SELECT model_id, row_number() OVER (ORDER BY model_id) FROM (SELECT model_id FROM prof ORDER BY model_id LIMIT 5)
             WHERE (SELECT count(*) FROM model_metric WHERE metric = 'wmq' AND rank <= 5 AND model_id IN (SELECT model_id FROM prof)) < 3""",
        "model_metric", prof="SELECT model_id FROM score WHERE coalesce(coding, 0) < 50", 
    ),
)
def radar_fallback_models(v: Views):
    """Default set where only models of weak coding index have a profile, so the first profiles stand in."""
    top = R.metric_ranking(v.score, R.model_index(v.model, v.scoped_plan), "wmq", n=5)
    weak = v.score.where(F.coalesce("coding", F.lit(0.0)) < 50).select("model_id", F.col("model_id").alias("ord"))
    return R.default_models(top, weak).select("model_id", F.col("rank").cast("bigint").alias("rank"))


@query("transparency_first", sql("SELECT CAST(rank AS BIGINT) AS rank, plan_id, transparency FROM transparency WHERE rank <= 15", "transparency"))
def transparency_first(v: Views):
    """The fifteen most transparent plans."""
    return Q._transparency(v).where(F.col("rank") <= 15).select("rank", "plan_id", "transparency")


_RECORDS = f"""SELECT 'plan-' || plan_id AS owner, 'pricing.provenance' AS path, pricing_confidence AS confidence, accessed_date FROM plan
    UNION ALL SELECT 'plan-' || plan_id, 'usage_limits[' || (row_number() OVER (PARTITION BY plan_id ORDER BY order_id, line, model_id, limit_type, confidence, accessed_date) - 1) || '].provenance',
      confidence, accessed_date FROM plan_limit
    UNION ALL SELECT 'plan-' || r.plan_id, 'models[' || (row_number() OVER (PARTITION BY r.plan_id ORDER BY r.model_id) - 1) || '].benchmarks[0].provenance', 'inferred', m.released_date
      FROM plan_model r JOIN model m ON m.model_id = r.model_id
    UNION ALL SELECT 'provider-' || provider_id, 'provenance', 'assumed', {AS_OF} - CAST(provider_id AS INT) * 5 FROM provider"""


def provenance_documents(v: Views):
    """One nested document per plan and per provider."""
    record = lambda confidence, date: F.struct(F.struct(date.cast("string").alias("accessed_date"), confidence.alias("confidence")).alias("provenance"))
    limit = v.limit.select("plan_id", F.struct("order_id", "line", "model_id", "limit_type", "confidence", "accessed_date").alias("l"))
    limits = limit.groupBy("plan_id").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    dated = v.plan_model.select("plan_id", "model_id").join(v.model.select("model_id", "released_date"), "model_id")
    models = dated.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("model_id", "released_date"))).alias("ms"))
    plan = v.plan.select("plan_id", "pricing_confidence", "accessed_date").join(limits, "plan_id", "left").join(models, "plan_id", "left")
    nested = F.struct(
        F.col("plan_id").alias("id"),
        record(F.col("pricing_confidence"), F.col("accessed_date")).alias("pricing"),
        F.transform("ls", lambda x: record(x["confidence"], x["accessed_date"])).alias("usage_limits"),
        F.transform("ms", lambda m: F.struct(m["model_id"].alias("id"), F.array(record(F.lit("inferred"), m["released_date"])).alias("benchmarks"))).alias("models"),
    )
    text = lambda s: F.parse_json(F.to_json(s, {"ignoreNullFields": "false"}))
    plans = plan.select(F.concat(F.lit("plan-"), F.col("plan_id").cast("string")).alias("owner"), text(nested).alias("document"))
    date = F.date_sub(as_of(), (F.col("provider_id") * 5).cast("int"))
    own = v.provider.select(F.concat(F.lit("provider-"), F.col("provider_id").cast("string")).alias("owner"), text(record(F.lit("assumed"), date)).alias("document"))
    return plans.unionByName(own)


@query(
    "provenance_paths",
    sql(
        f"""SELECT owner, path, confidence, accessed_date, accessed_date IS NOT NULL AND confidence <> 'unknown' AND {AS_OF} - accessed_date > CASE WHEN confidence = 'assumed' THEN 30 ELSE 90 END AS stale
           FROM record""",
        "plan", "plan_limit", "plan_model", "model", "provider", record=_RECORDS,
    ),
)
def provenance_paths(v: Views):
    """Every provenance record of the nested documents with its path and whether it is stale."""
    found = PV.provenance_records(provenance_documents(v))
    return found.select("owner", "path", "confidence", "accessed_date", PV.is_stale(as_of()).alias("stale"))
