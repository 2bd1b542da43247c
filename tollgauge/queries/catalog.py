"""Catalog, filter, sort, upsert and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgauge.functions import basics as B
from tollgauge.operators import catalog as G
from tollgauge.operators import estimates as E
from tollgauge.operators.ordering import group_rank
from tollgauge.plans import rankings as R
from tollgauge.queries import ranking as Q
from tollgauge.queries.registry import query
from tollgauge.queries.sql_views import AS_OF, hu_digits, num_text, sql
from tollgauge.session import reused
from tollgauge.sources.views import Views, as_of

# Offers: one per line item. The slug carries effort words, versions and date stamps.
_OFFER = """SELECT 'creator' || (l_suppkey % 40) AS creator, l_orderkey AS order_id, l_linenumber AS line,
    'm' || l_partkey || ['', '-high', '-low-effort', '-v2', '-20240501', '-0309-non-reasoning', '-mini'][l_linenumber] AS slug,
    'Model ' || l_partkey || ['', ' (Reasoning)', ' v2', ' 0309', ' 20240501 v3 (x)', '  mini', ' Pro'][l_linenumber] AS name,
    CAST(l_shipdate AS DATE) AS released, CASE WHEN l_tax > 0 THEN l_extendedprice / 1050 END AS intelligence,
    (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS ord FROM lineitem"""


def offers(v: Views):
    li, n = v.table("lineitem"), F.col("l_linenumber") - 1

    def nth(*values: str):
        return F.get(F.array(*[F.lit(x) for x in values]), n)

    part = F.col("l_partkey").cast("string")
    return li.select(
        F.concat(F.lit("creator"), (F.col("l_suppkey") % 40).cast("string")).alias("creator"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.concat(F.lit("m"), part, nth("", "-high", "-low-effort", "-v2", "-20240501", "-0309-non-reasoning", "-mini")).alias("slug"),
        F.concat(F.lit("Model "), part, nth("", " (Reasoning)", " v2", " 0309", " 20240501 v3 (x)", "  mini", " Pro")).alias("name"),
        F.col("l_shipdate").cast("date").alias("released"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice") / 1050).alias("intelligence"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("ord"),
    )


@query(
    "catalog_curate",
    sql(
        """SELECT rank, creator, base, order_id, line, intelligence, display_name FROM (SELECT *, row_number() OVER (ORDER BY strength DESC, ord) AS rank,
             trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\s*\\([^)]*\\)\\s*', ' ', 'g'), '\\s+v\\d+\\b', '', 'gi'), '\\s+\\d{4,8}\\b', '', 'g'),
               '\\s{2,}', ' ', 'g')) AS display_name FROM (
             SELECT * FROM (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY creator, base ORDER BY strength DESC, ord) = 1)
             QUALIFY row_number() OVER (PARTITION BY creator ORDER BY strength DESC, ord) <= 12)) WHERE rank <= 100""",
        offer=_OFFER,
        keyed="""SELECT *, coalesce(intelligence, -1e0) AS strength, regexp_replace(slug,
          '(-(high|medium|low|minimal|reasoning|non-reasoning|adaptive|thinking|instant|low-effort|preview|v\\d+)|-\\d{4,8})+$', '') AS base
          FROM offer WHERE released >= DATE '2000-08-02'""",
    ),
)
def catalog_curate(v: Views):
    c = G.curate(offers(v), as_of())
    return c.select(F.col("rank").cast("bigint").alias("rank"), "creator", "base", "order_id", "line", "intelligence", "display_name")


@query(
    "strength_tags",
    sql(
        f"""SELECT model_id, array_to_string(CASE WHEN coding IS NULL AND intelligence IS NULL AND coalesce(agentic, 0e0) < 40 THEN ['general']
             ELSE list_filter([CASE WHEN coding IS NOT NULL THEN 'coding' END, CASE WHEN intelligence IS NOT NULL THEN 'reasoning' END,
               CASE WHEN agentic >= 40 THEN 'math' END], lambda x: x IS NOT NULL) END, ',') AS tags,
           CAST((intelligence IS NOT NULL)::INT + (coding IS NOT NULL)::INT + (agentic IS NOT NULL)::INT AS BIGINT) AS benchmarks,
           {hu_digits("coding", 1)} AS coding_score FROM score""",
        "score",
    ),
)
def strength_tags(v: Views):
    s = v.score.withColumn("math", F.col("agentic"))
    bench = G.index_benchmarks(s, "model_id").groupBy("model_id").agg(
        F.count("*").alias("benchmarks"), F.max(F.when(F.col("name") == "AA Coding Index", F.col("score"))).alias("coding_score")
    )
    tags = G.strengths(F.col("coding"), F.col("intelligence"), F.col("math"))
    return s.select("model_id", F.array_join(tags, ",").alias("tags")).join(bench, "model_id", "left").select(
        "model_id", "tags", F.coalesce("benchmarks", F.lit(0)).alias("benchmarks"), "coding_score"
    )


@query(
    "catalog_upsert",
    """WITH e AS (SELECT s_suppkey AS model_id, s_name AS display_name, CASE WHEN s_acctbal > 5000 THEN 'a,b' ELSE '' END AS strengths,
         CASE WHEN s_acctbal > 2000 THEN 'old' ELSE '' END AS benchmarks, CASE WHEN s_acctbal > 3000 THEN s_acctbal END AS context FROM supplier),
       i AS (SELECT user_id AS model_id, 'user ' || user_id AS display_name, CASE WHEN count(*) > 60 THEN 'x' ELSE '' END AS strengths,
         CASE WHEN max(value) > 200 THEN 'new' ELSE '' END AS benchmarks, CAST(NULL AS DOUBLE) AS context FROM events GROUP BY user_id)
       SELECT coalesce(e.model_id, i.model_id) AS model_id, coalesce(i.display_name, e.display_name) AS display_name,
         CASE WHEN e.strengths <> '' THEN e.strengths ELSE coalesce(i.strengths, e.strengths) END AS strengths,
         CASE WHEN i.benchmarks <> '' THEN i.benchmarks ELSE coalesce(e.benchmarks, i.benchmarks) END AS benchmarks, e.context AS context_length_k
       FROM e FULL JOIN i ON e.model_id = i.model_id""",
)
def catalog_upsert(v: Views):
    bal, none = F.col("s_acctbal"), F.array().cast("array<string>")
    old = v.table("supplier").select(
        F.col("s_suppkey").alias("model_id"), F.col("s_name").alias("display_name"), as_of().alias("released_date"), F.lit("catalog").alias("source"),
        F.when(bal > 5000, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("strengths"),
        F.when(bal > 2000, F.array(F.lit("old"))).otherwise(none).alias("benchmarks"), F.when(bal > 3000, bal).alias("context_length_k"),
    )
    new = v.table("events").groupBy(F.col("user_id").alias("model_id")).agg(F.count("*").alias("n"), F.max("value").alias("top")).select(
        "model_id", F.concat(F.lit("user "), F.col("model_id").cast("string")).alias("display_name"), as_of().alias("released_date"),
        F.lit("events").alias("source"), F.when(F.col("n") > 60, F.array(F.lit("x"))).otherwise(none).alias("strengths"),
        F.when(F.col("top") > 200, F.array(F.lit("new"))).otherwise(none).alias("benchmarks"), F.lit(None).cast("double").alias("context_length_k"),
    )
    return G.upsert_models(old, new).select(
        "model_id", "display_name", F.array_join("strengths", ",").alias("strengths"), F.array_join("benchmarks", ",").alias("benchmarks"),
        "context_length_k",
    )


_LISTED = """SELECT l_partkey AS plan_id, l_suppkey AS model_id, 'full' AS access_type, min(l_suppkey) AS ord FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '2001-06-01' GROUP BY l_partkey, l_suppkey"""


@query(
    "replace_plan_refs",
    sql(
        """SELECT plan_id, model_id, access_type, false AS is_default FROM plan_model WHERE plan_id NOT IN (SELECT plan_id FROM listed)
           UNION ALL SELECT plan_id, model_id, access_type, ord = min(ord) OVER (PARTITION BY plan_id) FROM listed""",
        "plan_model", listed=_LISTED,
    ),
)
def replace_plan_refs(v: Views):
    recent = v.table("lineitem").where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz"))
    listed = recent.select(F.col("l_partkey").alias("plan_id"), F.col("l_suppkey").alias("model_id")).distinct()
    listed = listed.withColumns({"access_type": F.lit("full"), "ord": F.col("model_id")})
    return G.replace_refs(v.plan_model, listed).select("plan_id", "model_id", "access_type", "is_default")


@query(
    "insert_if_absent",
    """SELECT DISTINCT user_id AS model_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""",
)
def insert_if_absent(v: Views):
    seen = v.table("events").select(F.col("user_id").alias("model_id")).distinct()
    return G.insert_missing(v.model, seen, ["model_id"])


_PRICED = "SELECT *, least(monthly_usd, annual_usd) AS price FROM plan"


@query(
    "grid_filter_sort",
    sql(
        """SELECT plan_id, tier, price, CAST(row_number() OVER (ORDER BY price NULLS LAST, plan_id) AS BIGINT) AS position FROM priced
           WHERE price <= 60""",
        "plan", priced=_PRICED,
    ),
)
def grid_filter_sort(v: Views):
    from tollgauge.operators.ordering import global_rank

    kept = G.grid_filter(G.priced(v.plan), max_price=60)
    return global_rank(kept, G.grid_order("price"), "position").select(
        "plan_id", "tier", "price", F.col("position").cast("bigint").alias("position")
    )


@query(
    "plan_filters",
    sql(
        """SELECT 'tier' AS filter, plan_id FROM plan WHERE tier = 'pro' UNION ALL SELECT 'free', plan_id FROM plan WHERE monthly_usd = 0
           UNION ALL SELECT 'api', plan_id FROM plan WHERE tier = 'api' AND is_active UNION ALL SELECT 'scope', plan_id FROM plan
             WHERE tier IN ('individual', 'pro') AND monthly_usd > 0
           UNION ALL SELECT 'recent', model_id FROM model WHERE released_date >= DATE '2001-02-02'
           UNION ALL SELECT 'compare', p.plan_id FROM priced p JOIN provider v ON v.provider_id = p.provider_id
             WHERE contains(lower(p.plan_name || ' ' || v.provider_name), 'ring nation_1') AND price > 0 AND price <= 30
           UNION ALL SELECT 'search', provider_id FROM provider WHERE contains(lower(provider_name), 'n_2') OR contains(lower(category), 'asia')""",
        "plan", "provider", "model", priced=_PRICED,
    ),
)
def plan_filters(v: Views):
    p = v.plan

    def tag(df, name, key="plan_id"):
        return df.select(F.lit(name).alias("filter"), F.col(key).alias("plan_id"))

    compare = G.priced(p).join(v.provider.drop("is_active"), "provider_id")
    providers = v.provider.select("provider_id", F.col("provider_name").alias("display_name"), F.col("category").alias("description"))
    return R.union_all(
        [
            tag(G.by_tier(p, "pro"), "tier"), tag(G.free_plans(p), "free"), tag(G.api_plans(p), "api"),
            tag(p.where(B.in_scope(F.col("tier"), F.col("monthly_usd"))), "scope"),
            tag(v.model.where(B.current_model(F.col("released_date"), as_of())), "recent", "model_id"),
            tag(G.compare_filter(compare, text="Ring NATION_1", band="low"), "compare"),
            tag(G.search(providers, "n_2").unionByName(G.search(providers, "asia")).distinct(), "search", "provider_id"),
        ]
    )


@query(
    "compare_by_confidence",
    sql(
        """SELECT p.plan_id, coalesce(e.confidence, 'unknown') AS confidence FROM scoped_plan p LEFT JOIN estimate e ON e.plan_id = p.plan_id AND e.rep_rank = 1
           WHERE coalesce(e.confidence, 'unknown') = 'unknown'""",
        "scoped_plan", "estimate",
    ),
)
def compare_by_confidence(v: Views):
    best = E.representative(Q.estimates(v)).select("plan_id", "confidence")
    joined = v.scoped_plan.select("plan_id").join(best, "plan_id", "left")
    return G.compare_filter(joined, confidence="unknown").select("plan_id", F.coalesce("confidence", F.lit("unknown")).alias("confidence"))


_FEATURE_DIFF = {
    "price": ["monthly_usd", "annual_usd"],
    "plan": ["tier", "is_active"],
    "source": ["pricing_confidence"],
}


@query(
    "feature_diff",
    sql(
        """SELECT provider_id, section, feature, differs, max(differs) OVER (PARTITION BY provider_id, section) AS section_differs FROM (
           SELECT provider_id, section, feature, min(coalesce(value, '-')) <> max(coalesce(value, '-')) AS differs FROM (
             SELECT provider_id, unnest(['price','price','plan','plan','source']) AS section, unnest(['monthly_usd','annual_usd','tier','is_active','pricing_confidence']) AS feature,
               unnest([CAST(monthly_usd AS VARCHAR), CAST(annual_usd AS VARCHAR), tier, CAST(is_active AS VARCHAR), pricing_confidence]) AS value FROM plan)
           GROUP BY provider_id, section, feature)""",
        "plan",
    ),
)
def feature_diff(v: Views):
    """Which features differ between the plans of each provider."""
    rows = G.feature_rows(v.plan, _FEATURE_DIFF).join(v.plan.select("plan_id", "provider_id"), "plan_id")
    keyed = rows.withColumn("section", F.struct("provider_id", "section"))
    return G.feature_differences(keyed).select("section.provider_id", "section.section", "feature", "differs", "section_differs")


@query(
    "active_providers_nested",
    sql(
        """SELECT v.provider_id, v.provider_name, count(p.plan_id) AS plans, string_agg(CAST(p.plan_id AS VARCHAR), ',' ORDER BY p.plan_id) AS plan_ids
           FROM provider v LEFT JOIN plan p ON p.provider_id = v.provider_id AND p.is_active WHERE v.is_active GROUP BY ALL""",
        "provider", "plan",
    ),
)
def active_providers_nested(v: Views):
    n = G.active_providers_nested(v.provider, v.plan)
    ids = F.array_join(F.transform("plans", lambda p: p["plan_id"].cast("string")), ",")
    return n.select("provider_id", "provider_name", F.size("plans").cast("bigint").alias("plans"), F.nullif(ids, F.lit("")).alias("plan_ids"))


@query(
    "provider_summary",
    sql(
        """SELECT v.provider_id, v.provider_name, v.category, coalesce(s.plans, 0) AS plans, c.plan_id AS cheapest_plan, c.monthly_usd AS cheapest_price,
             coalesce(s.tiers, '') AS tiers, b.best_coding, s.last_verified FROM provider v
           LEFT JOIN (SELECT provider_id, count(*) AS plans, max(accessed_date) AS last_verified, array_to_string(list_filter(
               ['free','individual','pro','team','enterprise','api'], lambda t: list_contains(list(tier), t))[1:4], ',') AS tiers FROM plan GROUP BY provider_id) s
             ON s.provider_id = v.provider_id
           LEFT JOIN (SELECT * FROM plan WHERE is_active AND monthly_usd > 0 QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY monthly_usd, plan_id) = 1) c
             ON c.provider_id = v.provider_id
           LEFT JOIN (SELECT m.provider_id, max(q.coding) AS best_coding FROM model m JOIN score q ON q.model_id = m.model_id GROUP BY m.provider_id) b
             ON b.provider_id = v.provider_id""",
        "provider", "plan", "model", "score",
    ),
)
def provider_summary(v: Views):
    coding = v.model.join(v.score.select("model_id", "coding"), "model_id").groupBy("provider_id").agg(F.max("coding").alias("best_coding"))
    plans = v.plan.select("provider_id", "plan_id", "tier", "monthly_usd", "is_active", "accessed_date")
    return G.provider_summary(v.provider, plans, coding)


@query(
    "tier_plans",
    sql("SELECT provider_id, tier, max(plan_id) AS plan_id FROM plan GROUP BY ALL", "plan"),
)
def tier_plans(v: Views):
    return G.tier_plans(v.plan)


@query(
    "api_offers",
    sql(
        """SELECT f.provider_id, f.plan_id, b.model_id AS best_model, b.intelligence FROM f LEFT JOIN (
           SELECT c.provider_id, c.model_id, s.intelligence FROM (SELECT f.provider_id, r.model_id FROM f JOIN plan_model r ON r.plan_id = f.plan_id
             UNION SELECT m.provider_id, m.model_id FROM model m JOIN f ON f.provider_id = m.provider_id) c JOIN score s ON s.model_id = c.model_id
           QUALIFY row_number() OVER (PARTITION BY c.provider_id ORDER BY coalesce(s.intelligence, 0e0) DESC, c.model_id) = 1) b ON b.provider_id = f.provider_id""",
        "plan_model", "model", "score", "plan",
        f="SELECT provider_id, min(plan_id) AS plan_id FROM plan WHERE tier = 'api' AND is_active GROUP BY provider_id",
    ),
)
def api_offers(v: Views):
    return G.api_offer(v.plan, v.plan_model, v.model, v.score)


@query(
    "plans_with_top_model",
    sql(
        """SELECT DISTINCT r.plan_id, r.model_id, coalesce(m.display_name, CAST(r.model_id AS VARCHAR)) AS name FROM plan_model r
           JOIN (SELECT model_id FROM model_metric WHERE metric = 'coding' AND rank = 1) t ON t.model_id = r.model_id LEFT JOIN model m ON m.model_id = r.model_id""",
        "plan_model", "model", "model_metric",
    ),
)
def plans_with_top_model(v: Views):
    """Plans that offer the best coding model, with its display name."""
    top = R.metric_ranking(v.score, R.model_index(v.model, v.scoped_plan), "coding", n=1).select("model_id")
    refs = v.plan_model.join(top, "model_id", "left_semi").select("plan_id", "model_id")
    return refs.join(v.model.select("model_id", "display_name"), "model_id", "left").select(
        "plan_id", "model_id", F.coalesce("display_name", F.col("model_id").cast("string")).alias("name")
    )


@query(
    "id_universe",
    sql(
        """SELECT model_id, max(listed) AS catalog, max(scored) AS scored, max(ranked) AS ranked FROM (
           SELECT model_id, 1 AS listed, 0 AS scored, 0 AS ranked FROM model UNION ALL SELECT model_id, 0, 1, 0 FROM score
           UNION ALL SELECT model_id, 0, 0, 1 FROM model_metric) GROUP BY model_id""",
        "model", "score", "model_metric",
    ),
)
def id_universe(v: Views):
    index = R.model_index(v.model, v.scoped_plan)

    def flags(df, c, s, r):
        return df.select("model_id", F.lit(c).alias("catalog"), F.lit(s).alias("scored"), F.lit(r).alias("ranked"))

    ranked = [flags(R.metric_ranking(v.score, index, m), 0, 0, 1) for m in ("intelligence", "coding", "agentic", "wmq")]
    u = R.union_all([flags(v.model, 1, 0, 0), flags(v.score, 0, 1, 0), *ranked])
    return u.groupBy("model_id").agg(*[F.max(c).alias(c) for c in ("catalog", "scored", "ranked")])


@query(
    "unscored_models",
    sql("SELECT model_id, display_name FROM model WHERE is_active AND model_id NOT IN (SELECT model_id FROM score WHERE coding IS NOT NULL)", "model", "score"),
)
def unscored_models(v: Views):
    """Active models without a usable coding score."""
    scored = v.score.where(F.col("coding").isNotNull()).select("model_id")
    return v.model.where("is_active").join(scored, "model_id", "left_anti").select("model_id", "display_name")


@query(
    "model_table_order",
    sql(
        """SELECT model_id, display_name, coding, CAST(row_number() OVER (ORDER BY coding NULLS LAST, model_id) AS BIGINT) AS ascending,
             CAST(row_number() OVER (ORDER BY coding DESC NULLS LAST, model_id) AS BIGINT) AS descending FROM (
           SELECT m.model_id, m.display_name, s.coding FROM model m LEFT JOIN score s ON s.model_id = m.model_id)""",
        "model", "score",
    ),
)
def model_table_order(v: Views):
    from tollgauge.operators.ordering import global_rank

    t = reused(v.model.select("model_id", "display_name").join(v.score.select("model_id", "coding"), "model_id", "left"))
    up = global_rank(t, G.metric_order("coding", True), "ascending")
    down = global_rank(t.select("model_id", "coding"), G.metric_order("coding", False), "descending").select("model_id", "descending")
    return up.join(down, "model_id").select("model_id", "display_name", "coding", "ascending", "descending")


@query(
    "comparison_pick",
    sql(
        """SELECT plan_id, 'default' AS mode FROM (SELECT plan_id FROM priced ORDER BY price DESC NULLS LAST, plan_id LIMIT 3)
           UNION ALL SELECT plan_id, 'requested' FROM (SELECT DISTINCT l_partkey AS plan_id FROM lineitem JOIN plan ON plan_id = l_partkey ORDER BY 1 DESC LIMIT 6)""",
        "plan", priced=_PRICED,
    ),
)
def comparison_pick(v: Views):
    plans = G.priced(v.plan).withColumn("overall", F.coalesce("price", F.lit(-1.0)))
    asked = v.table("lineitem").select(F.col("l_partkey").alias("plan_id")).distinct().withColumn("ord", -F.col("plan_id"))
    default = G.selection(plans, asked.where("plan_id < 0"))
    return default.withColumn("mode", F.lit("default")).unionByName(G.selection(plans, asked).withColumn("mode", F.lit("requested")))


@query(
    "busiest_providers",
    sql(
        "SELECT provider_id, count(*) AS plans FROM plan GROUP BY provider_id ORDER BY plans DESC, provider_id LIMIT 8",
        "plan",
    ),
)
def busiest_providers(v: Views):
    return v.plan.groupBy("provider_id").agg(F.count("*").alias("plans")).orderBy(F.col("plans").desc(), "provider_id").limit(8)


@query(
    "first_picks",
    sql(
        """SELECT price_band, plan_id, model_id FROM value_band WHERE rank = 1
           UNION ALL SELECT 'example', plan_id, model_id FROM (SELECT * FROM value_band ORDER BY CASE price_band WHEN 'low' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, rank LIMIT 1)""",
        "value_band",
    ),
)
def first_picks(v: Views):
    """Best row of each band, and the first one in band order as a worked example."""
    top = R.value_by_band(Q.rows(v), 1).select("price_band", "plan_id", "model_id")
    order = F.array_position(F.array(*[F.lit(b) for b in ("low", "mid", "high")]), F.col("price_band"))
    example = top.orderBy(order).limit(1).withColumn("price_band", F.lit("example"))
    return top.unionByName(example)


@query(
    "primary_limits",
    sql(
        """SELECT plan_id, limit_type, limit_value, order_id, line FROM plan_limit QUALIFY row_number() OVER (PARTITION BY plan_id
           ORDER BY limit_type = 'unknown', order_id, line, model_id, limit_value, limit_type) = 1""",
        "plan_limit",
    ),
)
def primary_limits(v: Views):
    """First limit of a plan that says something, else its first limit."""
    from tollgauge.operators.ordering import latest

    order = [(F.col("limit_type") == "unknown").asc(), *[F.col(c).asc() for c in v.LIMIT_ORDER]]
    return latest(v.limit, ["plan_id"], order).select("plan_id", "limit_type", "limit_value", "order_id", "line")


@query(
    "leading_models",
    sql(
        """SELECT plan_id, string_agg(CAST(model_id AS VARCHAR), ',' ORDER BY ord) AS models FROM (SELECT * FROM plan_model WHERE access_type <> 'legacy'
           QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY ord) <= 2) GROUP BY plan_id""",
        "plan_model",
    ),
)
def leading_models(v: Views):
    """First two current models of each plan."""
    from tollgauge.operators.ordering import top_per_group

    two = top_per_group(v.plan_model.where(F.col("access_type") != "legacy"), ["plan_id"], [F.col("ord").asc()], 2)
    return two.groupBy("plan_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda x: x.cast("string")), ",").alias("models")
    )


_N = num_text("limit_value")


@query(
    "formatted_values",
    sql(
        f"""SELECT plan_id, CASE WHEN price IS NULL THEN 'Contact sales' WHEN price = 0 THEN 'Free' WHEN price = floor(price) THEN printf('$%.0f/mo', price)
             ELSE printf('$%.2f/mo', price) END AS price_text,
           CASE WHEN price IS NULL THEN 'Custom' WHEN price = 0 THEN 'Free' ELSE '$' || {num_text("price")} || '/mo' END AS catalog_text,
           CASE WHEN price IS NULL THEN '—' WHEN price = floor(price) THEN printf('$%.0f', price) ELSE printf('$%.2f', price) END AS label,
           CASE WHEN price IS NULL THEN 'high' WHEN price = 0 THEN 'free' WHEN price <= 30 THEN 'low' WHEN price <= 80 THEN 'mid' ELSE 'high' END AS display_band,
           CASE WHEN tokens_1mo IS NULL THEN '—' WHEN tokens_1mo = 0 THEN '0' WHEN tokens_1mo >= 1000000 THEN CASE WHEN tokens_1mo % 1000000 = 0
             THEN printf('%.0fM', tokens_1mo / 1e6) ELSE printf('%.2fM', tokens_1mo / 1e6 + CASE WHEN tokens_1mo % 250000 = 125000 THEN 1e-4 ELSE 0 END) END WHEN tokens_1mo >= 1000 THEN CASE WHEN tokens_1mo % 1000 = 0
             THEN printf('%.0fK', tokens_1mo / 1e3) ELSE printf('%.1fK', tokens_1mo / 1e3 + CASE WHEN tokens_1mo % 500 = 250 THEN 1e-3 ELSE 0 END) END ELSE {num_text("tokens_1mo")} END AS token_text,
           limit_text, CASE WHEN limit_value IS NULL OR limit_type = 'unknown' THEN '—' ELSE {_N} || coalesce(' ' || limit_unit, '') END AS value_text,
           CASE pricing_confidence WHEN 'observed' THEN 'Verified' WHEN 'inferred' THEN 'Inferred' WHEN 'assumed' THEN 'Estimated' WHEN 'stale' THEN 'Stale'
             ELSE 'Unknown' END AS confidence_label,
           CASE WHEN length(plan_name) > 7 THEN left(plan_name, 7) || '…' ELSE plan_name END AS short_name FROM (
             SELECT p.*, l.tokens_1mo, l.limit_value, l.limit_type, l.limit_unit, array_to_string(list_transform(string_split(l.limit_type, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS limit_text
             FROM (SELECT *, least(monthly_usd, annual_usd) AS price FROM plan) p JOIN norm_table l ON l.plan_id = p.plan_id)""",
        "plan", "norm_table",
    ),
)
def formatted_values(v: Views):
    from tollgauge.operators.normalize import normalize_limits

    j = G.priced(v.plan).join(normalize_limits(v.limit).select("plan_id", "tokens_1mo", "limit_value", "limit_type", "limit_unit"), "plan_id")
    p = F.col("price")
    return j.select(
        "plan_id", B.price_text(p).alias("price_text"), B.catalog_price_text(p).alias("catalog_text"), B.price_label(p).alias("label"),
        B.price_band(p, "display").alias("display_band"), B.token_text(F.col("tokens_1mo")).alias("token_text"),
        B.limit_type_text(F.col("limit_type")).alias("limit_text"),
        B.limit_value_text(F.col("limit_type"), F.col("limit_value"), F.col("limit_unit")).alias("value_text"),
        B.confidence_label(F.col("pricing_confidence")).alias("confidence_label"), B.short_text(F.col("plan_name"), 7).alias("short_name"),
    )


@query(
    "score_bands",
    sql(
        """SELECT model_id, CASE WHEN coding IS NULL THEN 'none' WHEN coding >= 70 THEN 'high' WHEN coding >= 50 THEN 'medium' ELSE 'low' END AS index_band,
           CASE WHEN wmq >= 75 THEN 'excellent' WHEN wmq >= 55 THEN 'good' WHEN wmq >= 35 THEN 'fair' ELSE 'poor' END AS score_band,
           CASE WHEN agentic >= 75 THEN 'high' WHEN agentic >= 50 THEN 'elevated' WHEN agentic > 0 THEN 'low' ELSE 'none' END AS uncertainty_tier FROM rated""",
        "rated",
    ),
)
def score_bands(v: Views):
    s = E.score_quality(v.score)
    return s.select(
        "model_id", B.index_band(F.col("coding")).alias("index_band"), B.score_band(F.col("wmq")).alias("score_band"),
        B.uncertainty_tier(F.col("agentic")).alias("uncertainty_tier"),
    )


@query(
    "provider_catalog_order",
    sql(
        f"""SELECT category, provider_id, CAST(row_number() OVER (PARTITION BY category ORDER BY coalesce(b, -1e0) DESC, provider_id) AS BIGINT) AS position,
           {AS_OF} AS as_of FROM (SELECT v.provider_id, v.category, max(s.coding) AS b FROM provider v LEFT JOIN model m ON m.provider_id = v.provider_id
           LEFT JOIN score s ON s.model_id = m.model_id GROUP BY ALL)""",
        "provider", "model", "score",
    ),
)
def provider_catalog_order(v: Views):
    """Providers per category by their best coding index."""
    best = v.model.join(v.score.select("model_id", "coding"), "model_id").groupBy("provider_id").agg(F.max("coding").alias("b"))
    j = v.provider.join(best, "provider_id", "left").withColumn("strength", F.coalesce("b", F.lit(-1.0)))
    ranked = group_rank(reused(j), ["category"], [F.col("strength").desc(), F.col("provider_id").asc()], "position")
    return ranked.select("category", "provider_id", F.col("position").cast("bigint").alias("position"), as_of().alias("as_of"))
