"""Nested provider documents: schema, lenient and strict reads, validation rows, flattening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgauge import constants as K
from tollgauge.functions.basics import current_model, in_scope

PROVENANCE = "struct<url:string,accessed_date:string,method:string,confidence:string,notes:string>"
BENCHMARK = f"struct<name:string,score:double,unit:string,higher_is_better:boolean,notes:string,provenance:{PROVENANCE}>"
LIMIT = (
    f"struct<type:string,value:double,unit:string,reset_window:string,applies_to:string,notes:string,provenance:{PROVENANCE}>"
)
PRICING = (
    "struct<monthly_usd:double,annual_monthly_usd:double,is_per_seat:boolean,trial_days:int,currency:string,notes:string,"
    f"provenance:{PROVENANCE}>"
)
FEATURES = (
    "struct<agent_capabilities:boolean,web_search:boolean,code_context_length_k:double,file_uploads:boolean,voice_input:boolean,"
    "ide_integrations:array<string>,cli_access:boolean,api_access:boolean,priority_access:boolean,custom_instructions:boolean,"
    "team_features:boolean,sso:boolean,notes:string>"
)
MODEL_REF = "struct<model_id:string,access_type:string,is_default:boolean,notes:string>"
PLAN = (
    f"struct<id:string,provider_id:string,name:string,tier:string,pricing:{PRICING},models:array<{MODEL_REF}>,"
    f"usage_limits:array<{LIMIT}>,features:{FEATURES},target_personas:array<string>,is_active:boolean,last_verified:string,source_url:string>"
)
MODEL = (
    "struct<id:string,provider_id:string,display_name:string,family:string,context_length_k:double,strengths:array<string>,"
    f"released_date:string,benchmarks:array<{BENCHMARK}>,provenance:{PROVENANCE}>"
)
PROVIDER = (
    "id string, name string, display_name string, website string, pricing_url string, docs_url string, description string, logo_slug string, category string, "
    f"headquarters_country string, founded_year int, plans array<{PLAN}>, models array<{MODEL}>, last_verified string, provenance {PROVENANCE}"
)

_DATE = r"^\d{4}-\d{2}-\d{2}\z"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+\S*\z"


class InvalidDocuments(ValueError):
    """Raised by strict reads; the message lists the broken fields."""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All parsable provider documents (one JSON object per file); broken files are skipped."""
    schema = T._parse_datatype_string(PROVIDER + ", _corrupt_record string")
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    # the second condition only makes every query read a real column, which Spark demands next to the corrupt one
    kept = F.col("_corrupt_record").isNull() & ~F.col("id").eqNullSafe(F.lit("\u0000"))
    return raw.where(kept).drop("_corrupt_record")


def _rule(path: str, ok: Column, message: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))


def _provenance_rules(p: Column, at: str) -> list[Column]:
    return [
        _rule(f"{at}.url", p["url"].rlike(_URL), "Invalid url"),
        _rule(f"{at}.accessed_date", p["accessed_date"].rlike(_DATE), "Must be YYYY-MM-DD"),
        _rule(f"{at}.method", p["method"].isin(K.PROVENANCE_METHODS), "Invalid enum value"),
        _rule(f"{at}.confidence", p["confidence"].isin(list(K.CONFIDENCE_RANK)), "Invalid enum value"),
    ]


def _filled(c: Column, size: int = 1) -> Column:
    return F.length(c) >= size


def validation_problems(docs: DataFrame) -> DataFrame:
    """One row per broken rule: provider_id, item (plan or model id), path, message."""

    def problems(df: DataFrame, item: Column, rules: list[Column]) -> DataFrame:
        bad = df.select(F.col("provider_id"), item.alias("item"), F.explode(F.array_compact(F.array(*rules))).alias("p"))
        return bad.select("provider_id", "item", "p.*")

    d = docs.withColumn("provider_id", F.col("id"))
    c = F.col
    top = [
        *[_rule(n, _filled(c(n)), "Required") for n in ("id", "name", "display_name", "logo_slug")],
        _rule("website", c("website").rlike(_URL), "Invalid url"),
        _rule("pricing_url", c("pricing_url").rlike(_URL), "Invalid url"),
        _rule("description", _filled(c("description"), 10), "Too short"),
        _rule("category", c("category").isin(K.CATEGORIES), "Invalid enum value"),
        _rule("headquarters_country", _filled(c("headquarters_country"), 2), "Too short"),
        _rule("founded_year", c("founded_year").isNull() | (c("founded_year") >= 1990), "Must be >= 1990"),
        _rule("plans", c("plans").isNotNull(), "Required"),
        _rule("models", c("models").isNotNull(), "Required"),
        _rule("last_verified", c("last_verified").rlike(_DATE), "Must be YYYY-MM-DD"),
        *_provenance_rules(c("provenance"), "provenance"),
    ]
    plans = d.select("provider_id", F.explode("plans").alias("x"))
    x, pr, ft = c("x"), c("x.pricing"), c("x.features")
    flags = [n for n in ("agent_capabilities", "web_search", "file_uploads", "voice_input", "cli_access", "api_access", "priority_access", "custom_instructions", "team_features", "sso")]
    plan_rules = [
        *[_rule(f"plans[].{n}", _filled(x[n]), "Required") for n in ("id", "provider_id", "name")],
        _rule("plans[].tier", x["tier"].isin(K.TIERS), "Invalid enum value"),
        _rule("plans[].pricing.monthly_usd", pr["monthly_usd"].isNull() | (pr["monthly_usd"] >= 0), "Must be >= 0"),
        _rule("plans[].pricing.annual_monthly_usd", pr["annual_monthly_usd"].isNull() | (pr["annual_monthly_usd"] >= 0), "Must be >= 0"),
        _rule("plans[].pricing.is_per_seat", pr["is_per_seat"].isNotNull(), "Required"),
        _rule("plans[].pricing.trial_days", pr["trial_days"].isNull() | (pr["trial_days"] >= 0), "Must be >= 0"),
        _rule("plans[].pricing.currency", F.length(pr["currency"]) == 3, "Must be 3 characters"),
        *_provenance_rules(pr["provenance"], "plans[].pricing.provenance"),
        *[_rule(f"plans[].features.{n}", ft[n].isNotNull(), "Required") for n in flags],
        _rule("plans[].features.code_context_length_k", ft["code_context_length_k"].isNull() | (ft["code_context_length_k"] > 0), "Must be > 0"),
        _rule("plans[].features.ide_integrations", ft["ide_integrations"].isNotNull(), "Required"),
        _rule("plans[].target_personas", x["target_personas"].isNotNull(), "Required"),
        _rule("plans[].is_active", x["is_active"].isNotNull(), "Required"),
        _rule("plans[].last_verified", x["last_verified"].rlike(_DATE), "Must be YYYY-MM-DD"),
        _rule("plans[].source_url", x["source_url"].rlike(_URL), "Invalid url"),
        _rule("plans[].models", x["models"].isNotNull(), "Required"),
        _rule("plans[].usage_limits", x["usage_limits"].isNotNull(), "Required"),
    ]
    limits = plans.select("provider_id", x["id"].alias("item"), F.explode("x.usage_limits").alias("y"))
    y = c("y")
    limit_rules = [
        _rule("plans[].usage_limits[].type", y["type"].isin(K.LIMIT_TYPES), "Invalid enum value"),
        _rule("plans[].usage_limits[].value", y["value"].isNull() | (y["value"] > 0), "Must be > 0"),
        *_provenance_rules(y["provenance"], "plans[].usage_limits[].provenance"),
    ]
    refs = plans.select("provider_id", x["id"].alias("item"), F.explode("x.models").alias("y"))
    ref_rules = [
        _rule("plans[].models[].model_id", _filled(y["model_id"]), "Required"),
        _rule("plans[].models[].access_type", y["access_type"].isin(K.ACCESS_TYPES), "Invalid enum value"),
    ]
    models = d.select("provider_id", F.explode("models").alias("x"))
    model_rules = [
        *[_rule(f"models[].{n}", _filled(x[n]), "Required") for n in ("id", "provider_id", "display_name")],
        _rule("models[].context_length_k", x["context_length_k"].isNull() | (x["context_length_k"] > 0), "Must be > 0"),
        _rule("models[].released_date", x["released_date"].isNull() | x["released_date"].rlike(_DATE), "Must be YYYY-MM-DD"),
        _rule("models[].strengths", x["strengths"].isNotNull(), "Required"),
        _rule("models[].benchmarks", x["benchmarks"].isNotNull(), "Required"),
        *_provenance_rules(x["provenance"], "models[].provenance"),
    ]
    bench = models.select("provider_id", x["id"].alias("item"), F.explode("x.benchmarks").alias("y"))
    bench_rules = [
        _rule("models[].benchmarks[].name", _filled(y["name"]), "Required"),
        _rule("models[].benchmarks[].score", y["score"].isNull() | y["score"].between(0, 200), "Must be 0-200"),
        _rule("models[].benchmarks[].unit", y["unit"].isin(K.BENCHMARK_UNITS), "Invalid enum value"),
        _rule("models[].benchmarks[].higher_is_better", y["higher_is_better"].isNotNull(), "Required"),
        *_provenance_rules(y["provenance"], "models[].benchmarks[].provenance"),
    ]
    return reduce(
        DataFrame.unionByName,
        [
            problems(d, F.lit(None).cast("string"), top),
            problems(plans, x["id"], plan_rules),
            problems(limits, c("item"), limit_rules),
            problems(refs, c("item"), ref_rules),
            problems(models, x["id"], model_rules),
            problems(bench, c("item"), bench_rules),
        ],
    )


def load_providers(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Strict read: raises when any document breaks a rule, then keeps in-scope plans and current models."""
    docs = read_documents(spark, path)
    found = validation_problems(docs)
    shown = found.limit(20).collect()
    if shown:
        lines = [f'Provider "{r.provider_id}": {r.path} {r.message}' for r in shown]
        lines.append(f"{found.count()} problems in all; validation_problems lists them")
        raise InvalidDocuments("Data validation failed:\n" + "\n".join(lines))
    return docs.withColumns(
        {
            "plans": F.filter("plans", lambda p: in_scope(p["tier"], p["pricing"]["monthly_usd"])),
            "models": F.filter("models", lambda m: current_model(m["released_date"].cast("date"), as_of)),
        }
    )


# --- flat tables ------------------------------------------------------------------------


def plans_of(docs: DataFrame, active_only: bool = True) -> DataFrame:
    """One row per plan with its provider; ``ord`` is the position in the document."""
    flat = docs.select(
        F.col("id").alias("provider_id"), F.col("name").alias("provider_name"), F.posexplode("plans").alias("ord", "p")
    )
    rows = flat.select(
        "provider_id", "provider_name", "ord", F.col("p.id").alias("plan_id"), F.col("p.name").alias("plan_name"), F.col("p.tier").alias("tier"),
        F.col("p.pricing.monthly_usd").alias("monthly_usd"), F.col("p.pricing.annual_monthly_usd").alias("annual_usd"),
        F.col("p.pricing.currency").alias("currency"), F.col("p.pricing.notes").alias("price_notes"),
        F.col("p.pricing.provenance.confidence").alias("pricing_confidence"),
        F.col("p.pricing.provenance.accessed_date").cast("date").alias("accessed_date"),
        F.col("p.last_verified").cast("date").alias("last_verified"), F.col("p.is_active").alias("is_active"),
        F.col("p.source_url").alias("source_url"), F.col("p.features").alias("features"), F.col("p.models").alias("models"),
        F.col("p.usage_limits").alias("usage_limits"),
    )
    return rows.where("is_active") if active_only else rows


def api_plans_of(docs: DataFrame) -> DataFrame:
    """Active pay-per-token plans, read from unfiltered documents."""
    return plans_of(docs).where(F.col("tier") == "api")


def refs_of(plans: DataFrame) -> DataFrame:
    return plans.select("plan_id", F.posexplode("models").alias("ord", "r")).select(
        "plan_id", "ord", F.col("r.model_id").alias("model_id"), F.col("r.access_type").alias("access_type"),
        F.coalesce("r.is_default", F.lit(False)).alias("is_default"),
    )


def limits_of(plans: DataFrame) -> DataFrame:
    """Usage limits with their position; ready for ``document_limit`` and ``normalize_limits``."""
    return plans.select("plan_id", F.posexplode("usage_limits").alias("ord", "u")).select(
        "plan_id", F.lit(None).cast("string").alias("model_id"), "ord", F.col("u.type").alias("limit_type"), F.col("u.value").alias("limit_value"),
        F.col("u.unit").alias("limit_unit"), F.col("u.reset_window").alias("reset_window"), F.col("u.notes").alias("notes"),
        F.col("u.provenance.confidence").alias("confidence"), F.col("u.provenance.accessed_date").cast("date").alias("accessed_date"),
    )


def models_of(docs: DataFrame) -> DataFrame:
    flat = docs.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name"), F.posexplode("models").alias("ord", "m"))
    return flat.select(
        "provider_id", "provider_name", "ord", F.col("m.id").alias("model_id"), F.col("m.display_name").alias("display_name"),
        F.col("m.family").alias("family"), F.col("m.released_date").cast("date").alias("released_date"),
        F.col("m.context_length_k").alias("context_length_k"), F.col("m.strengths").alias("strengths"), F.col("m.benchmarks").alias("benchmarks"),
        F.col("m.provenance").alias("provenance"),
    )


# --- score files ---------------------------------------------------------------------------

SCORE_FILE = (
    "observed_at string, source string, scores array<struct<modelId:string,aaSlug:string,intelligenceIndex:double,codingIndex:double,"
    "agenticIndex:double,speedTps:double,inputPrice:double,outputPrice:double,costPerTaskUsd:double>>"
)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score file rows: one row per model, speeds still in tokens per second."""
    raw = spark.read.schema(SCORE_FILE).option("multiLine", True).json(path)
    s = raw.select(F.col("observed_at").cast("date").alias("observed_at"), "source", F.posexplode("scores").alias("ord", "s"))
    return s.select(
        F.col("s.modelId").alias("model_id"), F.col("s.aaSlug").alias("slug"), F.col("s.intelligenceIndex").alias("intelligence"),
        F.col("s.codingIndex").alias("coding"), F.col("s.agenticIndex").alias("agentic"), F.col("s.speedTps").alias("speed_tps"),
        F.col("s.inputPrice").alias("price_in"), F.col("s.outputPrice").alias("price_out"), F.col("s.costPerTaskUsd").alias("cost_per_task"),
        "observed_at", "source", "ord",
    )


def score_table(file_rows: DataFrame) -> DataFrame:
    """Rows for the score table: coding falls back to intelligence, agentic is proxied from coding, speed is scaled."""
    from tollgauge.functions.capacity import speed_score

    coding = F.coalesce("coding", "intelligence")
    metrics = F.to_json(
        F.struct(
            F.col("cost_per_task").alias("costPerTaskUsd"),
            F.when(F.col("cost_per_task").isNotNull(), F.col("observed_at").cast("string")).alias("accessedDate"),
        ),
        {"ignoreNullFields": "false"},
    )
    return file_rows.select(
        "model_id", "observed_at", "intelligence", coding.alias("coding"), coding.alias("agentic"), speed_score(F.col("speed_tps")).alias("speed"),
        "price_in", "price_out", "cost_per_task", metrics.alias("metrics_json"), F.lit("observed").alias("confidence"), "source", "ord",
    )


def scores_or_fallback(table: DataFrame, file_rows: DataFrame) -> DataFrame:
    """Latest table rows; when the table is empty, file rows with unknown speed."""
    from tollgauge.operators.ordering import latest

    if table.isEmpty():
        return file_rows.select(
            "model_id", "intelligence", "coding", "agentic", F.lit(None).cast("double").alias("speed"), "price_in", "price_out",
            "cost_per_task", "observed_at", F.lit("observed").alias("confidence"),
        )
    return latest(table, ["model_id"], [F.col("observed_at").desc(), F.col("ord").desc()]).select(
        "model_id", "intelligence", "coding", "agentic", "speed", "price_in", "price_out", "cost_per_task", "observed_at", "confidence"
    )
