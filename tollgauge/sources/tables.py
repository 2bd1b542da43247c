"""Table reads and writes: seeding, appends, replace-by-date and published JSON."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tollgauge import constants as K
from tollgauge.functions.basics import effective_price, in_scope
from tollgauge.operators.history import newest_runs, price_moves
from tollgauge.operators.ordering import latest
from tollgauge.sources import documents as D


class MissingTable(RuntimeError):
    """A required table is absent, empty or lacks columns."""


def read_table(spark: SparkSession, path: str, required: Sequence[str] = (), allow_empty: bool = False, format: str = "parquet") -> DataFrame:
    """Read a required table; absent, empty or incomplete tables raise instead of publishing nothing."""
    try:
        df = spark.read.format(format).load(path)
    except AnalysisException as e:
        raise MissingTable(f"required table {path} is missing") from e
    lacking = sorted(set(required) - set(df.columns))
    if lacking:
        raise MissingTable(f"table {path} lacks columns: {', '.join(lacking)}")
    if not allow_empty and df.isEmpty():
        raise MissingTable(f"required table {path} is empty")
    return df


def read_or_none(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None where nothing is there; a table that can't be read raises its error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.format(format).load(path)


# --- seeding -------------------------------------------------------------------------------


def seed_tables(docs: DataFrame, observed_at: Column) -> dict[str, DataFrame]:
    """Relational tables from provider documents.

    Models are global: the first document (by provider id) that lists an id wins. Only in-scope plans are
    seeded, and their effective price is the annual price when there is one, even if it is higher.
    """
    all_plans = D.plans_of(docs, active_only=False)
    plans = all_plans.where(in_scope(F.col("tier"), F.col("monthly_usd")))
    prefix = F.concat("provider_id", F.lit("-"))
    # only the first occurrence of the prefix goes, wherever it stands
    at = F.instr("plan_id", prefix)
    slug = F.when(at > 0, F.concat(F.substr("plan_id", F.lit(1), at - 1), F.substr("plan_id", at + F.length(prefix)))).otherwise(F.col("plan_id"))
    pages = docs.select(
        F.col("id").alias("provider_id"),
        F.explode(F.array(F.struct(F.lit("pricing").alias("page_type"), F.col("pricing_url").alias("url")),
                          F.struct(F.lit("docs").alias("page_type"), F.col("docs_url").alias("url")))).alias("p"),
    ).select("provider_id", "p.*", F.lit(True).alias("enabled"))
    return {
        "providers": docs.select(
            F.col("id").alias("provider_id"), F.col("id").alias("slug"), "name", F.col("website").alias("website_url"), "pricing_url",
            F.lit("active").alias("status"), F.col("description").alias("notes"), observed_at.alias("created_at"),
        ),
        "source_pages": pages.where(F.col("url").isNotNull()),
        "models": latest(D.models_of(docs), ["model_id"], [F.col("provider_id").asc(), F.col("ord").asc()]).select(
            "model_id", "display_name", "family", "released_date", F.lit("active").alias("status")
        ),
        "plans": plans.select(
            "plan_id", "provider_id", slug.alias("slug"), "plan_name",
            F.when(F.col("annual_usd").isNotNull(), "annual").otherwise("monthly").alias("billing_interval"),
            F.col("monthly_usd").alias("listed_price"), F.coalesce("annual_usd", "monthly_usd").alias("effective_price"), "currency",
            F.col("price_notes").alias("annual_notes"), F.col("source_url").alias("plan_url"),
            F.when(F.col("is_active"), "active").otherwise("inactive").alias("status"),
        ),
        "plan_models": D.refs_of(plans).select("plan_id", "model_id", "access_type", "ord", observed_at.alias("observed_at")),
        "usage_limits": D.limits_of(plans).select(
            "plan_id", "ord", F.col("limit_type").alias("raw_limit_text"), "limit_type", "limit_value", "limit_unit", "reset_window",
            F.coalesce("confidence", F.lit("unknown")).alias("confidence"), "notes", observed_at.alias("observed_at"),
        ),
    }


def write_seed(tables: dict[str, DataFrame], root: str) -> list[str]:
    """Write tables that do not exist yet; a seeded store is left as it is."""
    written = []
    for name, df in tables.items():
        if read_or_none(df.sparkSession, f"{root}/{name}") is None:
            df.write.mode("errorifexists").parquet(f"{root}/{name}")
            written.append(name)
    return written


# --- appends and replacements ---------------------------------------------------------------


def replace_date(df: DataFrame, path: str, observed: Column) -> None:
    """Replace one date's rows: only that partition is rewritten, so a rerun leaves the same table."""
    (
        df.withColumn("observed_date", observed)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("observed_date")
        .parquet(path)
    )


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append one row for each key that the table does not hold, so a repeated batch, or a key repeated inside it, adds nothing."""
    stored = read_or_none(df.sparkSession, path)
    df = df.dropDuplicates(list(keys))
    fresh = df if stored is None else df.join(stored.select(*keys), list(keys), "left_anti")
    fresh.write.mode("append").parquet(path)


def complete_run(run: DataFrame, status: str, finished: Column) -> DataFrame:
    """Completion row of a run; the table is append-only and the newest row per run is the current one."""
    return run.withColumns({"status": F.lit(status), "finished_at": finished})


def current_runs(runs: DataFrame) -> DataFrame:
    return latest(runs, ["run_id"], [F.col("finished_at").desc_nulls_last()])


def append_run(run: DataFrame, path: str) -> DataFrame:
    """Add a ledger row and return the five newest."""
    run.write.mode("append").parquet(path)
    return newest_runs(run.sparkSession.read.parquet(path))


def roll_baseline(current: DataFrame, root: str, day: str, threshold: float = 0.2) -> DataFrame | None:
    """Compare with the newest earlier baseline, then store today's prices as their own partition.

    The baseline that is read is never the one being written. Returns None on the first run.
    """
    spark = current.sparkSession
    stored = read_or_none(spark, root)
    moves = None
    if stored is not None:
        earlier = stored.where(F.col("baseline_date") < F.lit(day).cast("date"))
        newest = earlier.agg(F.max("baseline_date")).scalar()
        moves = price_moves(current, earlier.where(F.col("baseline_date") == newest), threshold)
    replace = current.select("plan_id", "price", F.lit(day).cast("date").alias("baseline_date"))
    replace.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("baseline_date").parquet(root)
    return moves


# --- published files ---------------------------------------------------------------------------


MANIFEST = "current.json"


def _files(spark: SparkSession, root: str):
    """(path maker, file context) of Hadoop's file system at ``root``."""
    fs = spark._jvm.org.apache.hadoop.fs
    return fs.Path, fs.FileContext.getFileContext(fs.Path(root).toUri(), spark._jsc.hadoopConfiguration())


def commit_version(spark: SparkSession, root: str, tables: dict[str, DataFrame], keep: int = 2) -> str:
    """Publish ``tables`` as JSON under ``root`` all at once; returns the version's name.

    They are written to a folder of their own first. The manifest then switches to it in one rename, so a reader gets all tables of
    the old version or all of the new one, and a run that fails earlier leaves nothing but a folder no manifest names. The last
    ``keep`` published versions stay for readers that have opened them; folders of older and failed runs go with the next switch.
    """
    path, files = _files(spark, root)
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{root}/versions/{version}/{name}")
    old = manifest(spark, root)
    history = [version, *(old["history"] if old else [])][:keep]
    text = json.dumps({"version": version, "tables": sorted(tables), "history": history})
    staged = path(f"{root}/.{version}.json")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/.{version}")
    (part,) = [f.getPath() for f in files.util().listStatus(path(f"{root}/.{version}")) if f.getPath().getName().startswith("part-")]
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark._sc._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    files.rename(part, staged, over)
    files.rename(staged, path(f"{root}/{MANIFEST}"), over)
    files.delete(path(f"{root}/.{version}"), True)
    for folder in files.util().listStatus(path(f"{root}/versions")):
        if folder.getPath().getName() not in history:
            files.delete(folder.getPath(), True)
    return version


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What is published at ``root``: version, tables and the versions kept; None before the first time."""
    path, files = _files(spark, root)
    if not files.util().exists(path(f"{root}/{MANIFEST}")):
        return None
    return json.loads(spark.read.text(f"{root}/{MANIFEST}", wholetext=True).first()[0])


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of the version that is current now, from that version whatever is published later."""
    now = manifest(spark, root)
    if now is None:
        raise MissingTable(f"nothing is published at {root}")
    return {name: spark.read.json(f"{root}/versions/{now['version']}/{name}") for name in now["tables"]}


def publish(docs: DataFrame, root: str, generated: str) -> str:
    """Flat plans (also keyed by id, last duplicate wins), models, providers and the method description, committed as one version."""
    spark = docs.sparkSession
    plans = D.plans_of(docs).withColumn("effective_monthly_usd", effective_price(F.col("monthly_usd"), F.col("annual_usd")))
    by_id = latest(plans, ["plan_id"], [F.col("provider_id").desc(), F.col("ord").desc()])
    # fixed values: method description; its band texts are wider than the bands rankings use
    method = [
        (
            "3.2", "QAMU = estimatedTokens1mo × (WMQ / 100); score = QAMU × efficiencyMultiplier / price → 0–100",
            {"cost": K.PLAN_WEIGHT_COST, "benchmark": K.PLAN_WEIGHT_BENCHMARK, "feature": K.PLAN_WEIGHT_FEATURE},
            {"agentic": K.WMQ_AGENTIC, "coding": K.WMQ_CODING, "speed": K.WMQ_SPEED},
            {"free": "$0/mo", "low": "$0.01–$30/mo", "mid": "$30.01–$80/mo", "high": "$80.01+/mo"}, K.RANKINGS_VERSION, generated,
        )
    ]
    schema = (
        "version string, formula string, weights map<string,double>, wmq map<string,double>, priceBands map<string,string>, "
        "rankings_methodology_version string, generated_at string"
    )
    tables = {"plans": plans, "plans_by_id": by_id, "models": D.models_of(docs), "providers": docs, "methodology": spark.createDataFrame(method, schema)}
    return commit_version(spark, root, tables)


def publish_estimates(estimates: DataFrame, scores: DataFrame, path: str) -> DataFrame:
    """Write estimates and return the one-row count summary."""
    estimates.write.mode("overwrite").parquet(path)
    stored = estimates.sparkSession.read.parquet(path)
    return stored.agg(
        F.count("*").alias("estimates"), F.count_distinct("plan_id").alias("plans"), F.count("value_score").alias("scored")
    ).withColumn("scores", scores.agg(F.count("*")).scalar())


# fixed values: required columns of the published tables
REQUIRED = {
    "rankings": ["ranking_type", "rank", "metric_value", "confidence", "methodology_version"],
    "plans": ["plan_id", "provider_id", "plan_name", "provider_name"],
    "models": ["model_id", "provider_id", "display_name", "provider_name"],
    "methodology": ["version", "generated_at"],
}


def shape_problems(df: DataFrame, table: str) -> list[str]:
    """Required columns a published table lacks; extra columns are fine."""
    return sorted(set(REQUIRED[table]) - set(df.columns))
