"""A corpus from documents: language, near duplicates, PII, mix, pieces. Every stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgauge.llm.jaccard import keep_one
from tollgauge.llm.language import fit_languages, identify
from tollgauge.llm.mixing import mix
from tollgauge.llm.pieces import encode
from tollgauge.llm.surrogates import replace_entities
from tollgauge.llm.tables import row_key, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is clear; ``lang`` becomes the predicted one."""
    found = identify(docs.select(*COLUMNS), fit_languages(docs), margin=0.25)
    return found.where("NOT ambiguous").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs.select(*COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for entities; ``n_chars`` follows the new text."""
    return replace_entities(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    own = docs.select(*COLUMNS).withColumn("k_", row_key("doc_id", "text"))
    taken = mix(docs).groupBy(F.col("k").alias("k_")).agg(F.sum("copies").alias("times_")).where("times_ > 0")
    # rows with one key are equal in id and text: together they are taken as often as the mix takes them all
    once = own.join(taken, "k_").dropDuplicates(["k_"])
    return once.withColumn("n_", F.explode(F.sequence(F.lit(1), F.col("times_").cast("int")))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of every document, and whether they decode to its text."""
    return encode(docs)


STAGES = [("language", languages), ("near_duplicates", near_duplicates), ("pii", pii), ("mixture", mixture), ("pieces", pieces)]
#: Trained models, hashes and the tokenizer's pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
