"""Provenance records anywhere in nested documents, with their paths and age.

Documents are VARIANT values. A walk takes one level at a time: records leave, other objects and arrays are opened by
``variant_explode``. Only containers go on, so a level holds no more rows than the documents have containers at that depth, and the
number of steps is the depth of the deepest document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgauge.session import durable

#: Days after which a record is stale: assumed values sooner than others.
ASSUMED_DAYS, OTHER_DAYS = 30, 90


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(owner, document) per JSON file: file name without its ending, content as VARIANT; null for a broken file."""
    raw = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1)
    return raw.select(name.alias("owner"), F.try_parse_json("value").alias("document"))


def provenance_records(docs: DataFrame) -> DataFrame:
    """(owner, path, confidence, accessed_date, url) of every object with an ``accessed_date``, once each.

    ``docs``: owner, document (VARIANT). Nothing below a record is looked at. Paths read ``plans[0].pricing.provenance``; that of a
    document that is a record itself is empty.
    """
    level, found = docs.select("owner", F.lit("").alias("path"), F.col("document").alias("node")), []
    kind = F.schema_of_variant("node")
    is_object, is_array = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    record = is_object & F.try_variant_get("node", "$.accessed_date", "variant").isNotNull()
    spark = docs.sparkSession
    while True:
        level = durable(level.where(is_object | is_array).withColumn("record", record))
        if level.isEmpty():
            break
        found.append(level.where("record"))
        opened = level.where("NOT record").lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.when(F.col("path") != "", ".").otherwise(""), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = opened.select("owner", F.concat("path", step).alias("path"), F.col("value").alias("node"))
    get = lambda name, type_="string": F.try_variant_get("node", f"$.{name}", type_).alias(name)
    if not found:
        return level.select("owner", "path", get("confidence"), get("accessed_date", "date"), get("url"))
    return reduce(DataFrame.unionByName, found).select("owner", "path", get("confidence"), get("accessed_date", "date"), get("url"))


def is_stale(as_of: Column) -> Column:
    """Records too old for their confidence; unknown confidence and missing dates are never stale."""
    days = F.datediff(as_of, F.col("accessed_date"))
    limit = F.when(F.col("confidence") == "assumed", ASSUMED_DAYS).otherwise(OTHER_DAYS)
    return F.coalesce(F.col("accessed_date").isNotNull() & ~F.col("confidence").eqNullSafe(F.lit("unknown")) & (days > limit), F.lit(False))
