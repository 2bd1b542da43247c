"""Crawl-rule files as rows, and URL decisions as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollgauge.functions.text import trim_space


FILE = ["host", "agent"]


def parse_rules(files: DataFrame) -> DataFrame:
    """Rules of the most specific matching agent group: host, agent, kind, path, crawl_delay.

    ``files``: host, agent (our user agent), content. Rows whose ``kind`` is null keep a crawl delay without
    any rule. Lines of one file are windowed together; a file is one input value, so that window is bounded.
    """
    line = trim_space(F.regexp_replace(F.col("raw"), "#.*$", ""))
    lines = (
        files.select(*FILE, F.posexplode(F.split("content", r"\r?\n")).alias("pos", "raw"))
        .withColumn("line", line)
        .where(F.col("line").contains(":"))
        .select(
            *FILE, "pos",
            F.lower(trim_space(F.substring_index("line", ":", 1))).alias("field"),
            trim_space(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"),
        )
    )
    by_line = W.partitionBy(*FILE).orderBy("pos")
    is_agent = F.col("field") == "user-agent"
    opens = is_agent & ~F.coalesce(F.lag(is_agent).over(by_line), F.lit(False))
    grouped = lines.withColumn("opens", F.when(opens, 1).otherwise(0)).withColumn("grp", F.sum("opens").over(by_line))
    # every agent line votes for its group: longest token first, '*' last, earlier group on ties
    value = F.col("value")
    applies = is_agent & ((value == "*") | F.lower("agent").contains(F.lower(value)))
    weight = F.when(value == "*", 0).otherwise(F.length(value))
    whole = W.partitionBy(*FILE)
    best = F.max(F.when(applies, F.struct(weight.alias("w"), (-F.col("grp")).alias("g")))).over(whole)
    delay_value = F.when(value == "", F.lit(0.0)).otherwise(value.try_cast("double"))
    mine = grouped.where("grp > 0").withColumn("chosen", -best["g"]).where(F.col("grp") == F.col("chosen"))
    is_delay = (F.col("field") == "crawl-delay") & delay_value.isNotNull()
    delay = F.max_by(F.when(is_delay, delay_value), F.when(is_delay, F.col("pos"))).over(whole)
    body = mine.withColumns({"crawl_delay": delay, "head": F.min("pos").over(whole)}).where(
        F.col("field").isin("allow", "disallow") | (F.col("pos") == F.col("head"))
    )
    is_rule = F.col("field").isin("allow", "disallow")
    return body.select(*FILE, F.when(is_rule, F.col("field")).alias("kind"), F.when(is_rule, value).alias("path"), "crawl_delay")


def url_parts(urls: DataFrame, url: str) -> DataFrame:
    """Adds lower-case host and path ('/' when missing); malformed URLs get nulls."""
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    path = F.try_parse_url(F.col(url), F.lit("PATH"))
    return urls.withColumn("host", host).withColumn("path", F.when(path == "", "/").otherwise(path))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``agent`` and ``allowed``: the longest rule that prefixes the path decides, allow wins ties, no rule allows.

    Paths only look up the prefix lengths their host has rules for, so matching is an equi-join on
    (host, agent, prefix) with one rule row per key; a host with a third of all URLs is split by AQE.
    """
    live = rules.where(F.col("kind").isNotNull() & ~((F.col("kind") == "disallow") & (F.col("path") == "")))
    per_prefix = live.groupBy(*FILE, F.col("path").alias("prefix")).agg(F.max(F.col("kind") == "allow").alias("allow"))
    lengths = per_prefix.groupBy(*FILE).agg(F.collect_set(F.length("prefix")).alias("lengths"))
    places = urls.select("host", "path").where(F.col("host").isNotNull()).distinct()
    probes = (
        places.join(lengths, "host")
        .withColumn("n", F.explode("lengths"))
        .where(F.col("n") <= F.length("path"))
        .withColumn("prefix", F.expr("left(path, n)"))
    )
    verdict = (
        probes.join(per_prefix, [*FILE, "prefix"])
        .groupBy(*FILE, "path")
        .agg(F.max(F.struct("n", "allow")).alias("best"))
        .select(*FILE, "path", F.col("best.allow").alias("allow"))
    )
    known = rules.groupBy(*FILE).agg(F.max("crawl_delay").alias("crawl_delay"))
    return (
        urls.join(known, "host", "left")
        .join(verdict, [*FILE, "path"], "left")
        .withColumn("allowed", F.coalesce("allow", F.lit(True)))
        .drop("allow")
    )
