"""Quality rules: simple base rules, then robust multivariate outliers by minimum covariance determinant.

Every text gives statistics: words, characters in words, symbols, repeated lines, words in repeated 8-word windows, capitals. Shares of
them (square roots, so that their spread does not hang on their level) and the logarithm of the mean word length form a vector. For each
language and source, the half-to-three-quarters of its texts with the least covariance determinant are sought by concentration steps:
start from medians and median deviations, keep the ``keep`` share nearest by Mahalanobis distance, estimate again. The last estimate is
made consistent, reweighted once, and texts beyond ``limit`` are rejected. Group estimates are sums, so a hot source is summed in every
task first.

Only DataFrame functions run here. Diagonals get a floor, as over half of a group may agree exactly in a statistic.

Defined cases: null counts as an empty text, without words, and fails the base rules; a group (null language or source is a group
of its own) with fewer than ``least`` texts that pass the base rules is judged by the estimate over all small groups together, and with
fewer than ``least`` in all of them, by the base rules alone; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgauge.llm.tables import WORDS, stored

WINDOW, SALTS = 8, 32
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
VECTOR = ("length", "symbols", "capitals", "lines", "repeats")
#: Least standard deviation of each part of the vector.
FLOORS = (0.06, 0.03, 0.06, 0.2, 0.2)
#: Consistency of a covariance over the central 75 % in five dimensions: 0.75 / P(chi2_7 <= chi2_5's 75 % point).
CONSISTENCY = 1.519
#: chi2 quantiles with five degrees of freedom.
REWEIGHT, LIMIT = 12.83, 25.74


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Array of a text's words."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WORDS, -1)).otherwise(F.array().cast("array<string>"))


def without(text: Column, characters: str) -> Column:
    """Number of code points of a text that are none of ``characters``."""
    return F.length(F.translate(text, characters, ""))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice: neighbours in sorted order give the places, and a running end counts each word once."""
    pair = lambda h, i: F.struct(h.alias("h"), i.alias("i"))

    def places(p: Column) -> Column:
        same = lambda a, b: F.get(p, a)["h"] == F.get(p, b)["h"]
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda j: F.when((j > 0) & same(j, j - 1) | (j < F.size(p) - 1) & same(j, j + 1), F.get(p, j)["i"])), lambda x: x.isNotNull())

    at = let(F.sort_array(F.transform(windows, pair)), places)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"))
    return F.aggregate(F.sort_array(at), start, step, lambda s: s["n"])


def repeated_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur at least twice in the text."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    count = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW, count).otherwise(F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, lang, source, text) without the text, with the base columns and the vector's parts."""
    text = F.coalesce("text", F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    x = docs.select("doc_id", "lang", "source", text.alias("text")).withColumns({"words": words_of(F.col("text"))})
    x = x.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), without(F.col("text"), BLANKS).cast("long").alias("word_chars"),
        (F.length("text") - without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"), (F.length("text") - without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
        let(full, lambda f: F.struct(F.size(f).cast("long").alias("n"), (F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("dup"))).alias("lines"), repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    x = x.select("*", F.col("lines.dup").alias("n_dup_lines"), ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"))
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    return x.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.log(chars / words + 1).alias("length"), F.sqrt(F.col("n_symbols") / chars).alias("symbols"), F.sqrt(F.col("n_capitals") / chars).alias("capitals"),
        F.sqrt(F.col("lines.dup") / F.greatest(F.col("lines.n"), F.lit(1))).alias("lines"), F.sqrt(F.col("n_repeat_words") / words).alias("repeats"),
    )


def _by_group(rows: DataFrame, per: DataFrame, how: str = "inner") -> DataFrame:
    """Join one row per group to its rows: a hot group is spread over salts, and the group's row is copied to each of them."""
    return rows.join(per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "salt"], how)


def _estimate(rows: DataFrame, scale: float) -> DataFrame:
    """(g, centre, root): mean and inverse Cholesky factor of the covariance per group, floors added to the diagonal."""
    p = len(VECTOR)
    sums = [F.avg(v).alias(f"m{i}") for i, v in enumerate(VECTOR)]
    sums += [F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    t = rows.groupBy("g").agg(F.count("*").alias("n"), *sums)
    for i in range(p):  # lower factor, row by row
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") * scale + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            t = t.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 * 1e-3))) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(p):  # its inverse
        for j in range(i + 1):
            value = F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"r{k}{j}") for k in range(j, i)), F.lit(0.0))
            t = t.withColumn(f"r{i}{j}", value / F.col(f"l{i}{i}"))
    return t.select("g", "n", F.array(*[f"m{i}" for i in range(p)]).alias("centre"), F.array(*[F.array(*[f"r{i}{j}" for j in range(i + 1)]) for i in range(p)]).alias("root"))


def _distance() -> Column:
    """Squared Mahalanobis distance from centre and root."""
    total = F.lit(0.0)
    for i in range(len(VECTOR)):
        part = sum((F.col("root")[i][j] * (F.col(VECTOR[j]) - F.col("centre")[j]) for j in range(i + 1)), F.lit(0.0))
        total = total + part * part
    return total


def minimum_covariance(rows: DataFrame, keep: float = 0.75, steps: int = 4) -> DataFrame:
    """(g, n, centre, root) per group g of ``rows`` (g and the vector), by concentration steps and one reweighting."""
    middle = rows.groupBy("g").agg(*[F.percentile_approx(v, 0.5, 1000).alias(f"m{i}") for i, v in enumerate(VECTOR)])
    off = _by_group(rows, middle).groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(v) - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i, v in enumerate(VECTOR)])
    p = len(VECTOR)
    root = F.array(*[F.array(*[F.lit(0.0)] * i, 1 / F.sqrt(F.col(f"s{i}") * F.col(f"s{i}") * 1.4826**2 + FLOORS[i] ** 2)) for i in range(p)])
    now = stored(middle.join(off, "g").select("g", F.array(*[f"m{i}" for i in range(p)]).alias("centre"), root.alias("root")))
    for _ in range(steps):
        away = _by_group(rows, now).select("g", *VECTOR, "salt", _distance().alias("away"))
        near = stored(away.groupBy("g").agg(F.percentile_approx("away", keep, 1000).alias("edge")))
        now = stored(_estimate(_by_group(away, near).where("away <= edge"), CONSISTENCY))
    away = _by_group(rows, now.select("g", "centre", "root")).select("g", *VECTOR, _distance().alias("away"))
    return stored(_estimate(away.where(F.col("away") <= REWEIGHT), 1.0))


def quality_outliers(docs: DataFrame, limit: float = LIMIT, least: int = 50) -> DataFrame:
    """The base columns, ``distance`` (squared; null where no estimate applies) and ``kept`` per row of ``docs``."""
    found = stored(statistics(docs).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")))
    clean = found.where(~F.col("base_failed"))
    pair = F.to_json(F.struct("lang", "source"))  # names a group, nulls included
    large = clean.groupBy(pair.alias("g")).count().where(F.col("count") >= least).select("g", F.lit(True).alias("large"))
    group = F.when(F.col("large"), F.col("g")).otherwise(F.lit(""))
    named = _by_group(found.withColumn("g", pair), large, "left").withColumn("g", group).drop("large")
    estimate = minimum_covariance(named.where(~F.col("base_failed")).select("g", "salt", *VECTOR)).where(F.col("n") >= least // 2)
    judged = _by_group(named, estimate.select("g", "centre", "root"), "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= limit))
    return judged.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def op6_robust_outliers(docs: DataFrame) -> DataFrame:
    return quality_outliers(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
