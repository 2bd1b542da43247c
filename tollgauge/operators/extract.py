"""Prices, limits, footnotes and page summaries from text, computed inside each row.

Hits of all patterns stay arrays until the final explode, so a corpus pass is one narrow stage: no
shuffle, and the page text itself is never copied per hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgauge import constants as K
from tollgauge.functions.basics import number_text
from tollgauge.functions.text import (
    SPACE,
    WORD_END,
    WORD_START,
    free_tier_label,
    markable,
    once,
    pattern_confidence,
    pattern_hits,
    price_per_month,
    reset_code,
    trim_short,
    trim_space,
)

S = SPACE
_PERIODS = r"second|min(?:ute)?|hour|day|week|month|mo|yr|year"

# fixed values: text patterns
PRICE = rf"(?i)\$(\d{{1,4}}(?:,\d{{3}})*(?:\.\d{{2}})?){S}*(?:/|{S}*per{S}*)?{S}*(mo(?:nth)?|yr|year|seat|user)?"
PAGE_PRICE = r"\$(\d{1,4}(?:\.\d{2})?)"
LIMITS = [
    # (kind, pattern, value group, unit group, window group)
    (
        "hard_numeric",
        rf"(?i)(\d{{1,6}}(?:,\d{{3}})*){S}*(messages?|requests?|calls?|queries?|tokens?|words?|documents?|pages?|seats?|users?"
        rf"|conversations?|{WORD_START}API{WORD_END}){S}*(?:per|/){S}*({_PERIODS})?",
        1, 2, 3,
    ),
    (
        "relative",
        rf"(?i)(\d+)x?{S}*(?:more|less|higher|the){S}*(usage|rate|limit|messages|tokens|requests)?",
        1, None, None,
    ),
    ("credits", rf"(?i)(\d{{1,7}}(?:,\d{{3}})*){S}*credits?{S}*(?:per|/){S}*({_PERIODS})?", 1, None, 2),
    (
        "time_windowed",
        rf"(?i)(?:every|per|each|reset{S}*(?:every|after)){S}+(\d+){S}*(second|min(?:ute)?|hour|day|week|month)",
        1, 2, None,
    ),
    ("rate_limit", rf"(?i){WORD_START}(rate{S}*limit(?:ed)?|throttled|rate{S}*limiting){WORD_END}", None, None, None),
    (
        "vague",
        rf"(?i){WORD_START}(unlimited|fair{S}*use|fair{S}*usage{S}*(?:policy|limit)|acceptable{S}*use){WORD_END}",
        None, None, None,
    ),
    (
        "model_specific",
        rf"(?i){WORD_START}(varies{S}*(?:by|depending{S}*on)|depends{S}*on{S}*(?:the{S}*)?model|model[- ]dependent|per[- ]model){WORD_END}",
        None, None, None,
    ),
]
CATCH_ALL = rf"(?i){WORD_START}(limited{S}*usage|restricted|usage{S}*limits?{S}*apply|capped|usage{S}*caps?){WORD_END}"
_LINE = r"[^\n\r\x{2028}\x{2029}]"
ASTERISK = rf"\*{S}*({_LINE}+?)(?:\n|\z)"
FINE_PRINT = r"(?i)(?:fine print|terms apply|subject to|restrictions apply)[^.]*\."
AS_OF_MARK = r"(?i)(?:as of|last updated|pricing effective)[^.]*\."
CAVEAT = rf"(?i)(?:limited to|capped at|maximum of|up to){S}[^.]*\."


_PRICES = "array<struct<pos:int,raw:string,amount:double,interval:string,confidence:string,context:string>>"
_LIMIT = (
    "array<struct<pos:int,raw:string,kind:string,value:double,unit:string,reset_window:string,confidence:string,"
    "needs_normalization:boolean,context:string>>"
)


def _first_of_each(items: Column, key) -> Column:
    """Keep the first array item per key, in order: equal keys are neighbours after a sort by (key, place)."""

    def kept(own: Column) -> Column:
        keyed = F.sort_array(F.transform(own, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
        first = once(keyed, lambda s: F.filter(s, lambda x, j: (j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(x["k"])))
        return F.when(F.size(own) <= 1, own).otherwise(F.transform(F.sort_array(F.transform(first, lambda x: x["i"])), lambda i: F.get(own, i)))

    return once(items, kept)


def prices(text: Column) -> Column:
    """Distinct price mentions as array<struct<pos, raw, amount, interval, confidence, context>>."""
    hits = _first_of_each(pattern_hits(text, PRICE, 100), lambda h: h["raw"])

    def describe(h: Column) -> Column:
        word = F.lower(F.regexp_extract(h["raw"], PRICE, 2))
        interval = F.when(word.isin("month", "mo"), "monthly").when(word.isin("year", "yr"), "annual")
        amount = F.replace(F.regexp_extract(h["raw"], PRICE, 1), F.lit(","), F.lit("")).cast("double")
        return F.struct(
            h["pos"].alias("pos"), h["raw"].alias("raw"), amount.alias("amount"), interval.alias("interval"),
            pattern_confidence(F.lit("exact"), h["context"]).alias("confidence"),
            F.left(h["context"], F.lit(200)).alias("context"),
        )

    return F.transform(hits, describe)


def _limit_key(raw: Column) -> Column:
    return trim_short(F.lower(raw))


def limits(text: Column) -> Column:
    """Usage limits as array<struct<pos, raw, kind, value, unit, reset_window, confidence, needs_normalization, context>>.

    Seven pattern classes in order; equal texts count once, for the first class. A catch-all class adds
    vague wording that does not overlap an accepted hit. Accepted hits of different classes may overlap.
    """
    parts = [F.transform(pattern_hits(text, p[1], 80), _limit_of(*p)) for p in LIMITS]
    return _first_of_each(F.concat(*parts), lambda x: _limit_key(x["raw"]))


def _limit_of(kind: str, pattern: str, value_g: int | None, unit_g: int | None, window_g: int | None):
    """Function from a hit of one pattern class to its limit struct."""
    exactness = kind if kind in ("relative", "vague") else "fuzzy"

    def found(h: Column, g: int | None) -> Column:
        return F.lit(None).cast("string") if g is None else F.regexp_extract(h["raw"], pattern, g)

    def describe(h: Column) -> Column:
        observed = kind in ("hard_numeric", "credits")

        def limit(g: Column) -> Column:
            group = lambda name: F.nullif(g[name], F.lit(""))
            return F.struct(
                h["pos"].alias("pos"), h["raw"].alias("raw"), F.lit(kind).alias("kind"),
                F.when(g["number"] != 0, g["number"]).alias("value"), group("unit").alias("unit"),
                g["window"].alias("reset_window"),
                (F.lit("observed") if observed else pattern_confidence(F.lit(exactness), h["context"])).alias("confidence"),
                F.lit(kind == "relative").alias("needs_normalization"), F.left(h["context"], F.lit(200)).alias("context"),
            )

        def value(raw: Column) -> Column:
            return F.replace(F.nullif(raw, F.lit("")), F.lit(","), F.lit("")).cast("double")

        # each group is searched once, however often its value is read
        number = F.lit(None).cast("double") if value_g is None else once(found(h, value_g), value)
        window = F.lit(None).cast("string") if window_g is None else once(once(found(h, window_g), lambda w: F.lower(trim_short(F.nullif(w, F.lit(""))))), reset_code)
        return once(F.struct(number.alias("number"), found(h, unit_g).alias("unit"), window.alias("window")), limit)

    return describe


def vague_limits(text: Column, found: Column) -> Column:
    """Catch-all hits that neither overlap nor repeat ``found``; same struct as ``limits``."""
    keys = F.transform(found, lambda x: _limit_key(x["raw"]))

    def free(h: Column) -> Column:
        end = h["pos"] + F.length(h["raw"])
        clash = F.exists(found, lambda x: (h["pos"] < x["pos"] + F.length(x["raw"])) & (end > x["pos"]))
        return ~clash & ~F.array_contains(keys, _limit_key(h["raw"]))

    none = F.lit(None)
    hits = _first_of_each(F.filter(pattern_hits(text, CATCH_ALL, 80), free), lambda h: _limit_key(h["raw"]))
    return F.transform(
        hits,
        lambda h: F.struct(
            h["pos"].alias("pos"), h["raw"].alias("raw"), F.lit("vague").alias("kind"), none.cast("double").alias("value"),
            none.cast("string").alias("unit"), none.cast("string").alias("reset_window"), F.lit("unknown").alias("confidence"),
            F.lit(False).alias("needs_normalization"), F.left(h["context"], F.lit(200)).alias("context"),
        ),
    )


def footnotes(text: Column) -> Column:
    """Distinct small print: asterisk lines, boilerplate, date marks, caveats; in that order."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(ASTERISK), F.lit(1)),
        F.regexp_extract_all(text, F.lit(FINE_PRINT), F.lit(0)),
        F.regexp_extract_all(text, F.lit(AS_OF_MARK), F.lit(0)),
        F.regexp_extract_all(text, F.lit(CAVEAT), F.lit(0)),
    )
    return F.array_distinct(F.filter(F.transform(found, trim_space), lambda x: x != ""))


def page_prices(text: Column) -> Column:
    """Sorted distinct amounts between 0 and 10000."""
    amounts = F.transform(F.regexp_extract_all(text, F.lit(PAGE_PRICE), F.lit(1)), lambda x: x.cast("double"))
    return F.array_sort(F.array_distinct(F.filter(amounts, lambda x: (x > 0) & (x < 10000))))


def with_extractions(df: DataFrame, text: str, page_type: str | None = None) -> DataFrame:
    """Adds price, limit and footnote arrays, gated by page type when there is one."""
    df = df.withColumn("__plain", markable(F.col(text)))
    t = F.col("__plain")
    pricing = F.lit(True) if page_type is None else F.col(page_type) == "pricing"
    disclosed = F.lit(True) if page_type is None else F.col(page_type).isin("pricing", "docs")
    out = df.withColumns({"prices": prices(F.when(pricing, t)), "__found": limits(F.when(disclosed, t))})
    out = out.withColumn("limits", F.concat("__found", vague_limits(F.when(disclosed, t), F.col("__found")))).drop("__found")
    return out.withColumns(
        {
            "prices": F.coalesce("prices", F.array().cast(_PRICES)),
            "limits": F.coalesce("limits", F.array().cast(_LIMIT)),
            "footnotes": footnotes(F.col(text)),
        }
    ).drop("__plain")


def assumptions(text: Column, prices_: Column, limits_: Column, mentions: Column) -> Column:
    """Factual sentences on what extraction found. ``mentions`` is a count."""
    no_interval = F.size(F.filter(prices_, lambda p: p["interval"].isNull()))
    need = F.size(F.filter(limits_, lambda x: x["needs_normalization"]))
    free = F.exists(prices_, lambda p: p["amount"] == 0)
    return F.array_compact(
        F.array(
            F.concat(F.size(prices_), F.lit(" price(s) extracted, "), no_interval, F.lit(" without billing interval")),
            F.concat(F.size(limits_), F.lit(" usage limit(s) extracted, "), need, F.lit(" require normalization")),
            F.concat(mentions, F.lit(" model mention(s) found")),
            F.when(~free, F.lit("No free tier detected")),
            F.lit("All prices assumed USD"),
            F.concat(F.lit("Text length: "), F.length(text), F.lit(" chars")),
        )
    )


def price_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per price mention with its monthly amount."""
    p = exploded(df, keys, F.col("prices"), "p").select(*keys, "p.*")
    return p.withColumn("effective_monthly", price_per_month(F.col("amount"), F.col("interval")))


def limit_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    return exploded(df, keys, F.col("limits"), "x").select(*keys, "x.*")


def exploded(df: DataFrame, keys: list[str], items: Column, name: str) -> DataFrame:
    """Explode a computed array.

    An inner explode makes the optimizer add a size filter and push it down as a second copy of the whole
    array expression; the outer form with a filter on its result is evaluated once.
    """
    return df.select(*keys, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def free_tier_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Pages that offer a free tier, as a zero price."""
    return df.select(*keys, free_tier_label(F.col(text)).alias("raw")).where(F.col("raw").isNotNull()).withColumn("amount", F.lit(0.0))


def price_diff(plans: DataFrame, pages: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Declared plan prices against the prices found on the same provider's page.

    ``plans``: provider_id, plan_id, price. ``pages``: provider_id, found (sorted price array), one row per
    provider, so the price list is matched inside the row.
    """
    p = F.col("price")
    j = plans.join(pages, "provider_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<double>")))
    status = (
        F.when(p.isNull(), "UNKNOWN")
        .when((p == 0) | F.exists("found", lambda x: F.abs(x - p) <= tolerance), "MATCH")
        .when(F.size("found") == 0, "NOT_FOUND")
        .otherwise("MISMATCH")
    )
    shown = F.array_join(F.transform("found", lambda x: F.concat(F.lit("$"), number_text(x))), ", ")
    notes = (
        F.when(p.isNull(), F.lit(K.DIFF_NOTE_UNKNOWN))
        .when(p == 0, F.lit(K.DIFF_NOTE_FREE))
        .when(F.col("status") == "NOT_FOUND", F.lit(K.DIFF_NOTE_NOT_FOUND))
        .when(F.col("status") == "MISMATCH", F.concat(F.lit("JSON: $"), number_text(p), F.lit("/mo | Page found: "), shown))
    )
    return j.withColumn("status", status).withColumn("notes", notes)


def price_tolerance_match(plans: DataFrame, observed: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Same statuses when a provider's observed prices are rows of a large table instead of an array.

    Both sides are cut into tolerance-wide buckets; a plan looks into its own and the two neighbouring
    buckets, so the range condition runs as an equi-join. ``observed``: provider_id, amount.
    """
    seen = observed.where((F.col("amount") > 0) & (F.col("amount") < 10000)).distinct()
    cells = seen.withColumn("cell", F.floor(F.col("amount") / tolerance)).select("provider_id", "cell", "amount")
    priced = plans.where(F.col("price") > 0)
    probe = priced.withColumn("cell", F.explode(F.array(*[F.floor(F.col("price") / tolerance) + d for d in (-1, 0, 1)])))
    hit = (
        probe.join(cells, ["provider_id", "cell"])
        .where(F.abs(F.col("amount") - F.col("price")) <= tolerance)
        .select("plan_id")
        .distinct()
        .withColumn("hit", F.lit(True))
    )
    any_price = seen.select("provider_id").distinct().withColumn("has_prices", F.lit(True))
    p = F.col("price")
    status = (
        F.when(p.isNull(), "UNKNOWN")
        .when((p == 0) | F.col("hit"), "MATCH")
        .when(F.col("has_prices").isNull(), "NOT_FOUND")
        .otherwise("MISMATCH")
    )
    return plans.join(hit, "plan_id", "left").join(any_price, "provider_id", "left").withColumn("status", status).drop("hit", "has_prices")


def diff_summary(diffs: DataFrame) -> DataFrame:
    """Per provider: plans, matched, flagged (mismatch or not found), unknown."""
    s = F.col("status")
    return diffs.groupBy("provider_id").agg(
        F.count("*").alias("plans"), F.count_if(s == "MATCH").alias("matched"),
        F.count_if(s.isin("MISMATCH", "NOT_FOUND")).alias("flagged"), F.count_if(s == "UNKNOWN").alias("unknown"),
    )
