"""Rounding, confidence and price expressions. Pure Column functions, no session needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollgauge import constants as K


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(x: Column) -> Column:
    """Round to the nearest whole number, halves towards +infinity, in binary64."""
    return F.floor(x + F.lit(0.5)).cast("double")


def round_digits(x: Column, digits: int) -> Column:
    """``half_up`` at a decimal position: scale, round, unscale (1.005 at two digits stays 1.00)."""
    scale = F.lit(float(10**digits))
    return half_up(x * scale) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def number_text(x: Column) -> Column:
    """Shortest text of a number: whole values print without a decimal point."""
    whole = F.floor(x)
    return F.when(x == whole, whole.cast("string")).otherwise(x.cast("string"))


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Bounded literal lookup through two constant arrays; ``key`` is evaluated once."""
    keys, values = F.array(*[F.lit(k) for k in mapping]), F.array(*[F.lit(v) for v in mapping.values()])
    if not mapping:
        return F.lit(None) if default is None else default
    found = F.get(values, (F.array_position(keys, key) - 1).cast("int"))
    return found if default is None else F.coalesce(found, default)


# --- confidence ---------------------------------------------------------------


_BY_RANK = sorted(K.CONFIDENCE_RANK, key=K.CONFIDENCE_RANK.get)


def confidence_rank(c: Column) -> Column:
    """4 observed ... 0 unknown; null or unexpected text counts as unknown."""
    return lookup(K.CONFIDENCE_RANK, c, F.lit(0))


def rank_confidence(r: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in _BY_RANK]), r)


def weaker(a: Column, b: Column) -> Column:
    return rank_confidence(F.least(confidence_rank(a), confidence_rank(b)))


def at_least(conf: Column, minimum: str) -> Column:
    """Ordinal threshold."""
    return confidence_rank(conf) >= K.CONFIDENCE_RANK[minimum]


def days_old(accessed: Column, as_of: Column) -> Column:
    return F.datediff(as_of, accessed)


def is_stale(accessed: Column, as_of: Column, days: int = K.STALE_AFTER_DAYS) -> Column:
    return days_old(accessed, as_of) > days


def effective_confidence(declared: Column, accessed: Column, as_of: Column) -> Column:
    """Old sources weaken the declared confidence to stale; nothing is ever upgraded."""
    return F.when(
        is_stale(accessed, as_of) & (confidence_rank(declared) > K.CONFIDENCE_RANK["stale"]), F.lit("stale")
    ).otherwise(declared)


def stale_source(conf: Column, accessed: Column, as_of: Column) -> Column:
    """Review rule: assumed facts age out after 30 days, others after 90, unknown never."""
    limit = F.when(conf == "assumed", F.lit(30)).otherwise(F.lit(90))
    return F.coalesce((conf != "unknown") & (days_old(accessed, as_of) > limit), F.lit(False))


def confidence_label(c: Column) -> Column:
    return lookup(K.CONFIDENCE_LABEL, c)


def confidence_caveats(c: Column) -> Column:
    """Array with one sentence unless the figures were observed."""
    sentence = F.concat(F.lit(K.CAVEAT_CONFIDENCE_HEAD), c, F.lit(K.CAVEAT_CONFIDENCE_TAIL))
    return F.when(c == "observed", F.array().cast("array<string>")).otherwise(F.array(sentence))


# --- prices ---------------------------------------------------------------------


def effective_price(monthly: Column, annual: Column) -> Column:
    """Cheaper of the two billing options; ``least`` already skips nulls."""
    return F.least(monthly, annual)


def price_band(price: Column, scheme: str = "ranking") -> Column:
    """``ranking``: free/15/49 bands. ``display``: 0/30/80 bands with unknown prices shown as high."""
    if scheme == "ranking":
        return (
            F.when(price.isNull() | (price <= 0), "free")
            .when(price <= 15, "low")
            .when(price <= 49, "mid")
            .otherwise("high")
        )
    return (
        F.when(price.isNull(), "high")
        .when(price == 0, "free")
        .when(price <= 30, "low")
        .when(price <= 80, "mid")
        .otherwise("high")
    )


def band_label(band: Column) -> Column:
    return lookup(K.PRICE_BAND_LABEL, band)


def in_scope(tier: Column, monthly: Column) -> Column:
    """Paid individual or pro plan; a null price is out."""
    return F.coalesce(tier.isin(K.IN_SCOPE_TIERS) & (monthly > 0), F.lit(False))


def current_model(released: Column, as_of: Column, months: int = K.MODEL_RECENCY_MONTHS) -> Column:
    """Has a release date no older than ``months`` (month ends clamp, as ``add_months`` does)."""
    return F.coalesce(released >= F.add_months(as_of, -months), F.lit(False))


# --- display texts -----------------------------------------------------------------


def fixed_text(x: Column, digits: int) -> Column:
    """Fixed decimals of the double's exact value (1.335 is a little less than that: 1.33), exact ties away from zero.

    ``size * scale`` may round onto a tie, so the distance to it is taken from two parts whose products are exact.
    """
    scale, size = float(10**digits), F.abs(x.cast("double"))
    below, head = F.floor(size * scale).cast("double"), size.cast("float").cast("double")
    beyond = (head * scale - (below + 0.5)) + (size - head) * scale
    rounded = (below + F.when(beyond >= 0, 1.0).otherwise(0.0)) / scale
    return F.concat(F.when(x < 0, "-").otherwise(""), F.format_string(f"%.{digits}f", rounded))


def price_text(price: Column) -> Column:
    digits = F.when(price % 1 == 0, fixed_text(price, 0)).otherwise(fixed_text(price, 2))
    return (
        F.when(price.isNull(), "Contact sales").when(price == 0, "Free").otherwise(F.concat(F.lit("$"), digits, F.lit("/mo")))
    )


def catalog_price_text(price: Column) -> Column:
    return (
        F.when(price.isNull(), "Custom")
        .when(price == 0, "Free")
        .otherwise(F.concat(F.lit("$"), number_text(price), F.lit("/mo")))
    )


def price_label(price: Column) -> Column:
    """Chart label: whole dollars bare, otherwise two decimals."""
    return F.when(price.isNull(), "—").otherwise(
        F.concat(F.lit("$"), F.when(price % 1 == 0, fixed_text(price, 0)).otherwise(fixed_text(price, 2)))
    )


def token_text(n: Column) -> Column:
    size = F.abs(n)
    mega = F.concat(F.when(n % 1_000_000 == 0, fixed_text(n / 1e6, 0)).otherwise(fixed_text(n / 1e6, 2)), F.lit("M"))
    kilo = F.concat(F.when(n % 1_000 == 0, fixed_text(n / 1e3, 0)).otherwise(fixed_text(n / 1e3, 1)), F.lit("K"))
    return (
        F.when(n.isNull(), "—")
        .when(n == 0, "0")
        .when(size >= 1_000_000, mega)
        .when(size >= 1_000, kilo)
        .otherwise(number_text(n))
    )


def limit_type_text(t: Column) -> Column:
    return F.initcap(F.translate(t, "_", " "))


def limit_value_text(limit_type: Column, value: Column, unit: Column) -> Column:
    shown = F.concat_ws(" ", F.regexp_replace(F.format_number(value, 3), r"\.?0+$", ""), unit)
    return F.when((limit_type == "unknown") | value.isNull(), "—").otherwise(shown)


def short_text(t: Column, size: int = 80) -> Column:
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("…"))).otherwise(t)


def uncertainty_tier(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "elevated").when(score > 0, "low").otherwise("none")


def index_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 50, "medium").when(score.isNull(), "none").otherwise("low")


def score_band(score: Column) -> Column:
    return F.when(score >= 75, "excellent").when(score >= 55, "good").when(score >= 35, "fair").otherwise("poor")


def oldest_date(*dates: Column) -> Column:
    return F.least(*dates)
