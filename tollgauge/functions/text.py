"""Text expressions: HTML to text, hashes, name clean-up and in-row pattern scans.

Pattern classes spell out ASCII word characters and the wider white space set, so results do not
depend on a regex engine's idea of ``\\b`` and ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollgauge import constants as K
from tollgauge.functions.basics import lookup

# the Unicode white-space property (fast in this engine) without U+0085, plus the byte-order mark
SPACE = r"(?U:[\s\x{FEFF}&&[^\x{0085}]])"
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"
MARK = "\u0001"


def trim_space(t: Column) -> Column:
    return F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(t: Column) -> Column:
    """White-space runs become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(t, f"{SPACE}+", " "))


def trim_short(t: Column) -> Column:
    """``trim_space`` for hits: one that starts and ends with a visible ASCII character is trimmed already."""
    return F.when(t.rlike(r"^[!-~](?s:.*[!-~])?\z"), t).otherwise(trim_space(t))


def without_noise(html: Column) -> Column:
    """Drop script-like blocks and comments."""
    blocks = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|nav|footer)(?![A-Za-z0-9_])[^>]*>.*?</\1>", "")
    return trim_space(F.regexp_replace(blocks, r"(?s)<!--.*?-->", ""))


def readable_text(html: Column, cap: int | None = None) -> Column:
    """Tags removed, six entities decoded in a fixed order, white space squeezed; cut to ``cap`` characters only if that is asked for."""
    t = F.regexp_replace(html, r"<[^>]*>", "")
    # fixed values: entity -> text, applied in this order
    for entity, char in (
        ("&nbsp;", " "),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#x27;", "'"),
    ):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return squeeze(t) if cap is None else F.left(squeeze(t), F.lit(cap))


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def base_key(slug: Column) -> Column:
    """Slug without trailing effort words, version marks and date stamps."""
    # fixed values: effort suffixes
    words = "high|medium|low|minimal|reasoning|non-reasoning|adaptive|thinking|instant|low-effort|preview"
    return F.regexp_replace(slug, rf"(-({words}|v\d+)|-\d{{4,8}})+$", "")


def clean_name(name: Column) -> Column:
    t = F.regexp_replace(name, rf"{SPACE}*\([^)]*\){SPACE}*", " ")
    t = F.regexp_replace(t, rf"(?i){SPACE}+v\d+{WORD_END}", "")
    t = F.regexp_replace(t, rf"{SPACE}+\d{{4,8}}{WORD_END}", "")
    return trim_space(F.regexp_replace(t, rf"{SPACE}{{2,}}", " "))


def reset_window_code(word: Column) -> Column:
    return reset_code(F.lower(trim_short(word)))


def reset_code(word: Column) -> Column:
    """Code of a trimmed word in small letters."""
    return lookup(K.RESET_WORDS, word, word)


def price_per_month(amount: Column, interval: Column) -> Column:
    """Extracted price on a monthly footing; annual amounts are divided and rounded to cents."""
    yearly = F.floor(amount / 12 * 100 + F.lit(0.5)) / 100
    return F.when(amount == 0, F.lit(0.0)).when(interval == "annual", yearly).otherwise(amount)


BILLING_CONTEXT = (
    rf"(?i){WORD_START}(per{SPACE}*month|monthly|per{SPACE}*year|annually|per{SPACE}*seat|per{SPACE}*user){WORD_END}"
    rf"|(?i)(?<=[A-Za-z0-9_])(/mo|/yr){WORD_END}"
)


def pattern_confidence(kind: Column, context: Column) -> Column:
    """Confidence of a pattern hit: exact patterns gain from billing words nearby."""
    return (
        F.when(kind == "vague", "unknown")
        .when(kind == "relative", "inferred")
        .when((kind == "exact") & context.rlike(BILLING_CONTEXT), "observed")
        .when(kind == "exact", "inferred")
        .otherwise("assumed")
    )


def free_tier(text: Column) -> Column:
    return text.rlike(rf"(?i){WORD_START}free{WORD_END}") | text.rlike(r"\$0")


def free_tier_label(text: Column) -> Column:
    """'Free' when the word occurs, '$0' when only the amount does, else null."""
    return F.when(text.rlike(rf"(?i){WORD_START}free{WORD_END}"), "Free").when(text.rlike(r"\$0"), "$0")


#: Pieces of a text that one fold runs over; even, so every run starts with text before a hit.
RUN = 512


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def markable(text: Column) -> Column:
    """Text without the control character that ``pattern_hits`` marks hits with."""
    return F.replace(text, F.lit(MARK), F.lit(""))


def pattern_hits(plain: Column, pattern: str, context: int) -> Column:
    """All non-overlapping hits of ``pattern`` as array<struct<pos, raw, context>> (pos is 0-based).

    ``plain`` should be a column made with ``markable``, not a long expression: it is read once per hit.

    The text is split around marked hits, so pieces alternate text, hit, text, ...; folds over runs of
    pieces carry the offset. Everything stays inside the row: no shuffle, and only hit-sized values
    leave the row when the array is exploded.
    """

    def step(state: Column, piece: Column) -> Column:
        found = F.when(
            state["hit"],
            F.concat(state["hits"], F.array(F.struct(state["at"].alias("pos"), piece.alias("raw")))),
        ).otherwise(state["hits"])
        return F.struct((state["at"] + F.length(piece)).alias("at"), found.alias("hits"), (~state["hit"]).alias("hit"))

    def placed(pieces: Column) -> Column:
        """Offsets by runs of an even number of pieces, so no array grows with the number of hits while it is folded."""
        runs = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / RUN).cast("int"))
        run = lambda c: F.slice(pieces, c * RUN + 1, F.lit(RUN))
        lengths = F.transform(runs, lambda c: F.aggregate(run(c), F.lit(0), lambda n, p: n + F.length(p)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(
            lengths, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"]
        )
        none = F.array().cast("array<struct<pos:int,raw:string>>")
        begin = lambda at: F.struct(at.alias("at"), none.alias("hits"), F.lit(False).alias("hit"))
        many = once(starts, lambda at: F.flatten(F.transform(runs, lambda c: F.aggregate(run(c), begin(F.get(at, c)), step, lambda s: s["hits"]))))
        return F.when(F.size(pieces) <= RUN, F.aggregate(pieces, begin(F.lit(0)), step, lambda s: s["hits"])).otherwise(many)

    hits = once(F.split(F.regexp_replace(plain, pattern, f"{MARK}$0{MARK}"), MARK), placed)

    def with_context(h: Column) -> Column:
        left = F.greatest(h["pos"] - context, F.lit(0))
        width = h["pos"] - left + F.length(h["raw"]) + context
        # only ASCII and single blanks: nothing to squeeze, and the wide white-space class is slow
        around = once(F.substr(plain, left + 1, width), lambda t: F.when(t.rlike("[^ -~]|  "), squeeze(t)).otherwise(F.trim(t)))
        return F.struct(h["pos"].alias("pos"), h["raw"].alias("raw"), around.alias("context"))

    return F.when(plain.rlike(pattern), F.transform(hits, with_context)).otherwise(
        F.array().cast("array<struct<pos:int,raw:string,context:string>>")
    )
