"""PII: detected entities get keyed surrogates of the same type and form.

Detection is one regular expression over the whole text: e-mail and IPv4 addresses, IBANs, secrets, card and phone numbers, social
security numbers, and names after a title. A document's name words found so are then looked for in the rest of that document, as whole words
with a capital. Mentions of one entity share a canonical form (digits of a number, lower case of an address, a
name's token), so they stay one entity however they are written. An entity's surrogate is drawn from a keyed hash: digits for digits, letters for
letters in the same case, separators as they are; a card keeps its check sum's remainder, a phone its country code, an address its top-level
domain, a given name the gender that the title tells, a name its script (Latin, Cyrillic, Greek; others get Latin).

Distinct entities are gathered over all texts. A draw that equals any real entity of its type or another entity's surrogate is drawn again, so
surrogates are distinct and never name someone who is in the data. Only mentions are shuffled and joined, and the texts that have some.

Only DataFrame functions run here. Defined cases: null and empty texts stay as they are; repeated rows get equal results; other columns are
carried along, ``text`` is replaced. Names get one more syllable every ``ROUNDS`` draws, so their surrogates never run out. Where a form
(separators, kept digits, which places are digits or letters) has under four values per real one, no draws are made: the form's unreal values
are dealt in keyed order, and when they run out, the real values of other entities, so everyone is placed and only a form with a single value
stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgauge.llm.outliers import let
from tollgauge.llm.tables import row_key, stored
from tollgauge.operators.ordering import global_rank

KEY_SETTING, PUBLIC_KEY = "spark.tollgauge.surrogateKey", "surrogates"
#: Draws of a name before its surrogates get one more syllable.
ROUNDS = 4
# Titles that tell a gender or none, and patterns.
MALE = "Mr|Herr|Herrn|Monsieur|Sr|Señor|господин|г-н|κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Sra|Srta|Señora|госпожа|г-жа|κυρία"
NEUTRAL = "Dr|Prof"
TITLE = rf"(?:{MALE}|{FEMALE}|{NEUTRAL})"
NAME = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = (
    # a run of local characters is tried once, from its start or from the end of the last hit; labels are bounded as in host names
    r"(?:(?<![\w.+%-])|\G)[\w.+%-]++(?<=\w)@\w[\w-]*+(?:\.[\w-]++){0,126}\.\p{L}{2,}",
    r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|[0-9a-f]{32,}|[0-9A-F]{32,})\b",
    r"(?<=\b(?:token|secret|key|password|passwd|pwd)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_+/.=-]{8,}",
    # 13 to 19 digits in any groups of three and more, four and more in the first, any in the last; then the usual groups before more numbers
    r"(?<![\w+.-])\d{4}(?:(?:[ -](?=\d{3}|\d{1,2}(?![\w-]| \d)))?\d){9,15}(?![\w-])",
    r"(?<![\w+.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\w-])",
    r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)",
    r"(?<![\w.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)",
    r"(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])",
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    rf"(?<![\p{{L}}]){TITLE}\.?[ ]{NAME}(?:[ ]{NAME})?",
)
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS)
TITLED = rf"(?<![\p{{L}}]){TITLE}\.?[ ]\p{{Lu}}"
#: Every pattern needs one of these, so most texts are passed over quickly.
HINT = rf"[0-9@]|{TITLED}|AKIA|gh[pousr]_|sk-|xox|(?:token|secret|key|password|passwd|pwd)\s{{0,2}}[=:]"
LETTERS, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
SYLLABLES = {
    "latin": "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ве ви во".split(),
    "greek": "βα βε βι βο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το πα πε πι πο".split(),
}
#: A name's words: parts of a double name are words of their own, and a possessive ending is none.
CUTS = r"(?<=-)|(?=-)|(?=['’][sS]?$)"
ENDINGS = {"latin": {"m": "n", "f": "na", "n": "l", "s": "r"}, "cyrillic": {"m": "н", "f": "на", "n": "л", "s": "р"}, "greek": {"m": "ς", "f": "να", "n": "λ", "s": "ρ"}}


def kind_of(hit: Column) -> Column:
    """Type of a match, from its form."""
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    return (
        F.when(hit.contains("@"), "email").when(hit.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip").when(hit.rlike(rf"^{TITLE}\.?[ ]\p{{Lu}}"), "person")
        .when(hit.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(hit.rlike(r"^[+(]|^\d{3}[-.]\d{3}[-.]\d{4}$"), "phone").when(hit.rlike(r"^[0-9 -]+$") & digits.between(13, 19), "card")
        .when(hit.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), "iban").otherwise("secret")
    )


def parts_of(hit: Column) -> Column:
    """A mention as parts (kind, canon, form): names fall into title, given name and surname; parts without a kind stay."""
    part = lambda kind, canon, form: F.struct(kind.alias("kind"), canon.alias("canon"), form.alias("form"))
    none, kind = F.lit(None).cast("string"), kind_of(hit)
    token = F.split(hit, "[ ]")
    script = lambda t: F.when(t.rlike(r"\p{IsCyrillic}"), "cyrillic").when(t.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    title = F.regexp_replace(F.get(token, 0), r"\.$", "")
    gender = F.when(title.rlike(f"^(?:{MALE})$"), "m").when(title.rlike(f"^(?:{FEMALE})$"), "f").otherwise("n")
    given, last = F.get(token, 1), F.element_at(token, -1)
    keep = lambda text: part(none, none, text)
    word = lambda role, t: F.when(t.rlike(r"^\p{L}"), part(F.concat(F.lit("name:"), script(t), F.lit(":"), role), F.lower(t), t)).otherwise(keep(t))
    name = lambda role, t: F.transform(F.split(t, CUTS), lambda x: word(role, x))
    space = keep(F.lit(" "))
    person = F.when(F.size(token) == 3, F.concat(F.array(keep(F.get(token, 0)), space), name(gender, given), F.array(space), name(F.lit("s"), last))).otherwise(F.concat(F.array(keep(F.get(token, 0)), space), name(F.lit("s"), last)))
    canon = F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(hit, "[^0-9]", "")).when(kind == "iban", F.replace(hit, F.lit(" "), F.lit(""))).when(kind == "email", F.lower(hit)).otherwise(hit)
    # a plus tells where a country code stands, so it is part of the type
    named = F.when((kind == "phone") & hit.startswith("+"), "phone+").otherwise(kind)
    return F.when(kind == "person", person).otherwise(F.array(part(named, canon, hit)))


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """256 keyed hexadecimal characters for an entity and attempt."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"), F.lit(str(b))), 256) for b in range(4)])


def _at(stream: Column, j: Column, among: int) -> Column:
    return F.conv(F.substr(stream, (j * 2) % 256 + 1, F.lit(2)), 16, 10).cast("int") % among


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n + 1, F.lit(1))


def _same_form(canon: Column, stream: Column) -> Column:
    """Digits for digits and letters for letters; hexadecimal strings stay hexadecimal."""
    hexed, upper = canon.rlike("^(?=[0-9]*[a-f])[0-9a-f]{32,}$"), canon.rlike("^(?=[0-9]*[A-F])[0-9A-F]{32,}$")
    char = lambda c, j, own: (
        F.when(own["hexed"], _pick(HEX, _at(stream, j, 16))).when(own["upper"], _pick(HEX.upper(), _at(stream, j, 16))).when(c.rlike("[0-9]"), _pick(DIGITS, _at(stream, j, 10)))
        .when(c.rlike(r"\p{Lu}"), _pick(LETTERS.upper(), _at(stream, j, 26))).when(c.rlike(r"\p{L}"), _pick(LETTERS, _at(stream, j, 26))).otherwise(c)
    )
    # the form is looked at once, not for every character
    return let(F.struct(hexed.alias("hexed"), upper.alias("upper")), lambda own: F.array_join(F.transform(F.split(canon, ""), lambda c, j: char(c, j, own)), ""))


def _check_sum(digits: Column) -> Column:
    """Luhn sum modulo 10."""
    n = F.length(digits)
    value = lambda c, j: let(c.cast("int") * F.when((n - j) % 2 == 0, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, v: a + v) % 10


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """An entity's surrogate in canonical form."""
    stream = _stream(key, kind, canon, attempt)

    def build(s: Column) -> Column:
        form = _same_form(canon, s)
        # a card's last digit makes the check sum's remainder that of the original
        body = F.concat(F.substr(form, F.lit(1), F.length(form) - 1), F.lit("0"))
        card = let(body, lambda b: F.concat(F.substr(b, F.lit(1), F.length(b) - 1), F.pmod(_check_sum(canon) - _check_sum(b), F.lit(10)).cast("string")))
        code = F.when(canon.rlike("^[17]"), 1).otherwise(2)
        phone = F.concat(F.substr(canon, F.lit(1), code), F.substr(form, code + 1, F.length(form)))
        ip = F.concat_ws(".", *[(_at(s, F.lit(j), 222 if j == 0 else 254) + 1).cast("string") for j in range(4)])
        top = F.regexp_extract(canon, r"(\.\p{L}{2,})$", 1)
        email = F.concat(F.substr(form, F.lit(1), F.length(form) - F.length(top)), top)
        iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.substr(form, F.lit(3), F.length(form)))
        out = F.when(kind == "card", card).when(kind == "phone+", phone).when(kind == "ip", ip).when(kind == "email", email).when(kind == "iban", iban)
        for script, syllables in SYLLABLES.items():
            part = lambda j: F.element_at(F.array(*map(F.lit, syllables)), _at(s, j, len(syllables)) + 1)  # noqa: B023, E731
            for role, end in ENDINGS[script].items():
                last = F.floor(attempt / ROUNDS).cast("int") + (3 if role == "s" else 2)
                out = out.when(kind == f"name:{script}:{role}", F.concat(F.array_join(F.transform(F.sequence(F.lit(0), last), part), ""), F.lit(end)))
        return out.otherwise(form)

    return let(stream, build)


def written(kind: Column, form: Column, own: Column) -> Column:
    """A surrogate in the way a mention is written: its separators and its case."""
    digits = F.split(own, "")
    seen = lambda c, j: F.length(F.regexp_replace(F.substr(form, F.lit(1), j + 1), "[^0-9A-Z]", ""))
    dealt = F.array_join(F.transform(F.split(form, ""), lambda c, j: F.when(c.rlike("[0-9A-Z]"), F.get(digits, seen(c, j) - 1)).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(form, ""), lambda c, j: F.when(c.rlike(r"\p{Lu}"), F.upper(F.get(digits, j))).otherwise(F.get(digits, j))), "")
    name = F.when(form == F.upper(form), F.upper(own)).when(form == F.lower(form), own).otherwise(F.initcap(own))
    return F.when(kind.isin("card", "phone", "phone+", "ssn", "iban"), dealt).when(kind == "email", cased).when(kind.startswith("name:"), name).otherwise(own)


FORM = ["kind", "head", "mask", "tail"]


def forms_of(entities: DataFrame) -> DataFrame:
    """``entities`` with their form and how many values it has: ``head`` and ``tail`` are kept, ``mask`` has 0, a and A for what is drawn. A card's tail is its check sum."""
    kind, canon = F.col("kind"), F.col("canon")
    top = F.regexp_extract(canon, r"(\.\p{L}{2,})$", 1)
    n_head = F.when(kind == "iban", 2).when(kind == "phone+", F.when(canon.rlike("^[17]"), 1).otherwise(2)).otherwise(0)
    n_tail = F.when(kind == "email", F.length(top)).when(kind == "card", 1).otherwise(0)
    body = F.substr(canon, n_head + 1, F.length(canon) - n_head - n_tail)
    mask = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[0-9]", "0"), r"\p{Lu}", "A"), r"(?!A)\p{L}", "a")
    tail = F.when(kind == "email", top).when(kind == "card", _check_sum(canon).cast("string")).otherwise("")
    count = lambda c: F.length(F.regexp_replace("mask", f"[^{c}]", ""))
    # addresses and long hexadecimal strings have more values than any input, names grow
    drawn = kind.isin("card", "phone", "phone+", "ssn", "iban", "email") | (kind == "secret") & ~canon.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")
    return entities.where(drawn).select("kind", "canon", F.substr(canon, F.lit(1), n_head).alias("head"), mask.alias("mask"), tail.alias("tail")).withColumn("values", F.pow(F.lit(10.0), count("0")) * F.pow(F.lit(26.0), count("aA")))


def _value(i: Column) -> Column:
    """Value number ``i`` of a form."""
    digit = lambda rest, base: F.pmod(rest, F.lit(base)).cast("int")
    step = lambda base, pick: lambda s, c: F.struct(F.floor(s["rest"] / base).cast("long").alias("rest"), F.concat(pick(s, c), s["out"]).alias("out"))
    ten, letters = step(10, lambda s, c: _pick(DIGITS, digit(s["rest"], 10))), step(26, lambda s, c: _pick(LETTERS, digit(s["rest"], 26)))
    upper = step(26, lambda s, c: _pick(LETTERS.upper(), digit(s["rest"], 26)))
    by = lambda s, c: F.when(c == "0", ten(s, c)).when(c == "a", letters(s, c)).otherwise(upper(s, c))
    # only the drawn places are counted through; what stands between them is put around the result
    drawn = F.regexp_extract_all(F.col("mask"), F.lit("[0aA]"), F.lit(0))
    values = F.split(F.aggregate(F.reverse(drawn), F.struct(i.cast("long").alias("rest"), F.lit("").alias("out")), by, lambda s: s["out"]), "")
    dealt = F.when(F.size(drawn) > 0, values).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.zip_with(F.split("mask", "[0aA]", -1), dealt, lambda fixed, v: F.concat(fixed, F.coalesce(v, F.lit("")))), "")
    whole = F.concat("head", body)
    card = F.concat(whole, F.pmod(F.col("tail").try_cast("int") - _check_sum(F.concat(whole, F.lit("0"))), F.lit(10)).cast("string"))
    return F.when(F.col("kind") == "card", card).otherwise(F.concat(whole, "tail"))


def deal(narrow: DataFrame, key: str) -> DataFrame:
    """(kind, canon, own) for the entities of narrow forms (their form, values and n real values): keyed order of unreal values, then of real ones."""
    order = lambda c: F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", c), 256)
    chunk = 1000
    forms = narrow.select(*FORM, F.col("values").cast("long").alias("values"), "n").distinct()
    each = forms.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("values") - 1) / chunk))))
    each = each.withColumn("i", F.explode(F.sequence(F.col("c") * chunk, F.least((F.col("c") + 1) * chunk, F.col("values")) - 1)))
    real = narrow.select("kind", F.col("canon").alias("own"), F.lit(1).alias("real"))
    values = each.select(*FORM, "n", _value(F.col("i")).alias("own")).join(real, ["kind", "own"], "left").withColumn("real", F.coalesce("real", F.lit(0)))
    ranked = stored(global_rank(values.withColumn("o", order("own")), [*map(F.col, FORM), F.col("real"), F.col("o"), F.col("own")]))
    first = ranked.groupBy(*FORM).agg(F.min("rank").alias("first"), F.count_if(F.col("real") == 0).alias("free"))
    placed = stored(ranked.join(first, FORM).withColumn("at", F.col("rank") - F.col("first")))
    # an entity's number is that of its own value among the real ones, so number i never meets itself: real values follow the unreal ones
    number = F.col("at") - F.col("free")
    entity = placed.where("real = 1").select(*FORM, F.col("own").alias("canon"), number.alias("i"), F.when(F.col("free") > 0, number).otherwise((number + 1) % F.col("n")).alias("at"))
    return entity.join(placed.select(*FORM, "at", "own"), [*FORM, "at"]).select("kind", "canon", "own")


def draw(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, own) for distinct entities (kind, canon): keyed draws, repeated where they are taken; narrow forms are dealt."""
    real = entities.select("kind", F.col("canon").alias("own"))
    form = forms_of(entities)
    sizes = stored(form.groupBy(*FORM, "values").agg(F.count("*").alias("n")).where(F.col("values") < F.col("n") * 4).drop("values"))
    done = None if sizes.isEmpty() else stored(deal(stored(form.join(sizes, FORM)), key))
    waiting = (entities if done is None else entities.join(done.select("kind", "canon"), ["kind", "canon"], "left_anti")).withColumn("attempt", F.lit(0))
    while True:
        drawn = waiting.withColumn("own", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        taken = real if done is None else real.unionByName(done.select("kind", "own"))
        free = drawn.join(taken.withColumn("taken", F.lit(True)).distinct(), ["kind", "own"], "left")
        first = F.row_number().over(Window.partitionBy("kind", "own").orderBy("canon"))
        judged = stored(free.withColumn("good", F.col("taken").isNull() & (first == 1)))
        good = judged.where("good").select("kind", "canon", "own")
        done = good if done is None else stored(done.unionByName(good))
        waiting = judged.where("NOT good").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return done


def name_words(hits: Column) -> Column:
    """Pattern of the name words among a document's hits, as whole words with a capital; null where there are none."""
    forms = F.flatten(F.transform(F.filter(hits, lambda h: kind_of(h) == "person"), lambda h: F.filter(parts_of(h), lambda p: p["kind"].isNotNull() & (F.length(p["form"]) > 1))["form"]))
    return let(F.array_distinct(forms), lambda x: F.when(F.size(x) > 0, F.concat(F.lit(r"(?<!\p{L})(?=\p{Lu})(?iu:"), F.array_join(x, "|"), F.lit(r")(?!\p{L})"))))


def _hit(text: Column, again: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(again).alias("again"))


def hits_of(text: Column) -> Column:
    """A text's hits (text, again) in order; ``again`` marks name words found outside the patterns."""
    plain = lambda hits: F.transform(hits, lambda h: _hit(h, False))
    none = F.array().cast("array<struct<text:string,again:boolean>>")
    inner = lambda hits, words: F.flatten(F.zip_with(F.split(text, PATTERN, -1), hits, lambda g, h: F.concat(F.transform(F.regexp_extract_all(g, words, F.lit(0)), lambda x: _hit(x, True)), F.when(h.isNull(), none).otherwise(F.array(_hit(h, False))))))
    named = lambda hits: let(name_words(hits), lambda words: F.when(words.isNull(), plain(hits)).otherwise(inner(hits, words)))
    return let(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda hits: F.when(F.exists(hits, lambda h: h.rlike(TITLED)), named(hits)).otherwise(plain(hits)))


def gaps_of(text: Column) -> Column:
    """What stands around the hits of a text."""
    gaps = F.split(text, PATTERN, -1)
    inner = let(name_words(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))), lambda words: F.when(words.isNull(), gaps).otherwise(F.flatten(F.transform(gaps, lambda g: F.split(g, words, -1)))))
    return F.when(text.rlike(TITLED), inner).otherwise(gaps)


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced, and n_entities (mentions replaced).

    The key is the session's ``spark.tollgauge.surrogateKey`` unless one is given; the public stand-in without both protects nobody.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, PUBLIC_KEY)
    names = [c for c in docs.columns if c != "n_entities"]
    has = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    own = row_key("doc_id", "text")
    found = stored(docs.where(has).select(own.alias("k"), hits_of(F.col("text")).alias("hits")).where(F.size("hits") > 0).dropDuplicates(["k"]))
    mention = found.select("k", F.posexplode("hits").alias("pos", "hit")).select("k", "pos", "hit.*")
    part = mention.where("NOT again").select("k", "pos", F.posexplode(parts_of(F.col("text"))).alias("part", "p")).select("k", "pos", "part", "p.*")
    # a name word is one person's in its whole document: a gender told anywhere there counts, else a given name, else its first place
    told = F.when(F.col("kind").rlike(":[mf]$"), 0).when(F.col("kind").endswith(":n"), 1).otherwise(2)
    called = part.where("kind LIKE 'name:%'").groupBy("k", "canon").agg(F.min(F.struct(told.alias("told"), "pos", "part", "kind")).alias("first")).select("k", "canon", F.col("first.kind").alias("called"))
    part = part.join(called, ["k", "canon"], "left").select("k", "pos", "part", F.coalesce("called", "kind").alias("kind"), "canon", "form")
    again = mention.where("again").select("k", "pos", F.lit(0).alias("part"), F.lower("text").alias("canon"), F.col("text").alias("form")).join(called.withColumnRenamed("called", "kind"), ["k", "canon"], "left")
    part = stored(part.unionByName(again))
    entities = draw(stored(part.where("kind IS NOT NULL").select("kind", "canon").distinct()), key)
    fixed = part.where("kind IS NULL").select("k", "pos", "part", F.col("form").alias("text"))
    named = part.where("kind IS NOT NULL").join(entities, ["kind", "canon"]).select("k", "pos", "part", written(F.col("kind"), F.col("form"), F.col("own")).alias("text"))
    whole = named.unionByName(fixed).groupBy("k", "pos").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("parts")).select("k", "pos", F.array_join("parts.text", "").alias("new"))
    lists = whole.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("news")).select(F.col("k").alias("k_"), F.col("news.new").alias("news_"))
    joined = docs.select(*names).where(has).join(lists, own == F.col("k_"), "left")
    text = F.array_join(F.zip_with(gaps_of(F.col("text")), "news_", lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    changed = joined.withColumn("n_entities", F.coalesce(F.size("news_"), F.lit(0))).withColumn("text", F.when(F.col("news_").isNull(), F.col("text")).otherwise(text))
    return changed.select(*names, "n_entities").unionByName(docs.select(*names).where(~has).withColumn("n_entities", F.lit(0)))


def op7_pii_surrogates(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_entities) with surrogates in place of entities."""
    return replace_entities(docs.select("doc_id", "text"))
