"""Text extraction queries over pages, documents and offer texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgauge.functions import text as T
from tollgauge.operators import extract as X
from tollgauge.operators import mentions as M
from tollgauge.operators import robots as RB
from tollgauge.queries.registry import query
from tollgauge.queries.sql_views import sql
from tollgauge.sources.views import Views

_SP = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_SP}+', ' ', 'g'), '^{_SP}+|{_SP}+$', '', 'g')"


def _readable(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for e, c in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''")):
        t = f"replace({t}, '{e}', '{c}')"
    return _squeeze(t)


def _no_noise(x: str) -> str:
    for tag in ("script", "style", "noscript", "svg", "nav", "footer"):
        x = f"regexp_replace({x}, '<{tag}\\b[^>]*>.*?</{tag}>', '', 'gis')"
    x = f"regexp_replace({x}, '<!--.*?-->', '', 'gs')"
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


@query(
    "page_clean_hash",
    f"""SELECT page_id, sha256(html) AS content_hash, {_readable("html")} AS readable, md5({_no_noise("html")}) AS quiet_md5,
        {_readable(_no_noise("html"))} AS quiet_text FROM pages""",
)
def page_clean_hash(v: Views):
    html = F.col("html")
    return v.texts("pages", "page_id", "html").select(
        "page_id", T.content_hash(html).alias("content_hash"), T.readable_text(html).alias("readable"),
        F.md5(T.without_noise(html)).alias("quiet_md5"), T.readable_text(T.without_noise(html)).alias("quiet_text"),
    )


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = ", ".join(KEYS)
_PRICE = rf"\$(\d{{1,4}}(?:,\d{{3}})*(?:\.\d{{2}})?){_SP}*(?:/|{_SP}*per{_SP}*)?{_SP}*(mo(?:nth)?|yr|year|seat|user)?"
_BILL = r"\b(per\s*month|monthly|/mo|per\s*year|annually|/yr|per\s*seat|per\s*user)\b"


@query(
    "page_prices",
    sql(
        f"""SELECT {_K}, pos, raw, amount, interval, context, CASE WHEN regexp_matches(context, '{_BILL}', 'i') THEN 'observed' ELSE 'inferred' END AS confidence,
           CASE WHEN amount = 0 THEN 0e0 WHEN interval = 'annual' THEN floor(amount / 12 * 100 + 0.5) / 100 ELSE amount END AS effective_monthly, free_label
           FROM (SELECT *, CAST(replace(regexp_extract(raw, '{_PRICE}', 1, 'i'), ',', '') AS DOUBLE) AS amount,
             CASE WHEN lower(regexp_extract(raw, '{_PRICE}', 2, 'i')) IN ('mo', 'month') THEN 'monthly'
               WHEN lower(regexp_extract(raw, '{_PRICE}', 2, 'i')) IN ('yr', 'year') THEN 'annual' END AS interval,
             instr(text, raw) - 1 AS pos,
             {_squeeze("substr(text, greatest(instr(text, raw) - 100, 1), least(instr(text, raw) - 1, 100) + length(raw) + 100)")} AS context,
             CASE WHEN regexp_matches(text, '\\bfree\\b', 'i') THEN 'Free' WHEN contains(text, '$0') THEN '$0' END AS free_label
             FROM (SELECT *, unnest(list_distinct(regexp_extract_all(text, '{_PRICE}', 0, 'i'))) AS raw FROM offer_text))""",
        "offer_text",
    ),
)
def page_prices(v: Views):
    t = v.offer_text.withColumn("plain", T.markable(F.col("text"))).withColumn("prices", X.prices(F.col("plain"))).withColumn("free_label", T.free_tier_label(F.col("text")))
    return X.price_rows(t, [*KEYS, "free_label"]).withColumn("pos", F.col("pos").cast("bigint"))


_PER = "second|min(?:ute)?|hour|day|week|month|mo|yr|year"
_LIMIT_SQL = [
    ("hard_numeric", rf"(\d{{1,6}}(?:,\d{{3}})*)\s*(messages?|requests?|calls?|queries?|tokens?|words?|documents?|pages?|seats?|users?|conversations?|\bAPI\b)\s*(?:per|/)\s*({_PER})?", 1, 2, 3),
    ("relative", r"(\d+)x?\s*(?:more|less|higher|the)\s*(usage|rate|limit|messages|tokens|requests)?", 1, 0, 0),
    ("credits", rf"(\d{{1,7}}(?:,\d{{3}})*)\s*credits?\s*(?:per|/)\s*({_PER})?", 1, 0, 2),
    ("time_windowed", r"(?:every|per|each|reset\s*(?:every|after))\s+(\d+)\s*(second|min(?:ute)?|hour|day|week|month)", 1, 2, 0),
    ("rate_limit", r"\b(rate\s*limit(?:ed)?|throttled|rate\s*limiting)\b", 0, 0, 0),
    ("vague", r"\b(unlimited|fair\s*use|fair\s*usage\s*(?:policy|limit)|acceptable\s*use)\b", 0, 0, 0),
    ("model_specific", r"\b(varies\s*(?:by|depending\s*on)|depends\s*on\s*(?:the\s*)?model|model[- ]dependent|per[- ]model)\b", 0, 0, 0),
]
_CATCH = r"\b(limited\s*usage|restricted|usage\s*limits?\s*apply|capped|usage\s*caps?)\b"


def _limit_part(keys: str, source: str, prio: int, kind: str, pattern: str, vg: int, ug: int, wg: int) -> str:
    def group(g: int) -> str:
        return f"nullif(regexp_extract(raw, '{pattern}', {g}, 'i'), '')" if g else "CAST(NULL AS VARCHAR)"

    window = group(wg)
    code = (
        f"CASE lower({window}) WHEN 'second' THEN '1s' WHEN 'min' THEN '1m' WHEN 'minute' THEN '1m' WHEN 'hour' THEN '1h' WHEN 'day' THEN '1d' "
        f"WHEN 'week' THEN '1w' WHEN 'month' THEN '1mo' WHEN 'mo' THEN '1mo' WHEN 'year' THEN '1y' WHEN 'yr' THEN '1y' END"
    )
    conf = {"hard_numeric": "observed", "credits": "observed", "relative": "inferred", "vague": "unknown"}.get(kind, "assumed")
    return f"""SELECT {keys}, {prio} AS prio, raw, '{kind}' AS kind, nullif(CAST(replace({group(vg)}, ',', '') AS DOUBLE), 0) AS value,
        {group(ug)} AS unit, {code} AS reset_window, '{conf}' AS confidence, {str(kind == "relative").lower()} AS needs_normalization, instr(text, raw) AS pos
        FROM (SELECT {keys}, text, unnest(list_distinct(regexp_extract_all(text, '{pattern}', 0, 'i'))) AS raw FROM {source})"""


def _limits_sql(keys: str, source: str) -> dict[str, str]:
    parts = [_limit_part(keys, source, i, *p) for i, p in enumerate(_LIMIT_SQL)]
    using = " AND ".join(f"s.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return {
        "structured_all": " UNION ALL ".join(parts),
        "structured": f"""SELECT * FROM structured_all QUALIFY row_number() OVER (PARTITION BY {keys}, lower(trim(raw)) ORDER BY prio, pos) = 1""",
        "caught": _limit_part(keys, source, 99, "vague", _CATCH, 0, 0, 0),
        "vague_free": f"""SELECT * FROM caught c WHERE NOT EXISTS (SELECT 1 FROM structured s WHERE {using}
            AND (lower(trim(s.raw)) = lower(trim(c.raw)) OR (c.pos < s.pos + length(s.raw) AND c.pos + length(c.raw) > s.pos)))
            QUALIFY row_number() OVER (PARTITION BY {keys}, lower(trim(raw)) ORDER BY pos) = 1""",
        "limit_hit": "SELECT * FROM structured UNION ALL SELECT * FROM vague_free",
    }


@query(
    "page_limits",
    sql(
        f"SELECT {_K}, raw, kind, value, unit, reset_window, confidence, needs_normalization, CAST(pos - 1 AS BIGINT) AS pos FROM limit_hit",
        "limit_hit", "offer_text", **_limits_sql(_K, "offer_text"),
    ),
)
def page_limits(v: Views):
    e = X.with_extractions(v.offer_text.select(*KEYS, "text"), "text")
    return X.limit_rows(e, KEYS).select(
        *KEYS, "raw", "kind", "value", "unit", "reset_window", "confidence", "needs_normalization", F.col("pos").cast("bigint").alias("pos")
    )


@query(
    "document_limits",
    sql(
        """SELECT doc_id, kind, confidence, count(*) AS hits, count(value) AS with_value FROM limit_hit GROUP BY ALL""",
        "limit_hit", **_limits_sql("doc_id", "documents"),
    ),
)
def document_limits(v: Views):
    """Limit wording found in the document corpus."""
    e = X.with_extractions(v.texts("documents", "doc_id", "text"), "text")
    return X.limit_rows(e, ["doc_id"]).groupBy("doc_id", "kind", "confidence").agg(
        F.count("*").alias("hits"), F.count("value").alias("with_value")
    )


_NOTE_PATTERNS = (
    (rf"\*{_SP}*([^\n\r\x{{2028}}\x{{2029}}]+?)(?:\n|$)", 1, ""),
    (r"(?:fine print|terms apply|subject to|restrictions apply)[^.]*\.", 0, "i"),
    (r"(?:as of|last updated|pricing effective)[^.]*\.", 0, "i"),
    (rf"(?:limited to|capped at|maximum of|up to){_SP}[^.]*\.", 0, "i"),
)
_NOTES = "list_concat(" + ", list_concat(".join(
    f"regexp_extract_all(text, '{p}', {g}, '{f}')" if f else f"regexp_extract_all(text, '{p}', {g})" for p, g, f in _NOTE_PATTERNS[:3]
) + f", regexp_extract_all(text, '{_NOTE_PATTERNS[3][0]}', 0, 'i'))))"


def _notes_sql(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, footnote FROM (SELECT {key}, regexp_replace(unnest({_NOTES}), '^{_SP}+|{_SP}+$', '', 'g') AS footnote
        FROM {table}) WHERE footnote <> ''"""


@query("doc_footnotes", _notes_sql("documents", "doc_id"))
def doc_footnotes(v: Views):
    return X.exploded(v.texts("documents", "doc_id", "text"), ["doc_id"], X.footnotes(F.col("text")), "footnote")


@query(
    "page_footnotes",
    f"""WITH readable AS (SELECT page_id, {_readable("html")} AS text FROM pages)
        SELECT page_id, count(*) AS notes, min(length(footnote)) AS shortest FROM ({_notes_sql("readable", "page_id")}) GROUP BY page_id""",
)
def page_footnotes(v: Views):
    t = v.texts("pages", "page_id", "html").select("page_id", T.readable_text(F.col("html")).alias("text"))
    notes = X.exploded(t, ["page_id"], X.footnotes(F.col("text")), "f")
    return notes.groupBy("page_id").agg(F.count("*").alias("notes"), F.min(F.length("f")).cast("bigint").alias("shortest"))


_NAMES = """SELECT item_id * 2 AS model_id, regexp_extract(text, '^[^ ]+ [^ ]+ [^ ]+') AS display_name FROM benchmark
    UNION ALL SELECT item_id * 2 + 1, regexp_extract(text, '^[A-Za-z]+') FROM benchmark"""


def names(v: Views):
    """Names to look for: the first word and the first three words of every benchmark item."""
    b = v.table("benchmark")
    long = b.select((F.col("item_id") * 2).alias("model_id"), F.regexp_extract("text", "^[^ ]+ [^ ]+ [^ ]+", 0).alias("display_name"))
    short = b.select((F.col("item_id") * 2 + 1).alias("model_id"), F.regexp_extract("text", "^[A-Za-z]+", 0).alias("display_name"))
    return long.unionByName(short).where(F.col("display_name") != "").withColumn("ord", F.col("model_id"))


@query(
    "mention_candidates",
    f"""WITH names AS ({_NAMES}) SELECT model_id, doc_id, hits FROM (SELECT model_id, doc_id,
        CAST(len(regexp_extract_all(text, '\\b' || regexp_escape(display_name) || '\\b', 0, 'i')) AS BIGINT) AS hits
        FROM documents, names WHERE display_name <> '') WHERE hits > 0""",
)
def mention_candidates(v: Views):
    """All places a name occurs between word boundaries, per document and name."""
    c = M.candidates(v.texts("documents", "doc_id", "text"), names(v), "doc_id", "text")
    return c.groupBy("model_id", "doc_id").agg(F.count("*").alias("hits"))


def placed_views(source: str, key: str) -> dict[str, str]:
    """Views up to ``place`` (every hit per name, from the pieces and matches of one split) and ``won`` (the hits that claim their characters)."""
    return {
        "named": _NAMES,
        "pair": f"""SELECT {key}, model_id, display_name, replace(text, chr(1), '') AS text, '(?i)\\b' || regexp_escape(display_name) || '\\b' AS pattern
            FROM {source}, named WHERE display_name <> '' AND contains(lower(text), lower(display_name))""",
        "split": "SELECT *, regexp_extract_all(text, pattern) AS hits, string_split_regex(text, pattern) AS pieces FROM pair",
        "place": f"""SELECT {key}, model_id, display_name, text, hits[i] AS raw, CAST(list_sum(list_transform(pieces[1:i], lambda p: length(p)))
            + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS pos FROM split, unnest(range(1, len(hits) + 1)) AS t(i)""",
        "run": f"""SELECT *, pos + length(raw) AS fin, max(pos + length(raw)) OVER (PARTITION BY {key} ORDER BY pos, pos + length(raw), model_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM place""",
        "numbered": f"""SELECT *, sum(CASE WHEN reach IS NULL OR pos >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos, fin, model_id
            ROWS UNBOUNDED PRECEDING) AS island FROM run""",
        "listed": f"""SELECT {key}, island, list([{{'m': model_id, 'pos': pos, 'fin': fin}}] ORDER BY length(display_name) DESC, model_id, pos) AS items
            FROM numbered GROUP BY {key}, island""",
        "won": f"""SELECT {key}, unnest(list_reduce(items, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: x[1].pos < k.fin AND x[1].fin > k.pos)) > 0
            THEN kept ELSE list_concat(kept, x) END)) AS w FROM listed""",
    }


@query(
    "doc_mentions",
    sql(
        f"""SELECT p.doc_id, p.model_id, p.display_name, p.raw, p.pos, CASE WHEN p.pos > 60 THEN '…' ELSE '' END
          || {_squeeze("substr(p.text, greatest(p.pos - 60, 0) + 1, least(p.pos, 60) + length(p.raw) + 60)")}
          || CASE WHEN p.pos + length(p.raw) + 60 < length(p.text) THEN '…' ELSE '' END AS snippet, 'observed' AS confidence
        FROM place p JOIN won ON won.doc_id = p.doc_id AND won.w.m = p.model_id AND won.w.pos = p.pos""",
        **placed_views("documents", "doc_id"),
    ),
)
def doc_mentions(v: Views):
    """Claimed mentions with their surroundings."""
    return M.mentions(v.texts("documents", "doc_id", "text"), names(v), "doc_id", "text").withColumn("pos", F.col("pos").cast("bigint"))


# Rule files: one per host, its rules taken from the host's own URLs (first path of each language folder).
_FILES = """SELECT host, 'User-agent: *' || chr(10) || 'Disallow: /' || any_lang || chr(10) || 'Allow: ' || longest || ' # exact page' || chr(10)
    || 'Crawl-delay: ' || n || chr(10) || chr(10) || 'User-agent: ratebot' || chr(10) || 'User-agent: other' || chr(10) || 'Disallow: ' || shortest || chr(10)
    || 'Disallow:' || chr(10) || 'Allow: /' || chr(10) AS content, n
    FROM (SELECT host, min(split_part(path, '/', 2)) AS any_lang, max(path) AS longest, min(path) AS shortest, count(*) AS n FROM url_part GROUP BY host)"""
_URL = r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/'
    ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END AS path FROM pages"""


def rule_files(parts):
    per = parts.groupBy("host").agg(
        F.min(F.split_part("path", F.lit("/"), F.lit(2))).alias("any_lang"), F.max("path").alias("longest"), F.min("path").alias("shortest"), F.count("*").alias("n")
    )
    nl = F.lit("\n")
    content = F.concat(
        F.lit("User-agent: *"), nl, F.lit("Disallow: /"), F.col("any_lang"), nl, F.lit("Allow: "), F.col("longest"), F.lit(" # exact page"), nl,
        F.lit("Crawl-delay: "), F.col("n").cast("string"), nl, nl, F.lit("User-agent: ratebot"), nl, F.lit("User-agent: other"), nl,
        F.lit("Disallow: "), F.col("shortest"), nl, F.lit("Disallow:"), nl, F.lit("Allow: /"), nl,
    )
    return per.select("host", content.alias("content"))


@query(
    "url_rules",
    f"""WITH url_part AS ({_URL}), rf AS ({_FILES}),
        g AS (SELECT host, min(split_part(path, '/', 2)) AS lang, max(path) AS longest, min(path) AS shortest, count(*) AS n FROM url_part GROUP BY host)
        SELECT 'anybot' AS agent, u.page_id, u.host, u.path, CASE WHEN starts_with(u.path, g.longest) THEN true WHEN starts_with(u.path, '/' || g.lang) THEN false
          ELSE true END AS allowed, CAST(g.n AS DOUBLE) AS crawl_delay FROM url_part u JOIN g ON g.host = u.host
        UNION ALL SELECT 'ratebot', u.page_id, u.host, u.path, NOT (starts_with(u.path, g.shortest) AND length(g.shortest) > 1), NULL FROM url_part u JOIN g ON g.host = u.host""",
)
def url_rules(v: Views):
    parts = RB.url_parts(v.table("pages").select("page_id", "url"), "url")
    files = rule_files(parts).withColumn("agent", F.explode(F.array(F.lit("anybot"), F.lit("ratebot"))))
    return RB.allowed(parts, RB.parse_rules(files)).select("agent", "page_id", "host", "path", "allowed", "crawl_delay")


# Price diff: each provider's page text is the set of offers of its plans.
@query(
    "price_tolerance_diff",
    sql(
        """SELECT p.provider_id, p.plan_id, p.price, CASE WHEN p.price IS NULL THEN 'UNKNOWN' WHEN p.price = 0 OR EXISTS (SELECT 1 FROM seen s
             WHERE s.provider_id = p.provider_id AND abs(s.amount - p.price) <= 0.1e0) THEN 'MATCH'
             WHEN NOT EXISTS (SELECT 1 FROM seen s WHERE s.provider_id = p.provider_id) THEN 'NOT_FOUND' ELSE 'MISMATCH' END AS status
           FROM (SELECT provider_id, plan_id, least(monthly_usd, annual_usd) AS price FROM plan) p""",
        "plan", "offer_text",
        seen=r"""SELECT DISTINCT p.provider_id, amount FROM (SELECT plan_id, CAST(unnest(regexp_extract_all(text, '\$(\d{1,4}(?:\.\d{2})?)', 1)) AS DOUBLE) AS amount
          FROM offer_text) o JOIN plan p ON p.plan_id = o.plan_id WHERE amount > 0 AND amount < 10000""",
    ),
)
def price_tolerance_diff(v: Views):
    plans = v.plan.select("provider_id", "plan_id", F.least("monthly_usd", "annual_usd").alias("price"))
    found = X.exploded(v.offer_text, ["plan_id"], X.page_prices(F.col("text")), "amount")
    observed = found.join(plans.select("plan_id", "provider_id"), "plan_id").select("provider_id", "amount")
    return X.price_tolerance_match(plans, observed)


@query(
    "price_diff_report",
    """WITH page AS (SELECT CAST(n_nationkey AS BIGINT) AS provider_id, list_sort(list(DISTINCT CAST(c_mktsegment_amount AS DOUBLE))) AS found FROM (
         SELECT n_nationkey, floor(abs(c_acctbal) / 100) AS c_mktsegment_amount FROM customer JOIN nation ON n_nationkey = c_nationkey)
         WHERE c_mktsegment_amount > 0 AND c_mktsegment_amount < 10000 GROUP BY n_nationkey),
       p AS (SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) % 25 AS provider_id, p_partkey AS plan_id,
         CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN 0e0 ELSE p_size * 2e0 END AS price FROM part),
       d AS (SELECT p.provider_id, CASE WHEN price IS NULL THEN 'UNKNOWN' WHEN price = 0 OR len(list_filter(found, lambda x: abs(x - price) <= 0.1e0)) > 0 THEN 'MATCH'
         WHEN found IS NULL THEN 'NOT_FOUND' ELSE 'MISMATCH' END AS status FROM p LEFT JOIN page ON page.provider_id = p.provider_id)
       SELECT provider_id, count(*) AS plans, count(*) FILTER (status = 'MATCH') AS matched, count(*) FILTER (status IN ('MISMATCH', 'NOT_FOUND')) AS flagged,
         count(*) FILTER (status = 'UNKNOWN') AS unknown FROM d GROUP BY provider_id""",
)
def price_diff_report(v: Views):
    """Diff summary where a provider's page is one text listing its customers' balances as prices."""
    c, n = v.table("customer"), v.table("nation")
    amounts = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("n_nationkey").cast("bigint").alias("provider_id"), F.floor(F.abs("c_acctbal") / 100).alias("a")
    ).distinct()
    listed = amounts.where((F.col("a") > 0) & (F.col("a") < 10000))
    pages = listed.groupBy("provider_id").agg(F.array_sort(F.collect_set(F.col("a").cast("double"))).alias("found"))
    diffs = X.price_diff(v.plan.select("provider_id", "plan_id", F.col("monthly_usd").alias("price")), pages)
    return X.diff_summary(diffs)
