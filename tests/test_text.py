import random
import re

import pytest
from pyspark.sql import functions as F

from tollgauge.functions import text as T
from tollgauge.operators import extract as X
from tollgauge.operators import mentions as M
from tollgauge.operators import robots as RB


def extract(spark, text):
    df = spark.createDataFrame([("t", text)], "k string, text string")
    return X.with_extractions(df, "text").collect()[0]


@pytest.mark.parametrize(
    "text,amount,interval,conf",
    [
        ("Pro is $20/mo billed", 20.0, "monthly", "observed"), ("$200 per year", 200.0, "annual", "observed"), ("only $19.99 today", 19.99, None, "inferred"),
        ("$1,000/seat/month", 1000.0, None, "inferred"), ("$5 /month monthly plan", 5.0, "monthly", "observed"),
    ],
)
def test_prices(spark, text, amount, interval, conf):
    p = extract(spark, text).prices
    assert [(x.amount, x.interval, x.confidence) for x in p] == [(amount, interval, conf)]


def test_prices_dedup_and_position(spark):
    p = extract(spark, "a $20/mo b $20/mo c $30/mo").prices
    assert [(x.pos, x.raw) for x in p] == [(2, "$20/mo"), (20, "$30/mo")]


def test_price_context_is_bounded(spark):
    text = "x" * 150 + " $20/mo " + "y" * 150
    (p,) = extract(spark, text).prices
    assert len(p.context) <= 200 and "$20/mo" in p.context


@pytest.mark.parametrize(
    "text,kind,value,unit,window,conf",
    [
        ("50 messages per day", "hard_numeric", 50.0, "messages", "1d", "observed"),
        ("1,000 requests per hour", "hard_numeric", 1000.0, "requests", "1h", "observed"),
        ("5x more usage", "relative", 5.0, None, None, "inferred"),
        ("500 credits per month", "credits", 500.0, None, "1mo", "observed"),
        ("reset every 24 hours", "time_windowed", 24.0, "hour", None, "assumed"),
        ("is throttled at peak", "rate_limit", None, None, None, "assumed"),
        ("unlimited chat", "vague", None, None, None, "unknown"),
        ("varies by model", "model_specific", None, None, None, "assumed"),
        ("usage limits apply", "vague", None, None, None, "unknown"),
    ],
)
def test_limits(spark, text, kind, value, unit, window, conf):
    (x,) = extract(spark, text).limits
    assert (x.kind, x.value, x.unit, x.reset_window, x.confidence) == (kind, value, unit, window, conf)


def test_limit_zero_is_null_and_catch_all_skips_overlap(spark):
    assert extract(spark, "0 messages per day").limits[0].value is None
    kinds = [(x.kind, x.raw) for x in extract(spark, "per-model caps; capped; capped").limits]
    assert kinds == [("model_specific", "per-model"), ("vague", "capped")]


def test_page_type_gates(spark):
    df = spark.createDataFrame([("docs", "$20/mo 50 messages per day"), ("models", "$20/mo 50 messages per day")], "kind string, text string")
    out = {r.kind: (len(r.prices), len(r.limits)) for r in X.with_extractions(df, "text", "kind").collect()}
    assert out == {"docs": (0, 1), "models": (0, 0)}


def test_footnotes(spark):
    text = "*Limited to 100 requests/day\nPrices as of May 2026. Terms apply to all. Up to 5 seats. Terms apply to all."
    assert extract(spark, text).footnotes == [
        "Limited to 100 requests/day", "Terms apply to all.", "as of May 2026.", "Limited to 100 requests/day\nPrices as of May 2026.", "Up to 5 seats.",
    ]
    assert extract(spark, "nothing").footnotes == []


def test_assumptions(spark):
    df = spark.createDataFrame([("$0 and $5/mo. 2x more usage",)], "text string")
    e = X.with_extractions(df, "text")
    (r,) = e.select(X.assumptions(F.col("text"), F.col("prices"), F.col("limits"), F.lit(3)).alias("a")).collect()
    assert r.a == [
        "2 price(s) extracted, 1 without billing interval", "1 usage limit(s) extracted, 1 require normalization", "3 model mention(s) found",
        "All prices assumed USD", "Text length: 27 chars",
    ]


def test_free_tier(one):
    assert one(T.free_tier_label(F.lit("a Free tier"))) == "Free"
    assert one(T.free_tier_label(F.lit("$0/mo"))) == "$0"
    assert one(T.free_tier_label(F.lit("carefree"))) is None


def test_page_prices_and_diff(spark):
    plans = spark.createDataFrame([(1, 1, 8.34), (1, 2, 9.0), (1, 3, 0.0), (1, 4, None), (2, 5, 9.0)], "provider_id int, plan_id int, price double")
    pages = spark.createDataFrame([(1, "$8.33 and $20, $20")], "provider_id int, text string").select("provider_id", X.page_prices(F.col("text")).alias("found"))
    want = {1: "MATCH", 2: "MISMATCH", 3: "MATCH", 4: "UNKNOWN", 5: "NOT_FOUND"}
    assert {r.plan_id: r.status for r in X.price_diff(plans, pages).collect()} == want
    observed = pages.select("provider_id", F.explode("found").alias("amount"))
    assert {r.plan_id: r.status for r in X.price_tolerance_match(plans, observed).collect()} == want
    s = {r.provider_id: (r.matched, r.flagged, r.unknown) for r in X.diff_summary(X.price_diff(plans, pages)).collect()}
    assert s == {1: (2, 1, 1), 2: (0, 1, 0)}


def claim_by_hand(text, names):
    """Straightforward claims: longest names first, each scanned left to right."""
    covered, out = set(), []
    for mid, name in sorted(names, key=lambda n: -len(n[1])):
        for m in re.finditer(rf"\b{re.escape(name)}\b", text, re.I | re.A):
            span = range(m.start(), m.end())
            if covered.isdisjoint(span):
                covered.update(span)
                out.append((mid, m.group(0), m.start()))
    return sorted(out)


def test_mentions_longest_first(spark):
    docs = spark.createDataFrame([(1, "Use GPT-4o-mini or gpt-4o, not GPT-4ox. Claude 3.5 Sonnet!")], "doc_id int, text string")
    names = spark.createDataFrame([(1, "GPT-4o", 1), (2, "GPT-4o-mini", 2), (3, "Claude 3.5 Sonnet", 3)], "model_id bigint, display_name string, ord bigint")
    out = M.mentions(docs, names, "doc_id", "text").collect()
    assert sorted((r.model_id, r.raw) for r in out) == [(1, "gpt-4o"), (2, "GPT-4o-mini"), (3, "Claude 3.5 Sonnet")]
    assert all(r.confidence == "observed" for r in out)


def test_mentions_against_brute_force(spark):
    rng = random.Random(7)
    words = ["a", "b", "ab", "a-b", "c3", "é", "x_y", "A", "B."]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", "-", ". ", ", ", ""]) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    names = [(1, "a b"), (2, "a"), (3, "a-b"), (4, "b a b"), (5, "a b a"), (6, "c3"), (7, "x_y"), (8, "B. a")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    nd = spark.createDataFrame([(m, n, m) for m, n in names], "model_id bigint, display_name string, ord bigint")
    got = {}
    for r in M.mentions(df, nd, "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append((r.model_id, r.raw, r.pos))
    for i, t in texts:
        assert sorted(got.get(i, [])) == claim_by_hand(t, names), t


def test_mention_snippet(spark):
    text = "w " * 60 + "Name" + " z" * 60
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    names = spark.createDataFrame([(1, "Name", 1)], "model_id bigint, display_name string, ord bigint")
    (r,) = M.mentions(docs, names, "doc_id", "text").collect()
    at = text.index("Name")
    assert r.pos == at and r.snippet == "…" + text[at - 60 : at + 64].strip() + "…"


ROBOTS = """# comment
User-agent: *
Disallow: /private
Allow: /private/ok  # fine
Crawl-delay: 5

User-agent: ratebot
User-agent: otherbot
Disallow: /
Allow: /pricing
Disallow:
"""


def decide(spark, content, agent, paths):
    files = spark.createDataFrame([("h.com", agent, content)], "host string, agent string, content string")
    urls = spark.createDataFrame([(f"https://h.com{p}",) for p in paths], "url string")
    out = RB.allowed(RB.url_parts(urls, "url"), RB.parse_rules(files)).collect()
    by = {r.url.removeprefix("https://h.com"): (r.allowed, r.crawl_delay) for r in out}
    return [by[p] for p in paths]


def test_robots(spark):
    assert decide(spark, ROBOTS, "somebody/1.0", ["/private/x", "/private/ok/1", "/", ""]) == [(False, 5), (True, 5), (True, 5), (True, 5)]
    assert decide(spark, ROBOTS, "RateBot/2", ["/x", "/pricing/a"]) == [(False, None), (True, None)]
    assert decide(spark, "User-agent: nobody\nDisallow: /", "me", ["/x"]) == [(True, None)]
    assert decide(spark, "User-agent: *\nDisallow: /a\nAllow: /a", "me", ["/a"]) == [(True, None)]


def test_mentions_after_letters_with_ascii_lower_forms(spark):
    docs = spark.createDataFrame([(1, "\u212a works, Alpha works"), (2, "\u0130zmir and Alpha")], "k int, text string")
    names = spark.createDataFrame([(7, "alpha", 0)], "model_id bigint, display_name string, ord bigint")
    got = {r.k: (r.raw, r.pos) for r in M.mentions(docs, names, "k", "text").collect()}
    assert got == {1: ("Alpha", 9), 2: ("Alpha", 10)}
