import datetime as dt

import pytest
from pyspark.sql import functions as F

from tollgauge.functions import basics as B
from tollgauge.functions import capacity as C
from tollgauge.functions import text as T

def now():
    return F.lit("2026-06-23").cast("date")


def num(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize("x,want", [(-2.5, -2), (2.5, 3), (1.4999, 1), (0.0, 0)])
def test_half_up(one, x, want):
    assert one(B.half_up(num(x))) == want


def test_round_digits_keeps_binary_value(one):
    assert one(B.round_digits(num(1.005), 2)) == 1.0


@pytest.mark.parametrize("p,want", [(15.0, "low"), (15.01, "mid"), (49.0, "mid"), (49.01, "high"), (0.0, "free"), (None, "free")])
def test_price_band(one, p, want):
    assert one(B.price_band(num(p))) == want


@pytest.mark.parametrize("p,want", [(None, "high"), (0.0, "free"), (30.0, "low"), (80.0, "mid"), (80.5, "high")])
def test_display_band(one, p, want):
    assert one(B.price_band(num(p), "display")) == want


def test_effective_price(one):
    assert one(B.effective_price(num(20), num(16))) == 16
    assert one(B.effective_price(num(None), num(16))) == 16
    assert one(B.effective_price(num(None), num(None))) is None


def test_scope_and_recency(one):
    assert one(B.in_scope(F.lit("pro"), num(20))) is True
    assert one(B.in_scope(F.lit("pro"), num(None))) is False
    assert one(B.in_scope(F.lit("team"), num(20))) is False
    assert one(B.current_model(F.lit("2025-12-23").cast("date"), now())) is True
    assert one(B.current_model(F.lit("2025-12-22").cast("date"), now())) is False
    assert one(B.current_model(F.lit(None).cast("date"), now())) is False


@pytest.mark.parametrize(
    "conf,day,want",
    [("observed", "2026-06-01", "observed"), ("observed", "2026-01-01", "stale"), ("unknown", "2026-01-01", "unknown"), ("stale", "2026-06-20", "stale")],
)
def test_effective_confidence(one, conf, day, want):
    assert one(B.effective_confidence(F.lit(conf), F.lit(day).cast("date"), now())) == want


def test_weaker(one):
    assert one(B.weaker(F.lit("observed"), F.lit("assumed"))) == "assumed"
    assert one(B.at_least(F.lit("stale"), "assumed")) is False


@pytest.mark.parametrize(
    "a,c,s,want",
    [(70, 80, 60, 73.0), (None, 80, 60, 76.0), (70, None, 60, 68.3), (None, None, 60, None), (70, 80, None, 72.0), (0, 80, 60, 38.0)],
)
def test_model_quality(one, a, c, s, want):
    assert one(C.model_quality(num(a), num(c), num(s))) == want


def test_quality_confidence_and_notes(one):
    assert one(C.quality_confidence(num(None), num(80), F.lit("observed"))) == "inferred"
    assert one(C.quality_confidence(num(None), num(80), F.lit("stale"))) == "stale"
    assert one(C.quality_confidence(num(70), num(80), F.lit("observed"))) == "observed"
    assert len(one(C.quality_notes(num(70), num(80), num(None)))) == 1
    assert one(C.quality_notes(num(70), num(80), num(1))) == []


def test_value_score(one):
    assert one(C.value_score(num(800000), num(20), num(1.0))) == 100
    assert one(C.value_score(num(800000), num(0), num(1.0))) is None
    assert one(C.value_score(num(None), num(20), num(1.0))) is None
    assert one(C.value_score(num(400000), num(20), num(1.0))) == 50


@pytest.mark.parametrize("cost,ref,want", [(1.0, 1.0, 1.0), (0.1, 1.0, 1.15), (1e9, 1.0, 0.85), (None, 1.0, 1.0), (1.0, None, 1.0), (0.0, 1.0, 1.0)])
def test_efficiency(one, cost, ref, want):
    assert one(C.efficiency_multiplier(num(cost), num(ref))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    "v,f,t,want,conf",
    [
        (1000, "1d", "24h", 1000, "observed"), (100, "1d", "1w", 700, "assumed"), (100, "1d", "1mo", 3042, "assumed"), (1000, "1mo", "5h", 7, "unknown"),
        (100, "1h", "5h", 500, "inferred"), (10, "1h", "1mo", 7300, "unknown"), (0, "1d", "1w", 0, "inferred"), (100, "1w", "1mo", 435, "inferred"),
    ],
)
def test_windows(one, v, f, t, want, conf):
    assert one(C.convert_window(num(v), F.lit(f), F.lit(t))) == want
    assert one(C.window_confidence(num(v), F.lit(f), F.lit(t))) == conf


def test_window_skip(one):
    assert one(C.window_too_far(F.lit("1h"), F.lit("1y"))) is True
    assert one(C.window_too_far(F.lit("1h"), F.lit("1mo"))) is False


def test_scores(one):
    assert one(C.cost_score(num(None))) == 50
    assert one(C.cost_score(num(0))) == 100
    assert one(C.cost_score(num(20))) == 82
    assert one(C.cost_score(num(5))) == 112
    assert one(C.cost_score(num(100000))) == 10
    assert one(C.speed_score(num(150))) == 50
    assert one(C.speed_score(num(900))) == 100
    assert one(C.uncertainty(F.lit("observed"), F.lit("stale"), F.lit("unknown"))) == 35


def test_cost_adjusted(one):
    month = C.cost_adjusted_month(F.lit("credits"), num(1000), num(1), num(1))
    assert one(month) == 10_000_000
    assert one(C.cost_adjusted_month(F.lit("tokens"), num(1000), num(1), num(1))) is None
    assert one(C.cost_adjusted_month(F.lit("credits"), num(1000), num(0), num(0))) is None


def test_texts(one):
    assert [one(B.price_text(num(p))) for p in (None, 0, 20, 19.5)] == ["Contact sales", "Free", "$20/mo", "$19.50/mo"]
    assert [one(B.token_text(num(n))) for n in (None, 0, 1_250_000, 2_000_000, 2_500, 3_000, 12)] == ["—", "0", "1.25M", "2M", "2.5K", "3K", "12"]
    assert one(B.limit_type_text(F.lit("usd_credits_per_month"))) == "Usd Credits Per Month"
    assert one(B.limit_value_text(F.lit("x"), num(1000), F.lit("messages"))) == "1,000 messages"
    assert one(B.short_text(F.lit("a" * 81))) == "a" * 80 + "…"
    assert one(B.oldest_date(F.lit(dt.date(2026, 1, 2)), F.lit(None).cast("date"), F.lit(dt.date(2026, 1, 1)))) == dt.date(2026, 1, 1)


@pytest.mark.parametrize(
    "slug,want", [("gpt-5-high", "gpt-5"), ("grok-4-0309-non-reasoning", "grok-4"), ("a-v2-20240501-low-effort", "a"), ("gpt-5-mini", "gpt-5-mini")]
)
def test_base_key(one, slug, want):
    assert one(T.base_key(F.lit(slug))) == want


def test_clean_name(one):
    assert one(T.clean_name(F.lit("Grok 4.20 0309 v2 (Reasoning)"))) == "Grok 4.20"


def test_html(one):
    html = "<style>x</style><p>A&nbsp;&amp;lt; B</p><!-- c --><SCRIPT>1</SCRIPT><nav><a>n</a></nav>\n\n T U "
    assert one(T.readable_text(T.without_noise(F.lit(html)))) == "A < B T U"
    assert one(T.readable_text(F.lit("abcdef"), 3)) == "abc"
    assert len(one(T.content_hash(F.lit("x")))) == 64


def test_reset_words(one):
    assert [one(T.reset_window_code(F.lit(w))) for w in ("Hour", "mo", "min", "5h")] == ["1h", "1mo", "1m", "5h"]


def test_extracted_price_per_month(one):
    assert one(T.price_per_month(num(200), F.lit("annual"))) == 16.67
    assert one(T.price_per_month(num(0), F.lit(None).cast("string"))) == 0
    assert one(T.price_per_month(num(19.99), F.lit(None).cast("string"))) == 19.99


def test_token_text_rounds_exact_values(spark):
    from tollgauge.functions import basics

    cases = {1_335_000.0: "1.33M", 1_125_000.0: "1.13M", 2_675_000.0: "2.67M", 1_005_000.0: "1.00M", 1_250.0: "1.3K", 1_000.0: "1K", 7_000_000.0: "7M"}
    rows = spark.createDataFrame([(k,) for k in cases], "n double")
    assert {r.n: r.t for r in rows.select("n", basics.token_text(rows.n).alias("t")).collect()} == cases
