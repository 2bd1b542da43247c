import pytest

from tollgauge.constants import NormalizationConfig
from tollgauge.operators import normalize as N

SCHEMA = "plan_id string, model_id string, limit_type string, limit_value double, limit_unit string, reset_window string, ord int"


def norm(spark, row, **cfg):
    df = spark.createDataFrame([(*row, 0)], SCHEMA)
    return N.normalize_limits(df, NormalizationConfig(**cfg)).collect()[0]


@pytest.mark.parametrize(
    "value,unit,kind,window,tokens,conf,layer",
    [
        (200000.0, "tokens", "rate", "1mo", 200000, "observed", "direct_tokens"),
        (50.0, "messages", "rate", "1d", 2000000, "inferred", "messages"),
        (500.0, "Messages", "rate", "1mo", 1000000, "inferred", "messages"),
        (10.0, "messages", "rate", "1h", 8000000, "inferred", "messages"),
        (100.0, "requests", "rate", "1w", 2000000, "inferred", "requests"),
        (500.0, "credits", "credits_per_month", "1mo", 250000, "assumed", "credits"),
        (1000.0, "compute_units", "compute_units_per_month", "1mo", 1000000, "assumed", "compute_units"),
        (60.0, None, "usd_credits_per_month", None, 3000000, "inferred", "usd_credits"),
        (10.0, "seats", "rate", "1d", 50000, "assumed", "time_window"),
        (None, None, "fair_use", None, None, "unknown", "unknown"),
        (10.0, "seats", "rate", "1m", None, "unknown", "unknown"),
        (0.0, "tokens", "rate", "1mo", 0, "inferred", "direct_tokens"),
    ],
)
def test_layers(spark, value, unit, kind, window, tokens, conf, layer):
    r = norm(spark, ("p", None, kind, value, unit, window))
    assert (r.tokens_1mo, r.confidence, r.layer) == (tokens, conf, layer)


def test_model_multiplier(spark):
    r = norm(spark, ("p", "m-1", "rate", 100000.0, "tokens", "1mo"), model_multipliers={"m-1": 2.5})
    assert r.tokens_1mo == 250000
    r = norm(spark, ("p", "fam-x", "rate", 100.0, "tokens", "1mo"), model_multipliers={"fam-other": 3.0})
    assert r.tokens_1mo == 300


def test_credit_prefix(spark):
    r = norm(spark, ("openai-pro", None, "credits_per_month", 500.0, None, None), credit_mappings={"openai": 1000.0})
    assert (r.tokens_1mo, r.confidence) == (500000, "inferred")


def test_ranges(spark):
    r = norm(spark, ("p", None, "rate", 500.0, "messages", "1mo"))
    assert (r.low_1mo, r.high_1mo) == (500000, 2500000)
    r = norm(spark, ("p", None, "usd_credits_per_month", 60.0, None, None))
    assert (r.low_1mo, r.high_1mo) == (800000, 6000000)
    r = norm(spark, ("p", None, "rate", 0.0, "messages", "1mo"))
    assert (r.low_1mo, r.high_1mo) == (None, None)


def test_windows_of_month(spark):
    r = norm(spark, ("p", None, "rate", 1000000.0, "tokens", None))
    assert (r.tokens_5h, r.tokens_24h, r.tokens_1w) == (6849, 32877, 230137)


def test_document_adapter(spark):
    data = [
        ("p", None, "tokens_per_minute", 1.0, None, "x", 0), ("p", None, "messages_per_period", 1.0, None, "5h", 1),
        ("p", None, "credits_per_month", 10.0, "c", None, 2), ("p", None, "completions_per_month", 1.0, "completions", None, 3),
    ]
    out = N.document_limit(spark.createDataFrame(data, SCHEMA)).orderBy("ord").collect()
    assert [(r.limit_type, r.limit_unit, r.reset_window) for r in out] == [
        ("tokens_per_minute", "tokens", "1h"), ("messages_per_period", "messages", None), ("credits", None, "1mo"),
        ("completions_per_month", "completions", "1mo"),
    ]
    n = N.normalize_limits(N.document_limit(spark.createDataFrame(data, SCHEMA))).orderBy("ord").collect()
    assert n[2].layer == "time_window" and n[2].tokens_1mo == 50000


def test_best_limit_first_wins_ties_and_nulls_drop(spark):
    data = [("p", None, "rate", 100.0, "tokens", None, 1), ("p", None, "rate", 100.0, "tokens", None, 0), ("q", None, "unknown", None, None, None, 0)]
    out = N.best_limit(N.normalize_limits(spark.createDataFrame(data, SCHEMA)), ("ord",)).collect()
    assert [(r.plan_id, r.ord) for r in out] == [("p", 0)]


def test_refresh_first_and_last(spark):
    data = [("p", None, "rate", 1.0, "tokens", None, 0), ("p", None, "rate", 2.0, "tokens", None, 1), ("q", "m", "rate", 3.0, "tokens", None, 2)]
    df = spark.createDataFrame(data, SCHEMA)
    have = spark.createDataFrame([("q", "m")], "plan_id string, model_key string")
    assert [r.tokens_1mo for r in N.refresh_estimates(df, have, ("ord",)).collect()] == [1]
    assert sorted(r.tokens_1mo for r in N.refresh_estimates(df, have, ("ord",), force=True).collect()) == [2, 3]


def test_audit(spark):
    df = spark.createDataFrame([("p", None, "rate", 10.0, "seats", "1d", 0)], SCHEMA)
    r = N.audit(N.normalize_limits(df)).collect()[0]
    assert [c.layer for c in r.conversion_chain] == ["time_window", "requests"]
    assert r.assumptions == ["Generic unit limit: 5000 tokens/seats"]
    assert r.warnings == ["Window 5h has unknown confidence (large extrapolation)"]


def test_prefix_table_matches_config_form(spark):
    plans = spark.createDataFrame([("openai-pro",), ("open",), ("x",)], "plan_id string")
    table = spark.createDataFrame([("open", 0, 1.0), ("openai", 1, 2.0), ("openai-pro", 2, 3.0)], "key string, ord int, rate double")
    out = {r.plan_id: r.rate for r in N.lookup_by_prefix(plans, "plan_id", table, "rate").collect()}
    assert out == {"openai-pro": 3.0, "open": 1.0, "x": None}


def test_config_rules(spark):
    base = {
        **{f"{n}_{k}": float(v) for n in ("tokensPerCodingMessage", "tokensPerAgenticRequest", "tokensPerAutocomplete") for k, v in (("low", 1), ("base", 2), ("high", 3))},
        "tokensPerCredit_base": 1.0, "tokensPerComputeUnit_base": 1.0, "sessionsPerMonth": 80.0, "workingDaysPerMonth": 20.0, "weeksPerMonth": 4.0, "hoursPerSession": 5.0,
    }
    bad = {**base, "tokensPerCodingMessage_low": 9.0, "workingDaysPerMonth": 40.0}
    out = N.config_errors(spark.createDataFrame([base, bad])).select("errors").collect()
    assert sorted(len(r.errors) for r in out) == [0, 2]
    assert any("workingDaysPerMonth must be 1-31" in r.errors for r in out)


def test_envelope_skips_missing(spark):
    r = N.envelope(N.normalize_limits(spark.createDataFrame([("p", None, "rate", 5.0, "tokens", None, 0)], SCHEMA))).collect()[0]
    assert r.uncertainty_low is None and r.uncertainty_high is None
