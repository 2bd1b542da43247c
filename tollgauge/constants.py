"""Enums, weights, lookup tables and message texts that results depend on.

Everything here is data. The rules that use it live in ``functions`` and ``operators``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: confidence ------------------------------------------------
CONFIDENCE_RANK = {"observed": 4, "inferred": 3, "assumed": 2, "stale": 1, "unknown": 0}
CONFIDENCE_LABEL = {
    "observed": "Verified",
    "inferred": "Inferred",
    "assumed": "Estimated",
    "stale": "Stale",
    "unknown": "Unknown",
}
STALE_AFTER_DAYS = 90

# --- fixed values: enums ------------------------------------------------------
LIMIT_TYPES = [
    "messages_per_day",
    "messages_per_month",
    "messages_per_period",
    "tokens_per_minute",
    "tokens_per_day",
    "tokens_per_month",
    "requests_per_minute",
    "requests_per_day",
    "requests_per_month",
    "completions_per_month",
    "credits_per_month",
    "usd_credits_per_month",
    "compute_units_per_month",
    "unknown",
]
TIERS = ["free", "individual", "pro", "team", "enterprise", "api"]
IN_SCOPE_TIERS = ["individual", "pro"]
ACCESS_TYPES = ["full", "limited", "preview", "legacy"]
CATEGORIES = ["ai_lab", "ide_tool", "platform", "open_source"]
BENCHMARK_UNITS = ["percent", "pass@1", "normalized", "rank"]
PROVENANCE_METHODS = ["manual", "automated"]
BANNED_LIMIT_TYPES = ["unlimited", "fair_use", "fair-use"]
PRICE_BANDS = ["low", "mid", "high"]
PRICE_BAND_LABEL = {"low": "Budget", "mid": "Standard", "high": "Premium"}

# --- fixed values: hours per window ---------------------------------------------
WINDOW_HOURS = {"1h": 1, "3h": 3, "5h": 5, "1d": 24, "1w": 168, "1mo": 730, "1y": 8760}
TARGET_HOURS = {"5h": 5, "24h": 24, "1w": 168, "1mo": 730}

# --- fixed values: words for a reset window in text ------------------------------
RESET_WORDS = {
    "second": "1s",
    "sec": "1s",
    "min": "1m",
    "minute": "1m",
    "hour": "1h",
    "day": "1d",
    "week": "1w",
    "month": "1mo",
    "mo": "1mo",
    "year": "1y",
    "yr": "1y",
}

# --- fixed values: score formula -----------------------------------------------
WMQ_AGENTIC = 0.50
WMQ_CODING = 0.40
WMQ_SPEED = 0.10
SPEED_WHEN_MISSING = 50.0
BLEND_INPUT = 0.30
BLEND_OUTPUT = 0.70
USD_PER_CREDIT = 0.01
COST_REFERENCE_USD = 20.0
CAPACITY_REFERENCE = 40_000.0
EFFICIENCY_FLOOR = 0.85
EFFICIENCY_CEILING = 1.15
EFFICIENCY_MEDIAN_POINTS = 50.0
SPEED_TPS_CEILING = 300.0
PLAN_WEIGHT_COST = 0.35
PLAN_WEIGHT_BENCHMARK = 0.40
PLAN_WEIGHT_FEATURE = 0.25
BENCHMARK_WEIGHTS = {
    "SWE-bench-verified": 0.45,
    "HumanEval": 0.25,
    "Aider-polyglot": 0.20,
    "LiveCodeBench": 0.10,
}
FEATURE_WEIGHTS = {
    "agent_capabilities": 20,
    "code_context_length_k": 15,
    "file_uploads": 10,
    "api_access": 10,
    "cli_access": 10,
    "custom_instructions": 8,
    "web_search": 7,
    "priority_access": 7,
    "team_features": 7,
    "sso": 4,
}
IDE_WEIGHT = 2

# --- fixed values: versions -------------------------------------------------------
NORMALIZATION_VERSION = "1.2.0"
ENGINE_VERSION = "1.1.0"
RANKINGS_VERSION = "1.0.0"

# --- fixed values: creator code -> provider code where the two differ ---------------
CREATOR_PROVIDER = {"alibaba": "qwen"}

# --- fixed values: model recency, months -------------------------------------------
MODEL_RECENCY_MONTHS = 6
CATALOG_RECENCY_MONTHS = 12
CATALOG_TOP_N = 100
CATALOG_PER_PROVIDER = 12

# --- fixed values: texts that appear in results ---------------------------------------
NOTE_NO_SCORE = "No AA data available"
NOTE_SPEED_MISSING = "Speed score missing — using 50/100 fallback"
NOTE_NO_INDEX = "No agentic or coding index — WMQ cannot be computed"
NOTE_REDISTRIBUTED = " index missing — weights redistributed to available indices"
NOTE_ZERO_COST = "Model cost is zero — cannot compute cost-adjusted estimate"
NOTE_BLENDED = ("Model cost adjustment: blended $", "/1M tokens (30% input, 70% output). 1 credit = $0.01 assumed.")
NOTE_EFFICIENCY = ("Efficiency multiplier ", "× (cost-per-task $", " vs median $", ")")
NOTE_NEUTRAL = "No cost-per-task data — efficiency neutral"
NOTE_NO_BENCHMARK = "Benchmark index defaulted to 0 — no coding benchmark data available for included models."
NOTE_NO_PRICE = "Pricing unknown — QAMU requires a price; fell back to legacy score."
NOTE_NO_USAGE = "Usage limits unknown — QAMU cannot be computed; fell back to legacy score."
CAVEAT_CONFIDENCE_HEAD = "Data confidence: "
CAVEAT_CONFIDENCE_TAIL = " — not directly observed from the provider source; figures are proxied or assumed."
CAVEAT_NO_BAND = {
    "low": "No low-cost ($0.01–30) plan offers this model.",
    "mid": "No mid-cost ($30.01–80) plan offers this model.",
    "high": "No high-cost (>$80) plan offers this model.",
}
WARNING_UNKNOWN_LIMIT = "Cannot estimate — unknown limit type"
DIFF_NOTE_UNKNOWN = "JSON price is null (API/variable pricing) — no diff possible"
DIFF_NOTE_FREE = "Free plan — confirmed by absence of price requirement"
DIFF_NOTE_NOT_FOUND = "No USD prices found on page — page may be blocked or use non-USD pricing"


@dataclass(frozen=True)
class Range:
    low: float
    base: float
    high: float


@dataclass(frozen=True)
class UsdRate:
    """USD per million output tokens; ``low`` is the expensive end."""

    conservative: float
    base: float
    optimistic: float


# --- fixed values: default USD rates ------------------------------------------------
_COPILOT_RATE = UsdRate(75, 20, 10)
_CURSOR_RATE = UsdRate(150, 40, 2)


@dataclass(frozen=True)
class NormalizationConfig:
    """Assumptions used to turn limits into tokens. Map order matters for prefix lookups."""

    tokens_per_message: Range = Range(1000, 2000, 5000)
    tokens_per_request: Range = Range(3000, 5000, 12000)
    tokens_per_autocomplete: Range = Range(50, 150, 400)
    tokens_per_credit: float = 500
    tokens_per_compute_unit: float = 1000
    sessions_per_month: float = 80
    working_days_per_month: float = 20
    weeks_per_month: float = 4
    hours_per_session: float = 5
    model_multipliers: dict[str, float] = field(default_factory=dict)
    credit_mappings: dict[str, float] = field(default_factory=dict)
    compute_unit_mappings: dict[str, float] = field(default_factory=dict)
    default_usd_rate: UsdRate = UsdRate(75, 20, 10)
    usd_rates: dict[str, UsdRate] = field(
        default_factory=lambda: {
            "copilot-individual": _COPILOT_RATE,
            "copilot-pro-plus": _COPILOT_RATE,
            "copilot-max": _COPILOT_RATE,
            "cursor-pro": _CURSOR_RATE,
        }
    )
