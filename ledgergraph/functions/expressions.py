"""Predicates and formulas shared by operators, as SQL text.

Values marked *fixed* must equal the reference's, since results depend on them.
"""

from __future__ import annotations

from ..plans.dialect import Spark

# Hours of night for features and rules; flags use 0 to 4 inclusive.
NIGHT_HOURS = (22, 23, 0, 1, 2, 3)
NIGHT_FLAG = (0, 4)
# Half-open amount bands just under reporting limits (feature score).
STRUCT_FEATURE_BANDS = (
    (9_500, 10_000),
    (95_000, 100_000),
    (950_000, 1_000_000),
    (9_500_000, 10_000_000),
    (95_000_000, 100_000_000),
    (450_000_000, 500_000_000),
)
# Closed amount bands (rule).
STRUCT_RULE_BANDS = (
    (425_000, 499_999),
    (850_000, 999_999),
    (4_250_000, 4_999_999),
    (21_250_000, 24_999_999),
)
# Thresholds whose [0.85 T, 0.999 T] band a flag counts.
STRUCT_FLAG_LIMITS = (500_000, 1_000_000, 5_000_000, 25_000_000, 100_000_000)
# Units of the local currency per unit of a foreign one.
FX_RATES = {
    "US Dollar": 16000.0, "Euro": 17500.0, "UK Pound": 20500.0, "Swiss Franc": 18000.0, "Canadian Dollar": 11800.0,
    "Australian Dollar": 10700.0, "Yuan": 2250.0, "Yen": 105.0, "Rupee": 190.0, "Ruble": 175.0, "Brazil Real": 2900.0,
    "Saudi Riyal": 4270.0, "Mexican Peso": 800.0, "Shekel": 4400.0, "Bitcoin": 1_000_000_000.0,
}
# Channels and their codes; any other is 2.
CHANNELS = ("mobile", "atm", "internet", "teller", "qris")
UNKNOWN_CHANNEL = 2


def night(ts: str) -> str:
    return f"hour({ts}) in ({', '.join(map(str, NIGHT_HOURS))})"


def night_flag(ts: str) -> str:
    return f"hour({ts}) between {NIGHT_FLAG[0]} and {NIGHT_FLAG[1]}"


def struct_feature(amount: str) -> str:
    return "(" + " or ".join(f"({amount} >= {lo} and {amount} < {hi})" for lo, hi in STRUCT_FEATURE_BANDS) + ")"


def round_amount(amount: str) -> str:
    return f"({amount} > 0 and abs({amount} - round({amount} / 10000, 0) * 10000) < 1)"


def channel_code(channel: str) -> str:
    whens = " ".join(f"when '{c}' then {i}" for i, c in enumerate(CHANNELS))
    return f"cast(case {channel} {whens} else {UNKNOWN_CHANNEL} end as int)"


def fx(amount: str, currency: str) -> str:
    whens = " ".join(f"when '{c}' then {r}e0" for c, r in FX_RATES.items())
    return f"cast({amount} as double) * (case {currency} {whens} else 1.0e0 end)"


def severity(score: str) -> str:
    """Alerts: 0.8 and 0.5 belong to the upper level."""
    return f"case when {score} >= 0.8e0 then 'HIGH' when {score} >= 0.5e0 then 'MEDIUM' else 'LOW' end"


def level_binned(score: str) -> str:
    """Predictions: right-closed bins, so 0.5 and 0.8 belong to the lower level."""
    return f"case when {score} > 0.8e0 then 'HIGH' when {score} > 0.5e0 then 'MEDIUM' else 'LOW' end"


def level_ensemble(score: str) -> str:
    """Ensemble scores: strictly above 0.8 and 0.5."""
    return f"case when {score} > 0.8e0 then 'HIGH' when {score} > 0.5e0 then 'MEDIUM' else 'LOW' end"


def level_stream(score: str) -> str:
    return f"case when {score} >= 0.85e0 then 'HIGH' when {score} >= 0.5e0 then 'MEDIUM' else 'LOW' end"


def severity_osint(score: str) -> str:
    return f"case when {score} >= 0.8e0 then 'HIGH' else 'MEDIUM' end"


def sigmoid(x: str) -> str:
    return f"1.0e0 / (1.0e0 + exp(-greatest(-80.0e0, least(80.0e0, {x}))))"


def alert_id(d: Spark, account: str, typology: str, run_key: str) -> str:
    text = f"cast({account} as varchar(64)) || '|' || upper({typology}) || '|' || {run_key}"
    return f"'ALT-' || upper(substr(sha1({text}), 1, 12))"
