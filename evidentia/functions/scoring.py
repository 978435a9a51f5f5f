"""Scores and ranks as columns. Weights are arguments; the defaults are this library's policy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUST_WEIGHTS = {"payment": 0.30, "clarity": 0.25, "support": 0.20, "volume": 0.15, "tenure": 0.10}
AUTHORITY = {"employer": 6, "ats": 6, "board": 5, "search": 3, "community": 2, "farm": 0}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where f may use the value often and it is still computed once a row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def flags(signals: dict[str, Column]) -> Column:
    """Names of the signals that hold, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in signals.items()]))


def weighted(signals: dict[str, tuple[float, Column]], lifts: dict[str, Column] | None = None, threshold: float = 0.6) -> tuple[Column, Column]:
    """Sum of the weights of signals that hold, at most 1 and to three places, and their names; a lift raises the sum to the threshold."""
    total = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(0.0) for w, c in signals.values()), F.lit(0.0))
    for c in (lifts or {}).values():
        total = F.when(F.coalesce(c, F.lit(False)), F.greatest(total, F.lit(threshold))).otherwise(total)
    return F.round(F.least(total, F.lit(1.0)), 3), flags({n: c for n, (_, c) in signals.items()} | (lifts or {}))


def composite(dims: dict[str, Column], weights: dict[str, float] = TRUST_WEIGHTS) -> Column:
    """The weighted sum to four places, rounded as the binary number it is: Spark's round(c, 4) goes by its shortest decimal form, and lifts a half that is just below one."""
    return F.round(1e4 * sum((dims[k] * w for k, w in weights.items()), F.lit(0.0))) / 1e4


def trust_factor(trust: Column, unrated: float = 0.85) -> Column:
    return F.coalesce(0.4 + 0.6 * trust, F.lit(unrated))


def expected_value(fit: Column, trust: Column, confidence: Column, fresh: Column) -> Column:
    return F.round(fit * trust_factor(trust) * (0.7 + 0.3 * confidence) * fresh, 1)


def listing_confidence(tier: Column, tier_value: Column, direct: Column, has_pay: Column, sources: Column, age_days: Column, length: Column) -> Column:
    known = F.coalesce(tier != "unknown", F.lit(False))
    c = F.when(known, tier_value).otherwise(0.5) + F.when(~known & direct, 0.20).otherwise(0.0) + F.when(has_pay, 0.15).otherwise(0.0) + F.when(sources >= 2, 0.10).otherwise(0.0)
    c = c + F.when(age_days.isNull(), -0.10).when(age_days < 30, 0.10).otherwise(0.0) + F.when(length < 200, -0.10).otherwise(0.0)
    return F.when(tier == "farm", tier_value).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 3))


def claim_credibility(confidence: Column, provenance: Column, estimate: Column, up_to: Column, corroborated: Column) -> Column:
    c = confidence * provenance * F.when(estimate, 0.8).otherwise(1.0) * F.when(up_to, 0.72).otherwise(1.0)
    return F.least(F.lit(1.0), F.when(corroborated, c * 1.08).otherwise(c))


def conservative_trust(estimate: Column, confidence: Column, penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), estimate - penalty * (1 - confidence))


def match_strength(concepts: Column, language: Column) -> Column:
    n = F.size(concepts)
    return F.when((n >= 2) | (language & (n >= 1)), "strong").when((n == 1) | language, "medium").otherwise("weak")


def badge(value: Column, high: float, middle: float) -> Column:
    return F.when(value.isNull(), "unrated").when(value >= high, "high").when(value >= middle, "medium").otherwise("low")


def first_reason(verdicts: dict[str, Column], otherwise: str) -> Column:
    """The first verdict whose condition is true; unknown conditions never decide."""
    out = None
    for name, c in verdicts.items():
        hit = F.coalesce(c, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)
