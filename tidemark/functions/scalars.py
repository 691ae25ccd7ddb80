"""Scalar formulas as column expressions. Ages are whole days, truncated and floored at 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_days(now: Column, then: Column) -> Column:
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return F.greatest(F.floor(micros / 86_400_000_000), F.lit(0))


def clamp_window(seconds: Column) -> Column:
    return F.greatest(F.lit(1), F.least(seconds, F.lit(86_400)))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def effective_confidence(confidence: Column, corroboration: Column, age: Column, half_life: float, importance: Column | float, closed: Column) -> Column:
    """Confidence raised by corroboration and halved each half_life, which importance stretches; closed facts have none."""
    boost = F.least(1 + 0.1 * (corroboration - 1), F.lit(2.0))
    decay = F.pow(F.lit(2.0), -age / half_life)
    value = confidence * boost * decay * (1 + 2 * F.lit(importance) if not isinstance(importance, Column) else 1 + 2 * importance)
    return F.when(closed, 0.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def experience_weight(weight: Column, confidence: Column, age: Column, half_life: float, importance: Column) -> Column:
    return weight * confidence * F.pow(F.lit(2.0), -age / half_life) * (1 + 2 * importance)


def reinforce(base: Column, age: Column, accesses: Column) -> Column:
    return F.least(F.greatest(base / (1 + 0.05 * age) + 0.1 * F.log2(1 + accesses), F.lit(0.0)), F.lit(1.5))


def fact_temporal_score(intent: str, age: Column, closed: Column, valid_then: Column | None = None) -> Column:
    """How well a fact's time fits the intent: historical, recent or current."""
    if intent == "historical":
        return F.lit(0.6) if valid_then is None else F.when(valid_then, 0.95).otherwise(0.2)
    if intent == "recent":
        return F.exp(-age / 30)
    return F.when(closed, 0.2).otherwise(0.6 + 0.4 * F.exp(-age / 120))


def blend(base: Column, weight: Column | float, score: Column) -> Column:
    return base * F.greatest(F.lit(0.2), F.least(1 + weight * (score - 0.5) * 1.6, F.lit(2.0)))


def tier_for_age(age: Column) -> Column:
    return F.when(age < 7, "full").when(age < 30, "half").when(age < 90, "int8").otherwise("binary")


def pipeline_backoff_ms(base: int, retries: Column) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), F.least(retries, F.lit(10))).cast("long")


def episode_backoff_ms(attempts: Column, most: int) -> Column:
    """Null once no attempt is left."""
    return F.when(attempts < most, F.lit(500) * F.pow(F.lit(2.0), attempts - 1).cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))
