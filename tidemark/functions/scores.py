"""Confidence, decay, authority and fusion weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights by enumeration value. Fixed values.
TRUST_FACTOR = {"authoritative": 1.0, "high": 0.95, "standard": 0.85, "low": 0.65, "untrusted": 0.4}
TRUST_WEIGHT = {"authoritative": 1.0, "standard": 0.8, "low": 0.5}
MEMORY_PRIORITY = {"semantic": 1.0, "procedural": 0.95, "preference": 0.9, "episodic": 0.85, "derived": 0.9, "working": 0.5}
MODE_WEIGHT = {"lexical": 1.0, "exact": 1.4, "vector": 1.0, "entity": 1.2, "graph": 0.7}
HALF_LIFE_DAYS, LEAST_DECAY = 30.0, 0.2


def by_value(x: Column, weights: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, w in weights.items():
        out = F.when(x == k, w).otherwise(out)
    return out


def trust_factor(x: Column) -> Column:
    return by_value(x, TRUST_FACTOR, 0.5)


def trust_weight(x: Column) -> Column:
    return by_value(x, TRUST_WEIGHT, 0.6)


def memory_priority(x: Column) -> Column:
    return by_value(x, MEMORY_PRIORITY, 0.8)


def _unit(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def confidence(parts: list[Column], corroboration: Column, contradiction: Column, human: Column) -> Column:
    """The product of the parts (null ones left out), lifted by corroboration, cut by contradiction, at least the human's."""
    score = F.lit(1.0)
    for p in parts:
        score = score * F.coalesce(_unit(p), F.lit(1.0))
    lift = F.coalesce(_unit(corroboration), F.lit(0.0))
    score = score + (1 - score) * lift * 0.5
    score = score * (1 - F.coalesce(_unit(contradiction), F.lit(0.0)))
    return _unit(F.greatest(score, F.coalesce(_unit(human), F.lit(0.0))))


def decay(starts: Column, at: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """1 before decay starts or without a start, then halved each half-life, never below the least."""
    seconds = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(starts.cast("timestamp"))) / F.lit(1e6)
    weight = F.greatest(F.lit(LEAST_DECAY), F.pow(F.lit(0.5), seconds / (half_life_days * 86400.0)))
    return F.when(starts.isNull() | (seconds <= 0), 1.0).otherwise(weight)


def consolidated(mean: Column, members: Column, sources: Column) -> Column:
    """Confidence of a fact from repeated observations: repetition and independent sources lift it, to 0.95 at most."""
    repetition = 1 - F.pow(F.lit(0.6), members)
    independent = 1 - F.pow(F.lit(0.5), sources)
    return F.least(F.lit(0.95), mean * (0.6 + 0.25 * repetition + 0.15 * independent))


def evidence_quality(links: Column, quoted: Column, sources: Column) -> Column:
    """0.5 without evidence; else 0.6, more with a quote, more with several sources."""
    return F.when(links == 0, 0.5).otherwise(F.lit(0.6) + F.when(quoted > 0, 0.25).otherwise(0.0) + F.when(sources > 1, 0.15).otherwise(0.0))
