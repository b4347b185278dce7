"""Scores of records as Column expressions: recency, confidence, quality, decay, composite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the six paths (keyword, semantic, temporal, graph, concept, activation) by intent.
PATHS = ("keyword", "semantic", "temporal", "graph", "concept", "activation")
RRF_WEIGHTS = {
    "factual": (0.27, 0.27, 0.09, 0.14, 0.13, 0.10),
    "temporal": (0.13, 0.13, 0.42, 0.13, 0.09, 0.10),
    "navigational": (0.32, 0.22, 0.05, 0.18, 0.13, 0.10),
    "exploratory": (0.13, 0.30, 0.09, 0.18, 0.18, 0.12),
    "error_debug": (0.23, 0.23, 0.23, 0.09, 0.13, 0.09),
    "social_reasoning": (0.10, 0.20, 0.10, 0.30, 0.20, 0.10),
}
# Weights of rrf, rerank, recency, importance, confidence, hebbian, retention, depth, credibility.
SIGNALS = ("rrf", "rerank", "recency", "importance", "confidence", "hebbian", "retention", "depth", "credibility")
SIGNAL_WEIGHTS = {
    "factual": (0.37, 0.23, 0.05, 0.08, 0.05, 0.05, 0.05, 0.07, 0.05),
    "navigational": (0.37, 0.23, 0.05, 0.08, 0.05, 0.05, 0.05, 0.07, 0.05),
    "temporal": (0.23, 0.13, 0.25, 0.08, 0.05, 0.05, 0.10, 0.06, 0.05),
    "exploratory": (0.32, 0.18, 0.05, 0.08, 0.05, 0.10, 0.10, 0.07, 0.05),
    "error_debug": (0.32, 0.18, 0.15, 0.08, 0.05, 0.05, 0.05, 0.07, 0.05),
    "social_reasoning": (0.30, 0.18, 0.05, 0.10, 0.10, 0.10, 0.05, 0.07, 0.05),
}
# B and c of the retention curve (1 + b t)^-c by tier.
TIERS = {"ephemeral": (0.05, 0.5), "relevant": (0.03, 0.4), "established": (0.02, 0.3), "core": (0.01, 0.2)}
RRF_K, HALF_LIFE = 60, 30.0


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86400e6)


def by_value(values: dict[str, float], of: Column, otherwise: float) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(of == name, value) if out is None else out.when(of == name, value)
    return out.otherwise(otherwise)


def recency(at: Column, now: Column, half_life: float = HALF_LIFE) -> Column:
    """Halves every half_life days; 1 in the future, 0 without a date."""
    return F.coalesce(F.exp(-F.log(F.lit(2.0)) * F.greatest(days_between(now, at), F.lit(0.0)) / half_life), F.lit(0.0))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if isinstance(low, float) else low, F.least(F.lit(high), x))


def effective_confidence(now: Column) -> Column:
    """Confidence less its age, more with sources, less with contradictions, within a floor by importance."""
    c = F.coalesce(F.col("confidence"), F.lit(0.5)) - F.greatest(days_between(now, F.col("last_accessed")), F.lit(0.0)) * 0.001
    c = c + F.when(F.col("source_count") > 1, (F.col("source_count") - 1) * F.lit(0.15)).otherwise(0.0)
    c = c - F.least(F.col("contradiction_count"), F.lit(3)) * F.lit(0.05)
    c = c + F.when(F.col("importance") > 0.7, 0.1).otherwise(0.0)
    c = c - F.when(F.col("superseded_by").isNotNull(), 0.15).otherwise(0.0) - F.when(F.col("valid_to") < now, 0.25).otherwise(0.0)
    return clamp(c, F.when(F.col("importance") >= 0.8, 0.4).when(F.col("importance") >= 0.5, 0.2).otherwise(0.1), 1.0)


# Quality by length of the text, by its tags and by its type.
FALLBACK_BYTES, FALLBACK = 20, {"long": 0.5, "short": 0.2, "tags": 0.3, "type": 0.2}


def quality_fallback() -> Column:
    """By length of the text, presence of tags and of a type."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    value = F.when(F.octet_length("content") > FALLBACK_BYTES, FALLBACK["long"]).otherwise(FALLBACK["short"])
    return value + F.when(some("tags"), FALLBACK["tags"]).otherwise(0.0) + F.when(some("type"), FALLBACK["type"]).otherwise(0.0)


def act_r(days: Column, tier: Column) -> Column:
    """What is retained after some days: (1 + b days)^-c."""
    b = by_value({t: p[0] for t, p in TIERS.items()}, tier, TIERS["ephemeral"][0])
    c = by_value({t: p[1] for t, p in TIERS.items()}, tier, TIERS["ephemeral"][1])
    return F.pow(1 + b * F.greatest(days, F.lit(0.0)), -c)


def retention(last: Column, strength: Column, now: Column) -> Column:
    """exp(-0.05 hours / (24 strength)), strength at least 0.1; 0.5 without a date."""
    return F.coalesce(F.exp(-days_between(now, last) * 24 * 0.05 / (F.greatest(strength, F.lit(0.1)) * 24)), F.lit(0.5))


# Shares of a missing rerank weight; empty searches in a row from which recency and links count double and retention half as much again.
RERANK_TO = {"rrf": 0.70, "confidence": 0.15, "importance": 0.15}
MANY_EMPTY, EMPTY_FACTORS = 3, {"recency": 2.0, "hebbian": 2.0, "retention": 1.5}
RRF_FULL, HEBBIAN_GAIN, SUPERSEDED, QUALITY_SHARE = 0.05, 2, 0.5, 0.15


def weights(intent: Column | str, table: dict[str, tuple], names: tuple) -> dict[str, Column]:
    """Weight of each name for an intent, or for a column of intents; an unknown intent counts as factual."""
    if isinstance(intent, str):
        return dict(zip(names, map(F.lit, table[intent]), strict=True))
    return {name: by_value({i: values[k] for i, values in table.items()}, intent, table["factual"][k]) for k, name in enumerate(names)}


def composite(signals: dict[str, Column], intent: Column | str, empty_searches: Column | None = None) -> Column:
    """Weighted sum of signals between 0 and 1; the weight of a missing one goes to its neighbours."""
    w = weights(intent, SIGNAL_WEIGHTS, SIGNALS)
    if empty_searches is not None:
        for name, factor in EMPTY_FACTORS.items():
            w[name] = w[name] * F.when(empty_searches >= MANY_EMPTY, factor).otherwise(1.0)
    if "rerank" not in signals:
        for name, share in RERANK_TO.items():
            w[name] = w[name] + share * w["rerank"]
    if "credibility" not in signals:
        w["confidence"] = w["confidence"] + w["credibility"]
    importance, total = w["importance"], F.lit(0.0)
    if "depth" in signals:
        importance = importance + F.when(signals["depth"].isNull(), w["depth"]).otherwise(0.0)
        total = total + w["depth"] * F.coalesce(signals["depth"], F.lit(0.0))
    else:
        importance = importance + w["depth"]
    total = total + importance * signals["importance"] + w["rrf"] * F.least(signals["rrf"] / RRF_FULL, F.lit(1.0))
    total = total + w["hebbian"] * F.least(HEBBIAN_GAIN * signals["hebbian"], F.lit(1.0))
    for name in ("rerank", "recency", "confidence", "retention", "credibility"):
        if name in signals:
            total = total + w[name] * signals[name]
    return clamp(total, 0.0, 1.0)


# What a tier adds to quality.
TIER_BONUS = {"core": 0.15, "established": 0.10, "relevant": 0.05}


def quality(now: Column) -> Column:
    """From use, hits, age of unused records, tier, confidence and contradictions; between 0 and 1."""

    def used(n: str) -> Column:
        return F.when(F.col(n) > 0, F.least(F.log10(F.col(n) + F.lit(1.0)) / 2, F.lit(1.0))).otherwise(0.0)

    days = days_between(now, F.coalesce("last_accessed", "created_at"))
    age = F.when((days > 30) & (F.col("access_count") <= 1), F.least(F.log10(days / 30 + 1), F.lit(1.0)) * 0.15).otherwise(0.0)
    contra = F.least(F.least(F.col("contradiction_count"), F.lit(10)) * F.lit(0.05), F.lit(1.0)) * 0.05
    total = used("access_count") * 0.25 + used("search_hit_count") * 0.20 - age + by_value(TIER_BONUS, F.col("tier"), 0.0)
    return clamp(total + F.coalesce(F.col("confidence"), F.lit(0.5)) * 0.15 - contra, 0.0, 1.0)
