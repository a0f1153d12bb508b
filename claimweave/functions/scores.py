"""Scores and rules on aggregates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the eight parts of a source's quality (fixed values).
QUALITY = {"authority": 0.20, "relevance": 0.18, "directness": 0.18, "model": 0.12, "part": 0.12, "independence": 0.10, "recency": 0.05, "depth": 0.05}


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def half_up(c: Column, digits: int = 2) -> Column:
    """Rounded as ``floor(x * 10^n + 0.5) / 10^n``."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def recency(published: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, published)
    return F.when(published.isNull(), F.lit(0.5)).when(days <= 180, F.lit(1.0)).when(days <= 365, F.lit(0.8)).when(days <= 730, F.lit(0.6)).otherwise(F.lit(0.4))


def total_quality(**parts: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in QUALITY.items():
        if name in parts:
            out = out + clamp01(parts[name]) * weight
    return out


def claim_strength(weight: Column, exact_sku: Column, any_sku: Column, number: Column, device: Column, part: Column, attributes: Column, kind: Column) -> Column:
    raw = 0.42 * weight + F.when(exact_sku, 0.22).when(any_sku, 0.12).otherwise(0.0)
    for flag, bonus in ((number, 0.16), (device, 0.10), (part, 0.08), (attributes, 0.05)):
        raw = raw + F.when(flag, bonus).otherwise(0.0)
    raw = raw * F.when(kind == "spec_only", 0.8).when(kind == "unclear", 0.85).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.05), raw))


def strength_level(strength: Column) -> Column:
    return F.when(strength >= 0.68, "high").when(strength >= 0.45, "medium").otherwise("low")


def verdict(n_support: Column, n_oppose: Column, w_support: Column, w_oppose: Column, d_support: Column, d_oppose: Column, best_support: Column, best_oppose: Column, quality: Column, n_other: Column, n_sibling: Column) -> Column:
    """Verdict on a question with a device: the first rule that holds, from counts, weights, domains and strengths by side."""
    return (
        F.when(n_support + n_oppose + n_other + n_sibling == 0, "insufficient_evidence")
        .when((w_oppose > 1.15 * w_support) & (d_oppose >= 1) & (best_oppose >= 0.55) & (d_support == 0), "not_compatible")
        .when((n_support > 0) & (n_oppose > 0), "uncertain")
        .when(n_oppose > 0, F.when(best_oppose >= 0.55, "not_compatible").otherwise("uncertain"))
        .when((n_support == 0) & (n_sibling > 0), "uncertain")
        .when(n_support == 0, F.when(n_other > 0, "uncertain").otherwise("insufficient_evidence"))
        .when((d_support >= 3) & (quality >= 0.6) & (best_support >= 0.6), "compatible")
        .when((d_support >= 2) & (quality >= 0.5), "likely_compatible")
        .when(best_support >= 0.6, "likely_compatible")
        .otherwise("uncertain")
    )


def confidence_score(quality: Column, d_support: Column, s_support: Column, s_oppose: Column, coverage: Column, number: Column, good_domains: Column, exact: Column, conflicts: Column, risks: Column, n_claims: Column) -> Column:
    """0 to 100 before the rules of :func:`confidence_level`."""
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    both = s_support + s_oppose
    base = (
        clamp01(quality) * 0.24 + clamp01(d_support / 3) * 0.22 + clamp01(F.when(both > 0, s_support / both).otherwise(0.0)) * 0.20
        + clamp01(coverage * 0.8 + flag(number, 0.2)) * 0.12 + flag(number, 0.12) + flag(good_domains >= 2, 0.06) + flag(exact, 0.04)
    )
    minus = F.least(F.lit(0.25), conflicts * 0.12) + F.least(F.lit(0.12), risks * 0.06) + F.when(n_claims == 0, 0.35).when(n_claims == 1, 0.12).otherwise(0.0)
    minus = minus + flag(d_support == 1, 0.08) + flag(~exact & (n_claims > 0), 0.12)
    return F.floor(clamp01(base - minus) * 100 + 0.5).cast("int")


def confidence_level(score: Column, verdict: Column, support: Column, oppose: Column, d_support: Column, good_domains: Column, exact: Column) -> Column:
    """Struct (score, level) after floors, caps and the rules that keep the level consistent with the verdict."""
    strong = verdict.isin("compatible", "likely_compatible")
    none = verdict.isin("insufficient_evidence", "research_failed", "not_configured")
    level = (
        F.when(verdict == "not_compatible", "NOT_COMPATIBLE")
        .when(none, "UNKNOWN")
        .when(support & oppose, F.when(score >= 55, "POSSIBLE").otherwise("UNKNOWN"))
        .when(~support, F.when(score >= 35, "POSSIBLE").otherwise("UNKNOWN"))
        .when(strong & (d_support >= 4) & (score >= 85) & (good_domains >= 2) & ~oppose, "CONFIRMED")
        .when(strong & (d_support >= 3) & (score >= 72), "HIGH_CONFIDENCE")
        .when(score >= 55, "LIKELY")
        .when(score >= 35, "POSSIBLE")
        .otherwise("UNKNOWN")
    )
    held = F.when(verdict == "not_compatible", F.greatest(score, F.lit(60))).when(none, F.least(score, F.lit(18))).when(support & oppose, F.least(score, F.lit(58))).when(~support, F.least(score, F.lit(40))).otherwise(score)
    rail = strong & support & ~oppose
    level = F.when(rail & (level == "UNKNOWN"), "POSSIBLE").otherwise(level)
    held = F.when(rail & (level == "LIKELY"), F.greatest(held, F.lit(55))).when(rail & (level == "POSSIBLE"), F.greatest(held, F.lit(35))).otherwise(held)
    return F.struct(held.alias("score"), F.when(level.isin("CONFIRMED", "HIGH_CONFIDENCE") & ~exact, "LIKELY").otherwise(level).alias("level"))
