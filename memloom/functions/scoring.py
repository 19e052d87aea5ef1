"""Scalar scores as column expressions: all stay inside generated code, none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def days_between(later: Column, earlier: Column) -> Column:
    """Whole and part days, never negative."""
    return F.greatest(F.lit(0.0), (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000.0)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def hebbian(w: Column, a: Column, b: Column, eta: float = 0.02, mu: float = 0.01, low: float = 0.0, high: float = 1.0) -> Column:
    return clamp((1 - mu) * w + eta * a * b, low, high)


def surprise_factor(score: Column) -> Column:
    return F.when(score >= 0.7, 2.0).when(score >= 0.4, 1.5).otherwise(1.0)


def effective_weight(weight: Column, semantic: Column, temporal: Column, coactivation: Column) -> Column:
    """Weight times the dimension mix; a mix of nothing counts as one."""
    mix = 0.6 * semantic + 0.2 * temporal + 0.2 * coactivation
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight) * F.when(mix == 0, 1.0).otherwise(mix))


def evidence_decay(weight: Column, days: Column, evidence: Column, rate: float = 0.05) -> Column:
    return weight * F.pow(1 - rate / F.sqrt(F.greatest(F.lit(1.0), evidence)), days)


def exponential_decay(weight: Column, days: Column, rate: float = 0.1) -> Column:
    return weight * F.exp(-rate * F.greatest(F.lit(0.0), days))


def path_similarity(a: Column, b: Column) -> Column:
    """0.8 in the same folder, 0.5 below the same top folder, else 0."""
    folder = lambda p: F.regexp_replace(p, "/[^/]*$", "")
    top = lambda p: F.split(F.ltrim(p, F.lit("/")), "/")[0]
    return F.when(folder(a) == folder(b), 0.8).when(top(a) == top(b), 0.5).otherwise(0.0)


def recency(days: Column, layer: Column) -> Column:
    """Decays by 0.05 a day at the base, 0.02 in layer 1 and 0.01 above."""
    rho = F.when(layer == 0, 0.05).when(layer == 1, 0.02).otherwise(0.01)
    return F.exp(-rho * days)


#: Weights of the final score.
ALPHA, BETA, GAMMA, DELTA, PHI, KAPPA = 0.55, 0.30, 0.10, 0.05, 0.08, 0.12


def final_score(sim: Column, activation: Column, rec: Column, confidence: Column, layer: Column, degree: Column, redundant: Column, path: Column, comparison: Column, config: Column) -> Column:
    hub = F.when(layer == 0, PHI * F.log(1 + degree)).otherwise(0.0)
    score = ALPHA * sim + BETA * activation + GAMMA * rec + DELTA * confidence + 0.15 * path + 0.15 * comparison - hub - KAPPA * F.least(F.lit(3), redundant)
    return score * F.when(config, 1.15).otherwise(1.0)


def fused_similarity(sim: Column, in_vector: Column, in_text: Column, text_rank: Column) -> Column:
    """What a fused candidate counts as: its similarity, a bonus if both lists have it, a falling figure if only text has."""
    only_text = F.greatest(F.lit(0.4), 0.95 - 0.02 * (text_rank - 1))
    return F.when(in_vector & in_text, F.least(F.lit(1.0), sim + 0.05)).when(in_vector, sim).otherwise(only_text)


def learning_phase(edges: Column) -> Column:
    return F.when(edges < 1, "cold").when(edges < 10_000, "learning").when(edges < 50_000, "warm").otherwise("saturated")


#: Importance a new observation gets by its type, and the importance of the type in relevance.
INITIAL_IMPORTANCE = {"correction": 0.9, "decision": 0.8, "error": 0.75, "blocker": 0.8, "context": 0.7, "learning": 0.6, "insight": 0.65, "preference": 0.5, "progress": 0.4, "technical_note": 0.5, "task": 0.7}
TYPE_IMPORTANCE = {"correction": 0.9, "decision": 0.8, "error": 0.75, "blocker": 0.85, "progress": 0.6, "learning": 0.7, "preference": 0.65, "context": 0.7, "technical_note": 0.6, "insight": 0.75, "task": 0.8}


def lookup(key: Column, values: dict, default) -> Column:
    """The value of ``key`` in a small fixed table."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(pairs[F.coalesce(key, F.lit(""))], F.lit(default))


def edge_kind(sim: Column, co: Column, src_layer: Column, dst_layer: Column) -> tuple[Column, Column]:
    """The inferred type of an edge between upper nodes, and its confidence."""
    gap = F.abs(src_layer - dst_layer)
    middle = (sim >= 0.4) & (sim < 0.7)
    cases = [
        ((sim >= 0.7) & (gap == 0), F.lit("ANALOGOUS_TO"), sim),
        ((sim <= 0.3) & (co >= 0.5), F.lit("CONTRASTS_WITH"), co * (1 - sim)),
        ((co >= 0.5) & middle, F.lit("COMPOSES_WITH"), co),
        ((gap > 0) & middle, F.lit("BRIDGES"), F.least(F.lit(1.0), sim * (1 + 0.1 * gap))),
        ((gap > 0) & (sim >= 0.7), F.when(src_layer < dst_layer, "GENERALIZES_TO").otherwise("SPECIALIZES"), sim),
    ]
    kind, conf = F.lit("INFLUENCES"), F.lit(0.5)
    for when, k, c in reversed(cases):
        kind, conf = F.when(when, k).otherwise(kind), F.when(when, c).otherwise(conf)
    return kind, conf
