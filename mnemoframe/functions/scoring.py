"""Scores of a fact: recency, salience, decay, hops, fusion, feedback.

``now`` is always an argument: a plan that reads the clock cannot be checked
or replayed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from mnemoframe.functions import fixed_values as fv


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def half_life_decay(since_days: Column, half_life_days: float = fv.HALF_LIFE_DAYS) -> Column:
    return F.exp(F.lit(-math.log(2.0) / half_life_days) * since_days)


def recency(last_accessed: Column, created_at: Column, now: Column,
            half_life_days: float = fv.HALF_LIFE_DAYS) -> Column:
    """Equal blend of access recency and creation recency; a missing date counts 0."""
    def part(ts: Column) -> Column:
        return F.coalesce(half_life_decay(days_between(now, ts), half_life_days), F.lit(0.0))

    return clamp(0.5 * part(last_accessed) + 0.5 * part(created_at))


def frequency_factor(frequency: Column, norm_k: float = fv.FREQUENCY_NORM) -> Column:
    return F.least(F.lit(1.0), F.log1p(frequency.cast("double")) / F.lit(math.log1p(norm_k)))


def salience(importance: Column, frequency: Column, norm_k: float = fv.FREQUENCY_NORM) -> Column:
    return clamp(importance.cast("double") * frequency_factor(frequency, norm_k))


def decay(importance: Column, frequency: Column, last_accessed: Column, now: Column,
          half_life_days: float = fv.HALF_LIFE_DAYS,
          norm_k: float = fv.FREQUENCY_NORM) -> Column:
    """Forgetting-curve score; never accessed means 0."""
    score = (importance.cast("double")
             * half_life_decay(days_between(now, last_accessed), half_life_days)
             * frequency_factor(frequency, norm_k))
    # least and greatest skip nulls, so the missing date is tested first
    return F.when(last_accessed.isNull(), F.lit(0.0)).otherwise(clamp(score))


def hop_score(depth: Column) -> Column:
    return F.pow(F.lit(0.5), depth)


def normalized_weights(weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """Weights scaled to sum 1; a missing weight is 0 and all-zero means equal shares."""
    raw = dict(fv.DEFAULT_WEIGHTS if weights is None else weights)
    unknown = set(raw) - set(fv.SIGNALS)
    if unknown:
        raise ValueError(f"unknown signals: {sorted(unknown)}")
    total = sum(raw.values())
    if total == 0:
        return {s: 1.0 / len(fv.SIGNALS) for s in fv.SIGNALS}
    return {s: raw.get(s, 0.0) / total for s in fv.SIGNALS}


def fused_score(weights: Mapping[str, float] | None = None) -> Column:
    """Weighted sum of the six ``<signal>_score`` columns."""
    terms = [F.col(f"{s}_score") * F.lit(w) for s, w in normalized_weights(weights).items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def blended(score: Column, similarity: Column, weight: float = fv.RERANK_WEIGHT) -> Column:
    return score * F.lit(1.0 - weight) + similarity * F.lit(weight)


def adjusted_importance(importance: Column, feedback_type: Column) -> Column:
    """Importance after one feedback event: raises cap at 1, cuts stop at 0.1."""
    expr = importance.cast("double")
    out = F.when(F.lit(False), expr)
    for kind, step in fv.FEEDBACK_STEPS.items():
        moved = (F.least(F.lit(1.0), expr + step) if step > 0
                 else F.greatest(F.lit(0.1), expr + F.lit(step)))
        out = out.when(feedback_type == kind, moved)
    return out.otherwise(expr)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4.0)).cast("long")
