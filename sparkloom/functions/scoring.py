"""Scores of search results."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of each content type.
WEIGHTS = {
    "DecisionPoint": 1.0,
    "ProblemSolution": 0.9,
    "UserMessage": 0.8,
    "UpdateContent": 0.7,
    "CodeSnippet": 0.6,
    "EntityDescription": 0.5,
    "SessionMetadata": 0.3,
}
#: Least similarity of each quality label.
QUALITY = [("Excellent", 0.85), ("Very Good", 0.70), ("Good", 0.55), ("Moderate", 0.40), ("Fair", 0.30)]
THRESHOLDS = {"excellent": 0.85, "very_good": 0.70, "good": 0.55, "moderate": 0.40, "fair": 0.30}

Adjuster = Callable[[Column], Column]


def lookup(values: dict, key: Column, default) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def content_type(col: Column) -> Column:
    """The type itself if known, else UpdateContent."""
    return F.when(col.isin(*WEIGHTS), col).otherwise("UpdateContent")


def importance(kind: Column) -> Column:
    return lookup(WEIGHTS, content_type(kind), 0.7)


def combined(similarity: Column, weight: Column) -> Column:
    return similarity.cast("double") * 0.7 + weight.cast("double") * 0.3


def whole_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days from start to end."""
    return F.timestamp_diff("DAY", start, end)


def recency(ts: Column, now: Column, bias: float) -> Adjuster:
    """Exponential decay by age in years; the rate is clamped to 0..10, future dates have age 0."""
    rate = min(10.0, max(0.0, bias)) if math.isfinite(bias) else 0.0
    days = F.greatest(whole_days(ts, now), F.lit(0))
    return lambda score: score * F.exp(F.lit(-rate) * days / 365.0)


def scale(factor: float) -> Adjuster:
    return lambda score: score * factor


def compose(adjusters: Iterable[Adjuster]) -> Adjuster:
    """Adjusters applied from left to right; any callable Column -> Column may take part."""
    return lambda score: reduce(lambda s, f: f(s), adjusters, score)


def quality(similarity: Column) -> Column:
    out = F.when(similarity >= QUALITY[0][1], QUALITY[0][0])
    for name, least in QUALITY[1:]:
        out = out.when(similarity >= least, name)
    return out.otherwise("Weak")


def meets_quality(similarity: Column, threshold: str) -> Column:
    return similarity >= THRESHOLDS.get(threshold, 0.0)


def explanation(score: Column, similarity: Column, weight: Column) -> Column:
    return F.format_string("Combined Score: %.4f = (Similarity: %.4f × 0.7) + (Importance: %.2f × 0.3) | Quality: %s", score, similarity, weight, quality(similarity))
