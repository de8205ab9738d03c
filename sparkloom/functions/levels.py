"""Derived levels of summaries. The bounds and names are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    out = F.when(value >= steps[0][0], steps[0][1])
    for least, name in steps[1:]:
        out = out.when(value >= least, name)
    return out.otherwise(rest)


def confidence(c: Column) -> Column:
    return _steps(c, [(0.8, "High"), (0.6, "Medium"), (0.4, "Low")], "VeryLow")


def importance(score: Column) -> Column:
    return _steps(score, [(2.0, "Critical"), (1.5, "High"), (1.0, "Medium"), (0.5, "Low")], "Minimal")


def recency(days: Column) -> Column:
    return F.when(days == 0, "Today").when(days.between(1, 3), "Recent").when(days.between(4, 7), "ThisWeek").when(days.between(8, 30), "ThisMonth").otherwise("Old")


def urgency(status: Column, days: Column) -> Column:
    opened, going = status == "Open", status == "InProgress"
    return (
        F.when(opened & (days > 7), "High").when(opened & (days > 3), "Medium").when(going & (days > 14), "High").when(going, "Medium").otherwise("Low")
    )


def complexity(examples: Column, related: Column) -> Column:
    return F.when((examples > 3) & (related > 5), "High").when((examples > 1) & (related > 2), "Medium").otherwise("Low")


def duration(hours: Column) -> Column:
    return F.when(hours.between(0, 1), "Short").when(hours.between(2, 4), "Medium").when(hours.between(5, 8), "Long").otherwise("Extended")


def activity(updates: Column, hours: Column) -> Column:
    """By whole updates per hour (hours below 1 count as 1)."""
    rate = F.floor(updates / F.greatest(hours, F.lit(1)))
    return F.when(rate > 10, "VeryHigh").when(rate > 5, "High").when(rate > 2, "Medium").when(rate > 0, "Low").otherwise("Minimal")
