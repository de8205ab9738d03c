"""Relational operators beyond parity: as-of and range joins, sampling by key, rollups.

Everything else (joins, grouping sets, windows, set operations) is Spark's own API."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], ts: str = "ts", columns: Sequence[str] = ()) -> DataFrame:
    """Each left row with ``columns`` of the last right row of the same key at or before its time.

    Both sides are put in one table and filled forward by a window, so nothing is multiplied."""
    sides = left.withColumn("__side", F.lit(1)), right.select(*on, ts, *columns).withColumn("__side", F.lit(0))
    payload = F.when(F.col("__side") == 0, F.struct(*columns))
    w = Window.partitionBy(*on).orderBy(F.col(ts), "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    filled = both.withColumn("__last", F.last(payload, ignorenulls=True).over(w)).where("__side = 1")
    keep = [c for c in left.columns if c not in columns]
    return filled.select(*keep, *(F.col(f"__last.{c}").alias(c) for c in columns))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges that hold them (both ends included): an equi-join on cells of ``width``."""
    p = points.withColumn("__cell", F.floor(F.col(value) / width))
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("__cell", F.explode(cells))
    return p.join(r, "__cell").where(F.col(value).between(F.col(low), F.col(high))).drop("__cell")


def salted_sum(df: DataFrame, keys: Sequence[str], value: str, salts: int = 16) -> DataFrame:
    """Sum in two steps, so that a hot key is spread over ``salts`` tasks first."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    part = df.withColumn("__salt", salt).groupBy(*keys, "__salt").agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    return part.groupBy(*keys).agg(F.sum("__s").alias("total"), F.sum("__n").alias("n"))
