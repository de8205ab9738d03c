"""Top N items within every group, ties broken by a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import canonical_id, table


def top_n_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    distinct: Sequence[str] = (),
    rank_col: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of each group in ``order``; with ``distinct``, at most one per such key.

    ``order`` must be total within a group (end it with a unique id) for a repeatable result.
    Both steps are ``row_number`` with a rank filter, so the group-limit operator prunes each
    input partition to its own best rows before the shuffle and again after it: a group holding
    a third of all rows sends at most ``n`` rows per task. The ``distinct`` step is keyed by group
    *and* item, which spreads a hot group over all tasks.

    Nulls: a null group is a group of its own; filter it out before if it should not count.
    A null item key never equals another, so such rows are all kept by the ``distinct`` step.
    Empty input gives an empty result; ``n`` below 1 is an error. Extra columns pass through; a
    column already named as ``rank_col`` is replaced.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows, tmp, alone = df.drop(rank_col), "__rank", "__alone"
    if distinct:
        null = F.expr(" OR ".join(f"`{c}` IS NULL" for c in distinct))
        rows = rows.withColumn(alone, F.when(null, F.monotonically_increasing_id()))  # a null equals none
        w = Window.partitionBy(*group, *distinct, alone).orderBy(*order)
        rows = rows.withColumn(tmp, F.row_number().over(w)).where(F.col(tmp) == 1).drop(tmp, alone)
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def best_results(results: DataFrame, n: int = 5) -> DataFrame:
    """Best ``n`` search results per session, one per content: session_id, result_id, rank.

    Rows without session id, or whose score is null, NaN or outside [0, 1], do not count.
    """
    score = F.col("combined_score")
    rows = results.where(score.isNotNull() & ~F.isnan(score) & (score >= 0) & (score <= 1)).select(
        canonical_id("session_id").alias("session_id"),
        canonical_id("content_id").alias("content_id"),
        "result_id",
        "combined_score",
        "ts",
    )
    order = [F.col("combined_score").desc(), F.col("ts").desc_nulls_last(), F.col("result_id").asc()]
    top = top_n_per_group(rows.where("session_id IS NOT NULL"), ["session_id"], order, n, ["content_id"])
    return top.select("session_id", "result_id", "rank")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_results(table(spark, sf_dir, "semantic_search_result")).select("session_id", "result_id")


CANON_SQL = "nullif(regexp_replace(regexp_replace(lower({0}), '^\\s*urn:uuid:', ''), '[^0-9a-f]+', '', 'g'), '')"

P3_SQL = f"""
WITH r AS (
  SELECT {CANON_SQL.format("session_id")} AS session_id, {CANON_SQL.format("content_id")} AS content_id,
         result_id, combined_score, ts
  FROM semantic_search_result
  WHERE combined_score IS NOT NULL AND NOT isnan(combined_score) AND combined_score BETWEEN 0 AND 1
), b AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, coalesce(content_id, 'row ' || result_id)
      ORDER BY combined_score DESC, ts DESC NULLS LAST, result_id) AS k
  FROM r WHERE session_id IS NOT NULL
), t AS (
  SELECT session_id, result_id, row_number() OVER (PARTITION BY session_id
      ORDER BY combined_score DESC, ts DESC NULLS LAST, result_id) AS n
  FROM b WHERE k = 1
)
SELECT session_id, result_id FROM t WHERE n <= 5
"""

QUERIES = {"p3_found": p3_found}
ORACLE = {"p3_found": P3_SQL}
