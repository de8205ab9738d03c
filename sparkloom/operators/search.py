"""Vector search with scopes, scores and what is derived from results.

Query vectors are few and their number is checked; they are literals in the plan or a broadcast
side, so that a search is one scan of the store with a partial top-k in every task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import scoring, text, validate
from sparkloom.functions import vectors as V

#: Query vectors of one call; beyond that use an index (``operators.ann``).
MAX_QUERIES = 4096


def vector_literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def in_workspace(df: DataFrame, workspace_sessions: DataFrame, workspace_id: str) -> DataFrame:
    own = workspace_sessions.where(F.col("workspace_id") == workspace_id).select("session_id")
    return df.join(own, "session_id", "left_semi")


def scoped(store: DataFrame, scope: str = "global", session_id: str | None = None, workspace: DataFrame | None = None, workspace_id: str | None = None) -> DataFrame:
    validate.choice(scope, validate.SCOPES, "scope")
    if scope == "session":
        return store.where(F.col("session_id") == validate.uuid_arg(session_id or ""))
    if scope == "workspace":
        if workspace is None:
            raise ValueError("a workspace search needs the workspace table")
        return in_workspace(store, workspace, validate.uuid_arg(workspace_id or "", "workspace_id"))
    return store


def scored(hits: DataFrame, now: datetime | Column | None = None, bias: float = 0.0, adjusters: Iterable[scoring.Adjuster] = ()) -> DataFrame:
    """Adds importance, score (0.7 similarity + 0.3 importance, decayed) and quality."""
    weight = scoring.importance(F.col("content_type"))
    chain = list(adjusters)
    if now is not None and validate.recency_arg(bias):
        chain.insert(0, scoring.recency(F.col("ts"), now if isinstance(now, Column) else F.lit(now), bias))
    score = scoring.compose(chain)(scoring.combined(F.col("similarity"), weight))
    return hits.withColumns({"importance": weight, "score": score, "quality": scoring.quality(F.col("similarity"))})


def best_per_content(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("content_id").orderBy(F.col("score").desc(), F.col("ts").desc_nulls_last())
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best, ties by content id."""
    return hits.orderBy(F.col("score").desc(), "content_id").limit(validate.limit_arg(limit))


def semantic_search(
    store: DataFrame,
    query: Sequence[float],
    limit: int = 10,
    *,
    date_range: tuple[datetime, datetime] | None = None,
    content_types: Sequence[str] = (),
    least: float | None = None,
    quality: str | None = None,
    now: datetime | None = None,
    bias: float = 0.0,
    adjusters: Iterable[scoring.Adjuster] = (),
    repeats: bool = False,
) -> DataFrame:
    """The best contents of ``store`` for one query vector; all filters come before the ranking.

    One scan with a partial top-k in every task, nothing is shuffled. Only if contents ``repeats`` in
    the store (it has one row per content otherwise) are scored rows brought together by content."""
    rows = store
    if date_range is not None:
        start, end = validate.date_range(*date_range)
        rows = rows.where(F.col("ts").between(F.lit(start), F.lit(end)))
    if content_types:
        rows = rows.where(scoring.content_type(F.col("content_type")).isin(*content_types))
    hits = rows.withColumn("similarity", F.round(V.cosine_to("vector", query), 6)).drop("vector")
    if least is not None:
        hits = hits.where(F.col("similarity") >= least)
    if quality is not None:
        hits = hits.where(scoring.meets_quality(F.col("similarity"), quality))
    hits = scored(hits, now, bias, adjusters)
    return ranked(best_per_content(hits) if repeats else hits, limit)


def batch_search(store: DataFrame, queries: DataFrame, k: int = 10, least: float = -1.0) -> DataFrame:
    """query_id, content_id, similarity, rank: exact top k for a set of query vectors.

    ``queries`` (query_id, vector) is sent to all tasks; more than MAX_QUERIES rows are refused.
    Similarities of a block of stored vectors with all queries are one matrix product; each block
    passes on at most k rows per query (and ties), of which each task keeps k before the shuffle.
    """
    rows = queries.select("query_id", "vector").limit(MAX_QUERIES + 1).toArrow()
    if rows.num_rows > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} query vectors")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, content_id string, similarity double"
    if not rows.num_rows:
        return store.sparkSession.createDataFrame([], schema + ", rank int")
    ids = rows.column("query_id").combine_chunks()
    q = np.array(rows.column("vector").to_pylist(), np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    sent, width = store.sparkSession.sparkContext.broadcast((ids, q)), q.shape[1]

    def run(batches):
        ids, q = sent.value
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            s = q @ np.where(n > 0, v / np.where(n > 0, n, 1), 0).T
            kept = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(q), 1))
            edge = np.take_along_axis(s, kept, 1).min(axis=1, keepdims=True)
            qi, xi = np.nonzero((s >= edge - 1e-9) & (s >= least - 1e-9))  # ties at the edge stay, ids decide later
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(qi)), b.column(0).take(pa.array(xi)), pa.array(s[qi, xi].round(6))], names=["query_id", "content_id", "similarity"])

    ok = store.where(V.has_dimension("vector", width)).select("content_id", "vector")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "content_id")
    hits = ok.mapInArrow(run, schema).where(F.col("similarity") >= least)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_clamped(store: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``batch_search`` with similarity 1 - min(distance, 1): never negative."""
    return batch_search(store, queries, k).withColumn("similarity", F.greatest("similarity", F.lit(0.0)))


def text_similarity(a: Column | str, b: Column | str) -> Column:
    """How alike two texts are, by the cosine of their vectors."""
    return V.cosine(a, b)


def page(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows of one page in a total order: a top-k in every task, never the whole table sorted."""
    return df.orderBy(*order).limit(offset + limit).offset(offset)


def sessions_like(store: DataFrame, probes: DataFrame, limit: int = 10, k: int = 10) -> DataFrame:
    """Sessions by the average similarity of what a few probe vectors (query_id, vector) find in them."""
    hits = batch_search(store, probes, k).join(store.select("content_id", "session_id"), "content_id")
    return similar_sessions(hits, limit, "similarity")


def related_content(store: DataFrame, query: Sequence[float], session_id: str, limit: int = 5, **options) -> DataFrame:
    """The best contents of other sessions."""
    return semantic_search(store.where(F.coalesce(F.col("session_id") != session_id, F.lit(True))), query, limit, **options)


def related_experiences(store: DataFrame, query: Sequence[float], session_id: str, least: float = 0.7, limit: int = 10) -> DataFrame:
    hits = related_content(store, query, session_id, min(limit, 10), least=least)
    return hits.withColumn("snippet", text.snippet(F.col("text")))


def themes(results: DataFrame, n: int = 10) -> DataFrame:
    """theme, count: the first words of result texts, most frequent first."""
    t = results.select(text.theme(F.col("text")).alias("theme")).where("theme <> ''")
    return t.groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "theme").limit(n)


def confidence(primary: DataFrame, related: DataFrame) -> DataFrame:
    """min(1, 0.7 average of primary + 0.3 average of related similarities); empty averages are 0."""
    both = primary.select("similarity", F.lit(True).alias("own")).unionByName(related.select("similarity", F.lit(False).alias("own")))
    mean = lambda own: F.coalesce(F.avg(F.when(F.col("own") == own, F.col("similarity"))), F.lit(0.0))
    return both.agg(F.round(F.least(F.lit(1.0), mean(True) * 0.7 + mean(False) * 0.3), 6).alias("confidence"))


def similar_sessions(results: DataFrame, limit: int = 10, similarity: str = "similarity_score") -> DataFrame:
    """Sessions by the average similarity of their results."""
    s = F.col(similarity).cast("double")
    ok = results.where(F.col("session_id").isNotNull() & s.isNotNull() & ~F.isnan(s))
    per = ok.groupBy("session_id").agg(F.round(F.avg(s), 6).alias("similarity"), F.count("*").alias("n"))
    return per.orderBy(F.col("similarity").desc(), "session_id").limit(limit)


def patterns(results: DataFrame) -> DataFrame:
    """content_type, n, strength of what results have in common: strong above 3, clear above 2, weak above 1."""
    n = results.groupBy(scoring.content_type(F.col("content_type")).alias("content_type")).agg(F.count("*").alias("n"))
    return n.where("n > 1").withColumn("strength", F.when(F.col("n") > 3, "strong").when(F.col("n") > 2, "clear").otherwise("weak"))


def restore_context(store: DataFrame, query: Sequence[float], session_id: str, **options) -> dict[str, DataFrame]:
    """What a session needs to go on: its own results, related ones, themes and a confidence."""
    own = semantic_search(scoped(store, "session", session_id), query, 10, **options)
    related = related_experiences(store, query, session_id)
    return {"results": own, "related": related, "themes": themes(own), "confidence": confidence(own, related)}


def formatted(hits: DataFrame) -> DataFrame:
    """Results under their short names: content, score, session_id, type, timestamp, rank."""
    w = Window.orderBy(F.col("score").desc(), "content_id")  # a ranked result has a handful of rows
    return hits.select(
        F.col("text").alias("content"), F.round("score", 7).alias("score"), "session_id", scoring.content_type(F.col("content_type")).alias("type"), F.col("ts").alias("timestamp"), F.row_number().over(w).alias("rank")
    )


def explained(results: DataFrame) -> DataFrame:
    """result_id and how its combined score came about."""
    score, similarity, weight = (F.col(c).cast("double") for c in ("combined_score", "similarity_score", "importance_score"))
    return results.select("result_id", scoring.explanation(score, similarity, weight).alias("explanation"))
