"""Structured summaries of sessions: counts, levels, insights, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import levels
from sparkloom.functions.scoring import whole_days
from sparkloom.operators import context

#: Tokens per item in the estimate of a summary's size, and where compact begins.
BASE_TOKENS, DECISION, ENTITY, QUESTION, CONCEPT, COMPACT_ABOVE = 500, 150, 80, 100, 120, 50_000


def session_stats(sessions: DataFrame, updates: DataFrame, mentions: DataFrame, hot: int = 50) -> DataFrame:
    """Counts per session with duration and activity levels and the estimated size of its summary."""
    kind = lambda name: F.count(F.when(F.col("update_type") == name, 1))
    per = updates.groupBy("session_id").agg(
        F.count("*").alias("updates"),
        kind("DecisionMade").alias("decisions"),
        kind("QuestionAnswered").alias("questions"),
        kind("ConceptDefined").alias("concepts"),
        F.count("related_code").alias("code_references"),
    )
    names = mentions.groupBy("session_id").agg(F.countDistinct("name").alias("entities"))
    counts = ["updates", "decisions", "questions", "concepts", "code_references", "entities"]
    out = sessions.join(per, "session_id", "left").join(names, "session_id", "left").na.fill(0, counts)
    out = out.withColumn("hot", F.least("updates", F.lit(hot))).withColumn("concepts", F.least("concepts", F.lit(50)))
    hours = F.timestamp_diff("HOUR", F.col("created_at"), F.col("last_updated"))
    tokens = BASE_TOKENS + DECISION * F.col("decisions") + ENTITY * F.col("entities") + QUESTION * F.col("questions") + CONCEPT * F.col("concepts")
    return out.select(
        "session_id", "hot", *counts,
        levels.duration(hours).alias("duration"),
        levels.activity(F.col("updates"), hours).alias("activity"),
        tokens.alias("summary_tokens"),
        (tokens > COMPACT_ABOVE).alias("compact"),
    )


def key_decisions(updates: DataFrame, least: float = 0.0, limit: int | None = None) -> DataFrame:
    """Decisions of each session by confidence, newest first."""
    d = context.decisions(updates).where(F.col("confidence") >= least).withColumn("level", levels.confidence(F.col("confidence")))
    if limit is None:
        return d
    w = Window.partitionBy("session_id").orderBy(F.col("confidence").desc(), F.col("ts").desc_nulls_last(), "update_id")
    return d.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)


def timeline(updates: DataFrame) -> DataFrame:
    """Decisions of each session in the order they were made."""
    w = Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_first(), "update_id")
    return context.decisions(updates).withColumn("nth", F.row_number().over(w))


def question_levels(updates: DataFrame, now: Column) -> DataFrame:
    days = whole_days(F.col("ts"), now)
    return context.questions(updates).select("session_id", "update_id", "status", days.alias("days_open"), levels.urgency(F.col("status"), days).alias("urgency"))


def concept_levels(updates: DataFrame) -> DataFrame:
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0))
    return context.concepts(updates).select("session_id", "update_id", "name", levels.complexity(size("examples"), size("related")).alias("complexity"))


def entity_levels(importance: DataFrame, now: Column) -> DataFrame:
    """Adds importance and recency levels to an importance analysis."""
    days = whole_days(F.col("last_mentioned"), now)
    return importance.withColumns({"importance_level": levels.importance(F.col("score")), "recency_level": levels.recency(days)})


def insights(updates: DataFrame, importance: DataFrame, limit: int = 10) -> DataFrame:
    """session_id, nth, insight: confident decisions, main entities, many updates, several files."""
    sure = context.decisions(updates).where("confidence > 0.8")
    sure = sure.select("session_id", F.lit(1).alias("part"), F.struct("ts", "update_id").alias("at"), F.concat(F.lit("High-confidence decision: "), F.coalesce("description", F.lit(""))).alias("insight"))
    w = Window.partitionBy("session_id").orderBy(F.col("importance").desc(), "name")
    top = importance.withColumn("n", F.row_number().over(w)).where("n <= 3").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("names"))
    none = F.struct(F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("update_id")).alias("at")
    top = top.select("session_id", F.lit(2).alias("part"), none, F.concat(F.lit("Primary focus areas: "), F.array_join("names.name", ", ")).alias("insight"))
    per = updates.groupBy("session_id").agg(F.count("*").alias("n"), F.countDistinct("related_code.file_path").alias("files"))
    many = per.where("n > 10").select("session_id", F.lit(3).alias("part"), none, F.format_string("Comprehensive discussion with %d updates", "n").alias("insight"))
    files = per.where("files > 1").select("session_id", F.lit(4).alias("part"), none, F.format_string("Multi-file code analysis covering %d files", "files").alias("insight"))
    out = sure.unionByName(top).unionByName(many).unionByName(files)
    w = Window.partitionBy("session_id").orderBy("part", F.col("at.ts").asc_nulls_first(), "at.update_id")
    return out.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).select("session_id", "nth", "insight")


def listing(sessions: DataFrame, updates: DataFrame, mentions: DataFrame) -> DataFrame:
    """session_id, name (or Unnamed), updates, entities."""
    u = updates.groupBy("session_id").agg(F.count("*").alias("updates"))
    e = mentions.groupBy("session_id").agg(F.countDistinct("name").alias("entities"))
    out = sessions.join(u, "session_id", "left").join(e, "session_id", "left").na.fill(0, ["updates", "entities"])
    return out.select("session_id", F.coalesce("name", F.lit("Unnamed")).alias("name"), "updates", "entities")


def by_file(updates: DataFrame) -> DataFrame:
    """Code references by file: how many, over which lines, newest."""
    return context.code_references(updates).groupBy("file_path").agg(
        F.count("*").alias("n"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.max("ts").alias("newest"), F.countDistinct("session_id").alias("sessions")
    )


def vector_counts(store: DataFrame) -> DataFrame:
    """Per session: whether and how many contents are stored, entity descriptions aside."""
    n = F.count(F.when(F.coalesce(F.col("content_type"), F.lit("")) != "EntityDescription", 1))
    return store.groupBy("session_id").agg(n.alias("n")).withColumn("has_vectors", F.col("n") > 0)


def operation_metrics(log: DataFrame) -> DataFrame:
    """Per operation of a log (operation, ms, ok): counts, times, error rate and whether it is a problem."""
    m = log.groupBy("operation").agg(
        F.count("*").alias("n"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.round(F.avg("ms"), 6).alias("avg_ms"), F.round(F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0)), 6).alias("error_rate")
    )
    return m.withColumn("problem", (F.col("error_rate") > 0.1) | (F.col("avg_ms") > 2000) | (F.col("max_ms") > 30000))


def cache_metrics(log: DataFrame) -> DataFrame:
    """Per cache of a log (cache, hit, ms): hit rate, and an issue if under 0.3 after 100 requests or over 1 ms on average."""
    m = log.groupBy("cache").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg("ms"), 6).alias("avg_ms"))
    return m.withColumn("issue", ((F.col("n") >= 100) & (F.col("hit_rate") < 0.3)) | (F.col("avg_ms") > 1))


def summary(sessions: DataFrame, updates: DataFrame, mentions: DataFrame, importance: DataFrame, sections: tuple[str, ...] = ("stats", "decisions", "questions", "concepts", "entities", "insights", "timeline")) -> dict[str, DataFrame]:
    """The sections asked for, each a DataFrame over all sessions given."""
    made = {
        "stats": lambda: session_stats(sessions, updates, mentions),
        "decisions": lambda: key_decisions(updates, limit=20),
        "questions": lambda: context.questions(updates),
        "concepts": lambda: concept_levels(updates),
        "entities": lambda: importance,
        "insights": lambda: insights(updates, importance),
        "timeline": lambda: timeline(updates),
    }
    return {s: made[s]() for s in sections}
