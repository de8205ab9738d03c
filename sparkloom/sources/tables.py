"""The model's tables, read from the raw export tables of a folder.

Raw exports repeat sessions and updates; of each id the row of the latest batch counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.ids import canonical_id


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, name, description, created_at, last_updated of the latest row of each session."""
    s = raw(spark, folder, "exported_session").select(
        canonical_id("session_id").alias("session_id"), "name", "description", "created_at", "last_updated", "batch_no", "row_id"
    )
    return latest(s.where("session_id IS NOT NULL"), ["session_id"], ["batch_no", "row_id"]).drop("batch_no", "row_id")


def updates(spark: SparkSession, folder: str) -> DataFrame:
    """One row per update id, flattened: the last delivery of each."""
    u = raw(spark, folder, "exported_session").select("batch_no", "row_id", canonical_id("session_id").alias("session_id"), F.posexplode("updates").alias("item_no", "u"))
    u = u.select(
        "session_id",
        canonical_id("u.id").alias("update_id"),
        F.col("u.ts").alias("ts"),
        F.col("u.update_type").alias("update_type"),
        *(F.col(f"u.content.{c}").alias(c) for c in ("title", "description", "details", "examples", "implications")),
        F.col("u.related_code").alias("related_code"),
        canonical_id("u.parent_update").alias("parent_update"),
        F.col("u.user_marked_important").alias("important"),
        F.col("u.creates_entities").alias("creates_entities"),
        F.col("u.creates_relationships").alias("creates_relationships"),
        F.col("u.references_entities").alias("references_entities"),
        "batch_no",
        "row_id",
        "item_no",
    )
    return latest(u.where("session_id IS NOT NULL AND update_id IS NOT NULL"), ["update_id"], ["batch_no", "row_id", "item_no"]).drop("batch_no", "row_id", "item_no")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The store: one row per content id with a valid vector; the latest time stamp counts."""
    e = raw(spark, folder, "stored_embedding").select(
        canonical_id("content_id").alias("content_id"), canonical_id("session_id").alias("session_id"), "vector", "text", "content_type", "ts"
    )
    ok = F.expr("size(vector) = 128 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30) AND exists(vector, x -> x <> 0)")
    e = e.where("content_id IS NOT NULL").where(ok).withColumn("text_key", F.coalesce("text", F.lit("")))
    return latest(e, ["content_id"], ["ts", "session_id", "text_key"]).drop("text_key")


def workspace_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """workspace_id, session_id, role; a session repeated in a workspace counts once, with the first role by name."""
    w = raw(spark, folder, "exported_workspace").select(canonical_id("id").alias("workspace_id"), F.explode("sessions").alias("s"))
    w = w.select("workspace_id", canonical_id("s.session_id").alias("session_id"), F.col("s.role").alias("role"))
    return w.where("workspace_id IS NOT NULL AND session_id IS NOT NULL").groupBy("workspace_id", "session_id").agg(F.min("role").alias("role"))


def results(spark: SparkSession, folder: str) -> DataFrame:
    r = raw(spark, folder, "semantic_search_result")
    return r.withColumn("content_id", canonical_id("content_id")).withColumn("session_id", canonical_id("session_id"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, src, dst, relation: unique edges that updates create."""
    e = updates(spark, folder).select("session_id", F.explode("creates_relationships").alias("r"))
    e = e.select("session_id", F.col("r.from_entity").alias("src"), F.col("r.to_entity").alias("dst"), F.col("r.relation_type").alias("relation"))
    return e.where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, name, update_id, ts: one row per entity named by an update, created or referenced."""
    names = F.array_distinct(F.concat(F.coalesce("creates_entities", F.array().cast("array<string>")), F.coalesce("references_entities", F.array().cast("array<string>"))))
    m = updates(spark, folder).select("session_id", "update_id", "ts", "update_type", F.explode(names).alias("name"))
    return m.where("name IS NOT NULL")


#: The same tables for the SQL twins.
CANON = "nullif(regexp_replace(regexp_replace(lower({0}), '^\\s*urn:uuid:', ''), '[^0-9a-f]+', '', 'g'), '')"
SQL = {
    "session": f"""session AS (SELECT session_id, name, description, created_at, last_updated FROM (
      SELECT {CANON.format("session_id")} AS session_id, name, description, created_at, last_updated,
        row_number() OVER (PARTITION BY {CANON.format("session_id")} ORDER BY batch_no DESC NULLS LAST, row_id DESC) AS n
      FROM exported_session) WHERE n = 1 AND session_id IS NOT NULL)""",
    "upd": f"""upd AS (SELECT * EXCLUDE (n) FROM (
      SELECT session_id, {CANON.format("u.id")} AS update_id, u.ts AS ts, u.update_type AS update_type, u.content.title AS title,
        u.content.description AS description, u.content.details AS details, u.content.examples AS examples,
        u.content.implications AS implications, u.related_code AS related_code, {CANON.format("u.parent_update")} AS parent_update,
        u.user_marked_important AS important, u.creates_entities AS creates_entities,
        u.creates_relationships AS creates_relationships, u.references_entities AS references_entities,
        row_number() OVER (PARTITION BY {CANON.format("u.id")} ORDER BY batch_no DESC NULLS LAST, row_id DESC, item_no DESC) AS n
      FROM (SELECT batch_no, row_id, {CANON.format("session_id")} AS session_id, unnest(updates) AS u,
              generate_subscripts(updates, 1) AS item_no FROM exported_session)
      WHERE session_id IS NOT NULL AND {CANON.format("u.id")} IS NOT NULL) WHERE n = 1)""",
    "emb": f"""emb AS (SELECT * EXCLUDE (n) FROM (
      SELECT {CANON.format("content_id")} AS content_id, {CANON.format("session_id")} AS session_id, vector, text, content_type, ts,
        row_number() OVER (PARTITION BY {CANON.format("content_id")}
          ORDER BY ts DESC NULLS LAST, {CANON.format("session_id")} DESC NULLS LAST, coalesce(text, '') DESC) AS n
      FROM stored_embedding WHERE len(vector) = 128 AND {CANON.format("content_id")} IS NOT NULL
        AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR abs(x) >= 1e30)) = 0
        AND len(list_filter(vector, lambda x: x <> 0)) > 0) WHERE n = 1)""",
    "ws": f"""ws AS (SELECT workspace_id, session_id, min(role) AS role FROM (
      SELECT workspace_id, {CANON.format("s.session_id")} AS session_id, s.role AS role FROM (
        SELECT {CANON.format("id")} AS workspace_id, unnest(sessions) AS s FROM exported_workspace))
      WHERE workspace_id IS NOT NULL AND session_id IS NOT NULL GROUP BY 1, 2)""",
    "res": f"""res AS (SELECT * REPLACE ({CANON.format("content_id")} AS content_id, {CANON.format("session_id")} AS session_id)
      FROM semantic_search_result)""",
    "edge": """edge AS (SELECT DISTINCT session_id, r.from_entity AS src, r.to_entity AS dst, r.relation_type AS relation
      FROM (SELECT session_id, unnest(creates_relationships) AS r FROM upd)
      WHERE r.from_entity IS NOT NULL AND r.to_entity IS NOT NULL)""",
    "mention": """mention AS (SELECT session_id, update_id, ts, update_type, name FROM (
      SELECT session_id, update_id, ts, update_type,
        unnest(list_distinct(coalesce(creates_entities, []) || coalesce(references_entities, []))) AS name FROM upd)
      WHERE name IS NOT NULL)""",
}


def with_tables(names: str, body: str) -> str:
    """``body`` behind the common table expressions named (in order of use)."""
    return f"WITH {', '.join(SQL[n] for n in names.split())} {body}"
