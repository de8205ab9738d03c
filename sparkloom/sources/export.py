"""Export documents: JSON with sessions, workspaces and embeddings; versioned and compressed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.lineage import exists
from sparkloom.sources.model import EMBEDDING, EXPORT_SESSION, FORMAT_VERSION, WORKSPACE, S, struct

#: What an export may hold beside sessions, each as JSON lines of its own.
PARTS = {"workspaces": WORKSPACE, "embeddings": EMBEDDING, "checkpoints": struct(checkpoint_id=S, session_id=S, update_id=S)}
#: Times are written to the microsecond.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CODECS = {".gz": "gzip", ".zst": "zstd"}


def codec(path: str, compression: str | None = None) -> str:
    """From the option, else from the file's extension, else none."""
    found = compression or next((c for end, c in CODECS.items() if path.endswith(end)), "none")
    if found not in ("none", "gzip", "zstd"):
        raise ValueError(f"unknown compression {found!r}")
    return found


def compatible(version: str, current: str = FORMAT_VERSION) -> bool:
    """Same major version, minor version not newer than ours."""
    try:
        (a, b), (x, y) = ([int(p) for p in v.split(".")[:2]] for v in (version, current))
    except ValueError:
        return False
    return a == x and b <= y


def session_documents(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """session_id and a JSON text per session with its updates in order; the parts of a document.

    One session is one row; sessions are never gathered into one task."""
    content = F.struct("title", "description", "details", "examples", "implications").alias("content")
    u = F.struct(F.col("update_id").alias("id"), "ts", "update_type", content, "related_code", "parent_update", F.col("important").alias("user_marked_important"), "creates_entities", "creates_relationships", "references_entities")
    per = updates.select("session_id", u.alias("u")).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(F.col("u.ts").alias("at"), F.col("u.id").alias("id"), "u"))).alias("us"))
    out = sessions.join(per, "session_id", "left").withColumn("updates", F.coalesce(F.transform("us", lambda x: x["u"]), F.from_json(F.lit("[]"), EXPORT_SESSION["updates"].dataType)))
    return out.select("session_id", F.to_json(F.struct("session_id", "name", "description", "created_at", "last_updated", "updates"), TIMES).alias("document"))


def write_export(sessions: DataFrame, updates: DataFrame, path: str, kind: str = "full", compression: str | None = None, exported_at: datetime | None = None, parts: dict[str, DataFrame] | None = None) -> None:
    """A folder of JSON lines: ``sessions`` (one line each), ``metadata`` with version and counts, and
    the PARTS given, of which the columns they have of their schema are written."""
    c = codec(path, compression)
    for name, df in (parts or {}).items():
        keep = [f for f in PARTS[name].names if f in df.columns]
        df.select(F.to_json(F.struct(*keep), TIMES).alias("value")).write.mode("overwrite").option("compression", c).text(f"{path}/{name}")
    docs = session_documents(sessions, updates)
    docs.select(F.col("document").alias("value")).write.mode("overwrite").option("compression", c).text(f"{path}/sessions")
    at = F.lit(exported_at) if exported_at else F.current_timestamp()
    both = sessions.select(F.lit(1).alias("s"), F.lit(0).alias("u")).unionAll(updates.select(F.lit(0), F.lit(1)))
    n = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("session_count"), F.coalesce(F.sum("u"), F.lit(0)).alias("update_count"))
    meta = n.select(F.to_json(F.struct(F.lit(FORMAT_VERSION).alias("format_version"), F.lit(kind).alias("export_type"), at.alias("exported_at"), "session_count", "update_count")).alias("value"))
    meta.coalesce(1).write.mode("overwrite").option("compression", c).text(f"{path}/metadata")


def preview(spark: SparkSession, path: str) -> dict:
    """Metadata of an export; ValueError if its version cannot be read."""
    meta = spark.read.schema("format_version string, export_type string, exported_at string, session_count long, update_count long").json(f"{path}/metadata").head().asDict()
    if not compatible(meta["format_version"] or ""):
        raise ValueError(f"version {meta['format_version']} cannot be read")
    return meta


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of an export with their updates; the schema is given, never inferred."""
    preview(spark, path)
    return spark.read.schema(EXPORT_SESSION).json(f"{path}/sessions")


def read_part(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Workspaces, embeddings or checkpoints of an export; empty if it has none."""
    preview(spark, path)
    if not exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], PARTS[name])
    return spark.read.schema(PARTS[name]).json(f"{path}/{name}")


def list_sessions(exported: DataFrame) -> DataFrame:
    return exported.select("session_id", F.coalesce("name", F.lit("Unnamed")).alias("name"), F.greatest(F.size("updates"), F.lit(0)).alias("updates"))


def merge(incoming: DataFrame, stored: DataFrame, conflict: str = "skip", only: list[str] | None = None, key: str = "session_id") -> DataFrame:
    """Rows to write and what was decided: key, action (new, replaced, skipped, conflict).

    ``skip`` keeps what is stored, ``overwrite`` replaces it, ``error`` reports it."""
    if conflict not in ("skip", "overwrite", "error"):
        raise ValueError(f"unknown conflict rule {conflict!r}")
    rows = incoming if only is None else incoming.where(F.col(key).isin(only))
    known = stored.select(F.col(key), F.lit(True).alias("__known")).distinct()
    action = {"skip": "skipped", "overwrite": "replaced", "error": "conflict"}[conflict]
    return rows.join(known, key, "left").withColumn("action", F.when(F.col("__known"), action).otherwise("new")).drop("__known")
