"""A store of the model's tables as Parquet files: append, latest per key, rewrite by partition."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.validate import ROLES, choice
from sparkloom.sources import model

#: Keys of each table; of equal keys the row written last counts.
KEYS = {
    "session": ["session_id"],
    "update": ["session_id", "update_id"],
    "entity": ["session_id", "name"],
    "edge": ["session_id", "src", "dst", "relation"],
    "embedding": ["content_id"],
    "workspace": ["workspace_id"],
    "workspace_session": ["workspace_id", "session_id"],
    "checkpoint": ["checkpoint_id", "update_id"],
}
#: Partitions of a new table by hash of its first key, so that a lookup reads one of them.
BUCKETS = 16


class Store:
    """Tables in a folder. Writing appends; reading keeps the last version of each key; deleting
    appends a mark; ``compact`` rewrites a table without old versions and marks.

    A version is the writer's clock in nanoseconds and a random number, so that of two writers at
    the same time one wins, the same for every reader. A table lies in a folder that is named by
    generation and number of partitions; the newest complete one is read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generations(self, table: str) -> list[tuple[int, int, str]]:
        """(number, partitions, folder) of the complete generations, oldest first."""
        if table not in KEYS:
            raise ValueError(f"no table {table!r}")
        p, fs = self._fs(f"{self.path}/{table}")
        if not fs.exists(p):
            return []
        folders = [f.getPath() for f in fs.listStatus(p)]
        done = [str(f.toString()) for f in folders if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
        return sorted((int(f.rsplit("-", 2)[1]), int(f.rsplit("-", 1)[1]), f) for f in done)

    def _exists(self, table: str) -> bool:
        return bool(self._generations(table))

    def _append(self, table: str, df: DataFrame, dead: bool, to: tuple[int, int, str] | None = None) -> None:
        have = self._generations(table)
        _, n, folder = to or (have[-1] if have else (0, self.buckets, f"{self.path}/{table}/generation-0-{self.buckets}"))
        by = F.pmod(F.xxhash64(KEYS[table][0]), F.lit(n)).cast("int")
        marks = {"_version": F.lit(time.time_ns()), "_writer": F.lit(uuid.uuid4().int >> 65), "_dead": F.lit(dead), "_bucket": by}
        df.withColumns(marks).write.mode("append").partitionBy("_bucket").parquet(folder)

    def write(self, table: str, df: DataFrame) -> None:
        """Append; of equal keys what is written last counts."""
        self._append(table, df, False)

    def delete(self, table: str, keys: DataFrame) -> None:
        """Delete the rows with these keys (a prefix of the table's keys is enough). With a session
        go its updates, entities, edges and places in workspaces."""
        on = [c for c in KEYS[table] if c in keys.columns]
        gone = self.read(table).join(keys.select(*on).distinct(), on, "left_semi").select(*KEYS[table])
        self._append(table, gone, True)
        if table == "session":
            for t in ("update", "entity", "edge", "workspace_session"):
                if self._exists(t):
                    lost = self.read(t).join(keys.select("session_id").distinct(), "session_id", "left_semi").select(*KEYS[t])
                    self._append(t, lost, True)

    def read(self, table: str, **where: str) -> DataFrame:
        """The last version of each key, then the rows that equal ``where``; equalities on keys are
        looked for before versions are compared, one on the first key in one partition only."""
        if not (have := self._generations(table)):
            raise ValueError(f"table {table!r} is empty")
        _, n, folder = have[-1]
        rows = self.spark.read.option("mergeSchema", "true").parquet(folder)
        for c, v in where.items():
            if c in KEYS[table]:
                rows = rows.where(F.col(c) == v)
            if c == KEYS[table][0]:
                rows = rows.where(F.col("_bucket") == F.pmod(F.xxhash64(F.lit(v)), F.lit(n)))
        w = Window.partitionBy(*KEYS[table]).orderBy(F.col("_version").desc(), F.col("_writer").desc())
        rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1 AND NOT _dead")
        for c, v in where.items():
            rows = rows.where(F.col(c) == v)
        return rows.drop("_n", "_version", "_writer", "_dead", "_bucket")

    def exists(self, table: str, **where: str) -> bool:
        return self._exists(table) and not self.read(table, **where).limit(1).isEmpty()

    def compact(self, table: str, buckets: int | None = None) -> None:
        """Rewrite as a new generation without old versions and marks, with another number of
        partitions if asked for. Readers take the new one once it is complete; the old ones go after
        that. Not to be run beside writers of the same table."""
        have = self._generations(table)
        number, n, _ = have[-1]
        n = buckets or n
        self._append(table, self.read(table), False, (number + 1, n, f"{self.path}/{table}/generation-{number + 1}-{n}"))
        for _, _, folder in have:
            p, fs = self._fs(folder)
            fs.delete(p, True)

    def stats(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in KEYS if self._exists(t)}

    def checkpoint(self, checkpoint_id: str, session_id: str) -> None:
        """A copy of a session's updates under an id."""
        rows = self.read("update", session_id=session_id)
        self.write("checkpoint", rows.withColumn("checkpoint_id", F.lit(checkpoint_id)))

    def restore(self, checkpoint_id: str) -> None:
        """Put a checkpoint's updates back, whatever happened to them since."""
        self.write("update", self.read("checkpoint", checkpoint_id=checkpoint_id).drop("checkpoint_id"))

    def checkpoints(self) -> DataFrame:
        """checkpoint_id, session_id, updates of all checkpoints."""
        return self.read("checkpoint").groupBy("checkpoint_id", "session_id").agg(F.count("*").alias("updates"))

    def remove_from_workspace(self, workspace_id: str, session_id: str) -> None:
        self.delete("workspace_session", self.spark.createDataFrame([(workspace_id, session_id)], "workspace_id string, session_id string"))

    def delete_workspace(self, workspace_id: str) -> None:
        """The workspace and its list of sessions; the sessions stay."""
        key = self.spark.createDataFrame([(workspace_id,)], "workspace_id string")
        for t in ("workspace", "workspace_session"):
            if self._exists(t):
                self.delete(t, key)

    def add_to_workspace(self, workspace_id: str, session_id: str, role: str = "related") -> None:
        choice(role, ROLES, "role")
        self.write("workspace_session", self.spark.createDataFrame([(workspace_id, session_id, role)], "workspace_id string, session_id string, role string"))

    def copy_to(self, other: Store, dry_run: bool = False) -> dict[str, int]:
        """Copy all tables to another store; returns the rows of each."""
        done = self.stats()
        if not dry_run:
            for t in done:
                other.write(t, self.read(t))
        return done


def embedding_schema() -> T.StructType:
    return model.EMBEDDING
