"""Cutting lineage with written tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, tuple[str, Callable[[], None]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which all executors see.

    Only where that is unset and everything runs on this machine (local masters, tests) a temporary
    folder is taken; a cluster without the setting is refused. The folder is removed at exit.
    """
    own, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if (kept := _folders.get(app)) and (not own or kept[0].startswith(own.rstrip("/"))):
        return kept[0]
    if own:
        path = f"{own.rstrip('/')}/sparkloom-{app}-{uuid.uuid4().hex[:8]}"
        _folders[app] = path, lambda: remove(spark, path)
    elif spark.sparkContext.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="sparkloom-")
        _folders[app] = path, lambda: shutil.rmtree(path, ignore_errors=True)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return path


@atexit.register
def _clean() -> None:
    for _, drop in _folders.values():
        try:
            drop()
        except Exception:  # the session may be gone, and its folder with it
            pass


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs a re-read."""
    return Scratch(df.sparkSession).keep(df, name)


class Scratch:
    """Written intermediates that can be removed together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        w = df.write.option("compression", "zstd")
        (w.partitionBy(by) if by else w).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, by: str, n: int) -> str:
        """The name of a table of ``df`` in ``n`` buckets, which joins on ``by`` read without a shuffle
        in every session of the application."""
        path, table = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}", f"sparkloom_{name}_{uuid.uuid4().hex}"
        self.paths.append(path)
        self.tables.append(table)
        df.write.bucketBy(n, by).sortBy(by).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table)
        return table

    def drop(self) -> None:
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.tables = []
        for p in self.paths:
            remove(self.spark, p)
        self.paths = []
