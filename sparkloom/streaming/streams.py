"""Streams of updates: counts, sessions by inactivity, per-session state, duplicates, new vectors.

A stream has at least update_id, session_id and ts. Late rows are dropped once the watermark has
passed them, except where a function says otherwise; the last mention of an entity is the greatest
time stamp, not the last arrival.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.lineage import shared_dir

LATE = "10 minutes"


def read(spark: SparkSession, folder: str, name: str, schema, files: int = 100) -> DataFrame:
    """Parquet files of one table as a stream; at most ``files`` in a micro-batch."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
    return source.option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def mention_counts(stream: DataFrame, late: str = LATE) -> DataFrame:
    """session_id, name, count, first and last mention of a stream with names ARRAY<STRING>."""
    names = stream.withWatermark("ts", late).select("session_id", "ts", F.explode("names").alias("name"))
    return names.groupBy("session_id", "name").agg(F.count("*").alias("n"), F.min("ts").alias("first_mentioned"), F.max("ts").alias("last_mentioned"))


def active_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Stretches of activity of each session that end after ``gap`` without an update."""
    w = stream.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def activity(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Updates per window, tumbling or (with ``slide``) sliding."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_duplicates(stream: DataFrame, key: str = "update_id", late: str = LATE) -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


STATE = "seq long, ring array<string>"
RING = "session_id string, seq long, update_id string, ring_size int, snapshot boolean"


def rings(stream: DataFrame, size: int = 50, every: int = 100) -> DataFrame:
    """Per session the running number of each update, the size of its ring of the newest ``size``, and
    whether a snapshot falls due. Within a micro-batch updates are taken by (ts, update_id). The
    state of a session is its counter and ``size`` ids, whatever the length of the session."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, ring = state.get if state.exists else (0, [])
        ring = list(ring)
        rows = pd.concat(list(batches)).sort_values(["ts", "update_id"], kind="stable")
        out = []
        for update_id in rows["update_id"]:
            seq += 1
            ring = [*ring, update_id][-size:]
            out.append((key[0], seq, update_id, len(ring), seq % every == 0))
        state.update((seq, ring))
        yield pd.DataFrame(out, columns=["session_id", "seq", "update_id", "ring_size", "snapshot"])

    return stream.select("session_id", "update_id", "ts").groupBy("session_id").applyInPandasWithState(step, RING, STATE, "append", GroupStateTimeout.NoTimeout)


def index_new(stream: DataFrame, seen: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that passes on only updates whose id is not in ``seen()`` yet."""

    def batch(df: DataFrame, number: int) -> None:
        known = seen().select(F.col("content_id").alias("update_id"))
        write(df.dropDuplicates(["update_id"]).join(known, "update_id", "left_anti"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a streaming DataFrame over all that is there and return its result as a table.

    ``complete`` keeps the last state of the whole result, ``append`` collects what is emitted. A
    micro-batch that is run again replaces what it wrote before."""
    spark, base = df.sparkSession, f"{shared_dir(df.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"

    def batch(out: DataFrame, number: int) -> None:
        out.write.mode("overwrite").parquet(f"{base}/table" if mode == "complete" else f"{base}/table/_batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/table").select(*df.columns)
