"""What the training-data operators share: canonical ids, table access, durable intermediates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.lineage import Scratch, durable, exists, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: ``canonical_id`` of a column in the SQL twins.
CANON = "nullif(regexp_replace(regexp_replace(lower({0}), '^\\s*urn:uuid:', ''), '[^0-9a-f]+', '', 'g'), '')"


def canonical_id(col: Column | str) -> Column:
    """Blanks at both ends off, lower case, leading ``urn:uuid:`` off, only hex digits kept.

    Null stays null; an id without any hex digit becomes null, since it identifies nothing.
    """
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.lower(c), r"^[\s\p{Z}\x{85}\x{1c}-\x{1f}]*urn:uuid:", "")
    return F.nullif(F.regexp_replace(bare, "[^0-9a-f]+", ""), F.lit(""))


#: Bits of the set of keys that ``rows_in`` sends to all tasks: 8 MB, whatever the data.
KEY_BITS = 26


def rows_in(rows: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose ``keys`` are in ``chosen``, and a few others (join exactly afterwards).

    Hashes of the chosen keys are set in a bit set of fixed size, so that the payload of other rows
    is dropped where it is read instead of being shuffled. At most 2**20 words reach the driver.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(1 << KEY_BITS)).alias("slot")
    words = chosen.select(slot).selectExpr("cast(slot div 64 as int) AS word", "shiftleft(1L, cast(slot % 64 as int)) AS bit")
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (KEY_BITS - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(bits.view(np.uint64))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(len(names)).to_numpy(zero_copy_only=False)
            hit = (sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield b.select(names).filter(pa.array(hit.astype(bool)))

    return rows.withColumn("__slot", slot).mapInArrow(run, rows.schema)
