"""A global order of triples, rare ones first, from a count sketch over all texts.

Exact counts of all triples would have to be shuffled and joined back to every posting. Any total
order keeps prefix and segment filters lossless; rarity only makes them selective. So triples are
counted, over the whole corpus, in ``SLOTS`` shared counters of fixed size (4 MB as sent to the
driver and broadcast, whatever the corpus), kept on a logarithmic scale.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.triples import slices, triple_sets

SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
BLOCKS = 64
STEP = 1.09  # counts within 9 % share a level; 255 levels reach 3e9


def slot_of(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.rint(np.log(np.maximum(counts, 1)) / np.log(STEP))).astype(np.uint8)


def counts_of(levels: np.ndarray) -> np.ndarray:
    """The counts that levels stand for."""
    return STEP ** np.arange(256)[levels]


def triple_levels(df: DataFrame, text: str = "text", sets: Callable = triple_sets) -> np.ndarray:
    """uint8[SLOTS]: the level of each slot, over all rows of ``df``; ``sets`` gives the triples of its column."""
    size = SLOTS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for b in slices(batches):
            values, _ = sets(b.column(0))
            total += np.bincount(slot_of(values), minlength=SLOTS).astype(np.uint32)
        for i in range(0, BLOCKS, 8):  # small counts in one byte, the few large ones apart
            parts = [total[k * size : (k + 1) * size] for k in range(i, i + 8)]
            low = [np.minimum(p, 255).astype(np.uint8).tobytes() for p in parts]
            at = [np.flatnonzero(p > 255).astype(np.int32) for p in parts]
            rest = [(p[x] - 255).astype(np.uint32).tobytes() for p, x in zip(parts, at)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(i, i + 8), pa.int32()), pa.array(low, pa.binary()), pa.array([x.tobytes() for x in at], pa.binary()), pa.array(rest, pa.binary())],
                names=["block", "low", "at", "rest"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for block, low, at, rest in zip(*(c.to_pylist() for c in b.columns)):
                total = totals.setdefault(block, np.zeros(size, np.float64))
                total += np.frombuffer(low, np.uint8)
                total[np.frombuffer(at, np.int32)] += np.frombuffer(rest, np.uint32)
        for block, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_levels(total).tobytes()], pa.binary())], names=["block", "levels"])

    partial = df.select(text).mapInArrow(count, "block int, low binary, at binary, rest binary")
    rows = partial.repartition("block").mapInArrow(add, "block int, levels binary").collect()  # BLOCKS rows, 4 MB in all
    out = np.zeros(SLOTS, np.uint8)
    for r in rows:
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["levels"], np.uint8)
    return out


def by_rarity(values: np.ndarray, offsets: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values with each set in global order, their levels, the set each belongs to)."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    level = levels[slot_of(values)]
    order = np.lexsort((values, level, owner))
    return values[order], level[order], owner


def text_classes(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, cls BIGINT and text of the rows that have triples. Texts with the same set of triples
    share a class; its number is a 64-bit hash of the set, so classes are alike to themselves."""
    from sparkloom.llm.triples import set_hash

    schema = df.select(*keys, F.lit(0).cast("long").alias("cls"), text).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values, offsets = triple_sets(b.column(len(keys)))
            keep = pa.array(np.diff(offsets) > 0)
            cls = pa.array(set_hash(values, offsets), pa.int64())
            out = pa.RecordBatch.from_arrays([*b.columns[:-1], cls, b.columns[-1]], names=[*keys, "cls", text])
            yield out.filter(keep)

    return df.select(*keys, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)
