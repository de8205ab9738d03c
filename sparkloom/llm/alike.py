"""Near-duplicate texts with small edits: an adaptive multi-match prefix join.

Two texts are alike if the word triples they share are at least half of those found in either.
Every text orders its triples rare first. Texts sharing ``a`` triples share at least ``l`` of them
within prefixes that are ``l - 1`` longer than needed to share one. A longer prefix costs more
postings but leaves fewer candidates, so each text takes the ``l`` of least estimated cost, and is
compared only with texts that meet at least ``l`` of its prefix triples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import CANON, canonical_id, durable, rows_in, table
from sparkloom.llm.rarity import by_rarity, counts_of, text_classes, triple_levels
from sparkloom.llm.triples import shared, slices, triple_sets

#: Prefix lengths a text may choose from, as the number of shared triples required.
MATCHES = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12])
#: Cost of verifying one candidate in units of joining one posting.
VERIFY_COST = 8.0


def postings(classes: DataFrame, levels: np.ndarray) -> DataFrame:
    """token, cls, n (triples of the text), at (position, rare first), need (matches required)."""
    sent = classes.sparkSession.sparkContext.broadcast(levels)
    most = int(MATCHES[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values, offsets = triple_sets(b.column(1))
            values, level, owner = by_rarity(values, offsets, sent.value)
            n = np.diff(offsets)
            start = offsets[:-1]
            least = -(-(n + -(-n // 2)) // 3)  # shared with a text half as long, the least that counts
            cost = np.concatenate([[0.0], np.cumsum(counts_of(level) - 1.0)])
            best, need = np.full(len(n), np.inf), np.ones(len(n), np.int64)
            for m in MATCHES:
                length = np.minimum(n, n - least + m)
                joined = cost[start + length] - cost[start]
                now = np.where(m <= np.maximum(least, 1), joined * (1 + VERIFY_COST / m), np.inf)
                need, best = np.where(now < best, m, need), np.minimum(now, best)
            probe = n - least + need
            index = n - -(-2 * n // 3) + most
            length = np.minimum(n, np.maximum(probe, index))
            at = np.arange(len(values)) - np.repeat(start, n)
            keep = at < length[owner]
            owner, at = owner[keep], at[keep]
            cls = b.column(0).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[keep].view(np.int64)), cls, *(pa.array(x.astype(np.int32)) for x in (n[owner], at, need[owner]))],
                names=["token", "cls", "n", "at", "need"],
            )

    return classes.select("cls", "text").mapInArrow(run, "token long, cls long, n int, at int, need int")


def candidates(posts: DataFrame) -> DataFrame:
    """x, y: classes to verify, y the one with fewer triples (or, of as many, the smaller number).

    A posting meets another only if the lengths allow half of the union to be shared, and if the
    triples from there on are enough for the matches that the longer text asks for.
    """
    x = posts.select("token", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("at").alias("i"), F.col("need").alias("need"))
    y = posts.select("token", F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("at").alias("j"))
    least = F.expr("(nx + ny + 2) div 3")
    ok = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    ok = ok & (F.col("nx") <= 2 * F.col("ny"))
    ok = ok & (F.col("i") < F.col("nx") - least + F.col("need")) & (F.col("j") < F.col("ny") - least + F.col("need"))
    met = x.join(y, "token").where(ok).groupBy("x", "y", "need").agg(F.count("*").alias("met"))
    return met.where("met >= need").select("x", "y")


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of classes whose texts are alike, with both counts: x, y, n_shared, n_all."""
    a = classes.select(F.col("cls").alias("x"), F.col("text").alias("tx"))
    b = classes.select(F.col("cls").alias("y"), F.col("text").alias("ty"))
    both = pairs.join(a, "x").join(b, "y").select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in slices(batches):
            same, union = shared(r.column(2), r.column(3))
            keep = 2 * same >= union
            out = [r.column(0), r.column(1), pa.array(same, pa.int64()), pa.array(union, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["x", "y", "n_shared", "n_all"]).filter(pa.array(keep))

    return both.mapInArrow(run, "x long, y long, n_shared long, n_all long")


def alike_classes(classes: DataFrame) -> DataFrame:
    """All pairs of different classes whose texts are alike (once each): x, y, n_shared, n_all.

    ``classes`` has cls (unique) and text, and is read several times: pass a written table.
    """
    levels = triple_levels(classes)
    return verified(candidates(postings(classes, levels)), classes)


def one_per_class(rows: DataFrame) -> DataFrame:
    """cls and one of its texts, as a written table."""
    return durable(rows.groupBy("cls").agg(F.first("text").alias("text")), "classes")


def alike_pairs(rows: DataFrame, key: str = "content_id", text: str = "text") -> DataFrame:
    """All pairs of keys whose texts are alike: (key_a, key_b), key_a < key_b.

    ``rows`` has one row per key; with repeated keys a pair counts if any of their texts are alike,
    once. Null keys, null texts and texts under 8 words are in no pair. Texts with the same triples
    are joined as one class and expanded at the end, so copies cost nothing before their pairs are
    written. Extra columns are ignored.
    """
    renamed = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    member = durable(text_classes(renamed, ["key"]), "members")
    links = alike_classes(one_per_class(member)).select("x", "y")
    return expand(links, member.select("key", "cls"), key)


def expand(links: DataFrame, member: DataFrame, key: str) -> DataFrame:
    a = member.select(F.col("key").alias("ka"), F.col("cls").alias("x"))
    b = member.select(F.col("key").alias("kb"), F.col("cls").alias("y"))
    across = links.join(a, "x").join(b, "y").select("ka", "kb").where("ka <> kb")
    same = a.join(b, F.col("x") == F.col("y")).where("ka < kb").select("ka", "kb")
    pairs = across.select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).unionAll(same)
    return pairs.distinct().select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b"))


def content_texts(exported: DataFrame, results: DataFrame) -> DataFrame:
    """content_id, text: of each canonical content the non-null text with the highest row_id in the
    exports; of contents without one there, the text of one of their search results."""
    e = exported.select(F.lit(True).alias("from_export"), F.col("row_id").alias("number"), canonical_id("content_id").alias("content_id"), "text")
    r = results.select(F.lit(False).alias("from_export"), (-F.col("result_id")).alias("number"), canonical_id("content_id").alias("content_id"), F.col("text_content").alias("text"))
    rows = e.unionByName(r).where("content_id IS NOT NULL AND text IS NOT NULL")
    best = rows.groupBy("content_id").agg(F.max(F.struct("from_export", "number")).alias("b"))
    best = durable(best.select("content_id", "b.from_export", "b.number"), "chosen")
    return rows_in(rows, best, ["from_export", "number"]).join(best, ["content_id", "from_export", "number"], "left_semi").select("content_id", "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = content_texts(table(spark, sf_dir, "exported_embedding"), table(spark, sf_dir, "semantic_search_result"))
    pairs = alike_pairs(texts)
    return pairs.withColumnsRenamed({"content_id_a": "content_a", "content_id_b": "content_b"})


QUERIES = {"p1_found": p1_found}
#: Pairs by counting the triples shared by every two texts; words and triples as the operator's.
ORACLE = {
    "p1_found": f"""WITH e AS (SELECT {CANON.format("content_id")} AS id, row_id, text FROM exported_embedding WHERE text IS NOT NULL),
  r AS (SELECT {CANON.format("content_id")} AS id, min(text_content) AS text FROM semantic_search_result WHERE text_content IS NOT NULL GROUP BY 1),
  t AS (SELECT id, arg_max(text, row_id) AS text FROM e WHERE id IS NOT NULL GROUP BY 1
    UNION ALL SELECT id, text FROM r WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM e WHERE id IS NOT NULL)),
  w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t),
  g AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 8),
  n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
  m AS (SELECT a.id AS content_a, b.id AS content_b, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
  SELECT content_a, content_b FROM m JOIN n x ON x.id = content_a JOIN n y ON y.id = content_b WHERE 2 * m >= x.n + y.n - m"""
}
