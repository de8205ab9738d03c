"""Retrieval enriched by the knowledge graph, and vectors and caches that need no model."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import graph


def query_analysis(query_entities: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """session_id, name, related: for each entity of a query its first ``n`` neighbours by name."""
    s = graph.symmetric(edges).select("session_id", F.col("node").alias("name"), "other").distinct()
    w = Window.partitionBy("session_id", "name").orderBy("other")
    few = s.join(query_entities.select("session_id", "name").distinct(), ["session_id", "name"], "left_semi")
    few = few.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    return few.groupBy("session_id", "name").agg(F.array_sort(F.collect_list("other")).alias("related"))


def _first(df: DataFrame, by: list[str], name: str, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(name)
    return df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= n).drop("__nth")


def result_paths(hit_entities: DataFrame, query_entities: DataFrame, edges: DataFrame, key: str, n: int = 2) -> DataFrame:
    """key, session_id, origin, target, path: paths of three to five nodes from the first ``n`` entities
    of a result by name to the first ``n`` of the query."""
    few = _first(hit_entities, [key, "session_id"], "name", n).select(key, "session_id", F.col("name").alias("origin"))
    to = _first(query_entities.select("session_id", "name").distinct(), ["session_id"], "name", n)
    pairs = few.join(to.select("session_id", F.col("name").alias("target")), "session_id").where("origin <> target")
    paths = graph.shortest_paths(edges, pairs.select("session_id", "origin", "target").distinct(), 4, directed=False)
    return pairs.join(paths.where("size(path) BETWEEN 3 AND 5"), ["session_id", "origin", "target"]).select(key, "session_id", "origin", "target", "path")


def enriched(hits: DataFrame, query_entities: DataFrame, entities: DataFrame, edges: DataFrame, key: str, most: int = 10) -> DataFrame:
    """What the graph adds to results (key, session_id, text): key, session_id, source, relation, node,
    relevance, nth.

    Relations of the first three entities in a result by name, one per node they lead to; those of
    some relevance to the query's entities, all if none has any; ``most`` of each result, by
    relevance, then node. Paths to the query's entities are ``result_paths``."""
    named = _first(graph.text_entities(hits, entities, key), [key, "session_id"], "name", 3)
    s = graph.symmetric(edges).select("session_id", F.col("node").alias("name"), F.col("other").alias("node"), "relation")
    found = named.join(s, ["session_id", "name"]).select(key, "session_id", F.col("name").alias("source"), "relation", "node", F.lit(1).alias("depth"))
    once = found.withColumn("__n", F.row_number().over(Window.partitionBy(key, "session_id", "node").orderBy("source", "relation"))).where("__n = 1").drop("__n")
    scored = graph.relevance(once, query_entities, edges)
    best = F.max(F.coalesce("relevance", F.lit(0))).over(Window.partitionBy(key, "session_id"))
    kept = scored.withColumn("__best", best).where("__best = 0 OR relevance > 0").drop("__best", "depth")
    w = Window.partitionBy(key, "session_id").orderBy(F.col("relevance").desc_nulls_last(), "node")
    return kept.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def connections(hit_entities: DataFrame, edges: DataFrame, key: str, first: int = 3) -> DataFrame:
    """Paths of three to five nodes between the first entities by name of different results of a
    session; of each session the ``first`` results by key."""
    one = _first(hit_entities.select(key, "session_id", "name").distinct(), [key, "session_id"], "name", 1)
    few = _first(one, ["session_id"], key, first)
    a = few.select("session_id", F.col(key).alias("left"), F.col("name").alias("origin"))
    b = few.select("session_id", F.col(key).alias("right"), F.col("name").alias("target"))
    pairs = a.join(b, "session_id").where("left < right AND origin <> target")
    paths = graph.shortest_paths(edges, pairs.select("session_id", "origin", "target").distinct(), 4, directed=False)
    return pairs.join(paths.where("size(path) BETWEEN 3 AND 5"), ["session_id", "origin", "target"])


def expanded_search(hits: DataFrame, query: str, entities: DataFrame, edges: DataFrame, key: str, n: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A search expanded by the graph: (words of the query with their neighbours, the hits with the
    entities named in them and ``n`` neighbours of each, the paths between the query's first two entities)."""
    words = graph.expanded_query(query, edges, n)
    named = graph.text_entities(hits, entities, key)
    near = query_analysis(named.select("session_id", "name").distinct(), edges, n)
    own = graph.text_entities(entities.select("session_id").distinct().withColumn("q", F.lit(1)).withColumn("text", F.lit(query)), entities, "q")
    two = _first(own.select("session_id", "name").distinct(), ["session_id"], "name", 2).groupBy("session_id").agg(F.min("name").alias("origin"), F.max("name").alias("target"))
    return words, named.join(near, ["session_id", "name"], "left"), graph.shortest_paths(edges, two.where("origin <> target"), 4, directed=False)


def hashed_vectors(texts: DataFrame, key: str, text: str = "text", width: int = 384) -> DataFrame:
    """key, vector: unit vectors of hashed words and word pairs. Not semantic, but the same everywhere,
    and texts that share words are close. Texts without words have the zero vector."""

    def run(batches):
        for b in batches:
            out = []
            for t in b[text]:
                words = (t or "").lower().split()
                v = np.zeros(width, np.float32)
                for w in [*words, *map(" ".join, zip(words, words[1:]))]:
                    h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                    v[h % width] += 1.0 if h >> 63 else -1.0
                n = float(np.linalg.norm(v))
                out.append(v / n if n else v)
            yield pd.DataFrame({key: b[key], "vector": out})

    return texts.select(key, text).mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, vector array<float>")


class ResultCache:
    """Results of recent searches by their arguments, on the driver.

    A result is found if its arguments are equal (vectors by their hash) and it is younger than
    ``ttl``; the one used least for its age goes first. ``drop`` forgets what concerns a session, as
    after new updates. What is kept are rows of finished searches; one of more than ``rows`` is refused."""

    def __init__(self, size: int = 1000, ttl: float = 1800.0, rows: int = 1000, clock: Callable[[], float] = time.time):
        self.size, self.ttl, self.rows, self.clock = size, ttl, rows, clock
        self.kept: OrderedDict[tuple, list] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(vector, **arguments) -> tuple:
        digest = hashlib.blake2b(np.asarray(vector, np.float64).tobytes(), digest_size=16).hexdigest()
        return (digest, *sorted((k, str(v)) for k, v in arguments.items()))

    def search(self, run: Callable[[], DataFrame], vector, **arguments) -> list:
        """The rows of ``run()``, from memory if the same search was made lately."""
        key, now = self.key(vector, **arguments), self.clock()
        found = self.kept.get(key)
        if found and now - found[1] < self.ttl:
            self.hits += 1
            found[2] += 1
            return found[0]
        self.misses += 1
        rows = run().limit(self.rows + 1).collect()
        if len(rows) > self.rows:
            raise ValueError(f"more than {self.rows} rows; limit the search or raise the bound")
        self.kept[key] = [rows, now, 1, arguments.get("session_id")]
        if len(self.kept) > self.size:
            del self.kept[min(self.kept, key=lambda k: self.kept[k][2] / (1 + now - self.kept[k][1]) if k != key else float("inf"))]
        return rows

    def drop(self, session_id: str) -> None:
        for k in [k for k, v in self.kept.items() if v[3] in (session_id, None)]:
            del self.kept[k]

    def hit_rate(self) -> float:
        return self.hits / max(1, self.hits + self.misses)
