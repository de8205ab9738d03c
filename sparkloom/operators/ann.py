"""Approximate search: inverted cells, random-hyperplane hashing and product codes."""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.lineage import remove, shared_dir

#: Vectors on which an index is fitted, at most; every vector is indexed.
SAMPLE = 20_000
#: The largest sample, for indexes of many cells.
MOST_SAMPLE = 131_072
#: Probes by how exact a search should be (fixed names).
PROBES = {"fast": 1, "balanced": 4, "accurate": 8, "exact": 0}


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def sample(vectors: DataFrame, column: str = "vector", n: int = SAMPLE) -> np.ndarray:
    """At most ``n`` vectors, spread over the table by hash."""
    total = vectors.count()
    some = vectors.select(column) if total <= n else vectors.select(column).where(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int((1 << 30) * n / total))
    return np.array(some.limit(n).toArrow().column(0).to_pylist(), np.float64)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1)[None] - 2 * x[i : i + 8192] @ c.T).argmin(1) for i in range(0, len(x), 8192)])
        for j in range(k):
            own = near == j
            c[j] = x[own].mean(0) if own.any() else x[rng.integers(len(x))]
    return c


class CellIndex:
    """Vectors by their nearest centroid, in a folder; ``exact`` probes all cells.

    The number of cells grows with the square root of the vectors, as far as the sample on which
    they are fitted allows (a cell per 8 sampled vectors). Vectors are inserted, replaced and deleted
    by appending; reading takes the last version of each key. ``rebuild`` fits anew and leaves old
    versions behind; ``CellIndex.open`` goes on with an index another application made.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None, key: str = "content_id", column: str = "vector", path: str | None = None):
        self.spark, self.key, self.column = vectors.sparkSession, key, column
        self.path = path or f"{shared_dir(self.spark)}/cells-{uuid.uuid4().hex}"
        self._fit(vectors, cells)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        self = cls.__new__(cls)
        meta = spark.read.parquet(f"{path}/centroids").head()
        self.spark, self.path, self.key, self.column, self.generation = spark, path, meta["key"], meta["column"], meta["generation"]
        self.centroids = np.frombuffer(meta["centroids"], np.float64).reshape(-1, meta["width"])
        self.width, self.key_type = meta["width"], T.StructType.fromJson(json.loads(meta["key_type"])).fields[0].dataType
        return self

    def _fit(self, vectors: DataFrame, cells: int | None) -> None:
        total = vectors.count()
        cells = cells or max(1, min(int(np.sqrt(total)), MOST_SAMPLE // 8))
        data = _unit(sample(vectors, self.column, max(SAMPLE, 8 * cells)))
        self.width, self.generation, self.key_type = data.shape[1], uuid.uuid4().hex, vectors.schema[self.key].dataType
        self.centroids = _unit(kmeans(data, cells))
        self._write(vectors, False)
        key_type = T.StructType([T.StructField("k", self.key_type)]).json()
        meta = [(self.key, self.column, self.width, self.generation, bytearray(self.centroids.tobytes()), key_type)]
        self.spark.createDataFrame(meta, "key string, column string, width int, generation string, centroids binary, key_type string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")

    def _write(self, rows: DataFrame, dead: bool) -> None:
        placed = self._place(rows.select(self.key, self.column), 1) if not dead else rows.select(self.key, F.lit(None).cast("array<float>").alias(self.column), F.lit(-1).alias("cell"))
        marked = placed.withColumns({"_version": F.lit(time.time_ns()), "_dead": F.lit(dead)})
        marked.write.mode("append").parquet(f"{self.path}/vectors-{self.generation}")

    def _place(self, rows: DataFrame, n: int) -> DataFrame:
        sent, width = rows.sparkSession.sparkContext.broadcast(self.centroids), self.width
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])

        def run(batches):
            for b in batches:
                x = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64))
                s = x @ sent.value.T
                near = np.argpartition(-s, n - 1, axis=1)[:, :n].astype(np.int32) if n < s.shape[1] else np.tile(np.arange(s.shape[1], dtype=np.int32), (len(x), 1))
                take = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(near.ravel())], names=schema.names)

        return rows.mapInArrow(run, schema)

    @property
    def table(self) -> DataFrame:
        """key, vector, cell of what is in the index now."""
        rows = self.spark.read.parquet(f"{self.path}/vectors-{self.generation}")
        w = Window.partitionBy(self.key).orderBy(F.col("_version").desc())
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1 AND NOT _dead").select(self.key, self.column, "cell")

    def insert(self, rows: DataFrame) -> DataFrame:
        """Add or replace vectors; returns the rows that cannot be indexed (key, reason), which are left out.

        Null keys, null vectors, vectors of another length, with null or infinite components or all
        zero are refused row by row. Of a key given twice either vector may stay."""
        c, v = F.col(self.key), F.col(self.column)
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30))
        reason = F.when(c.isNull(), "no key").when(v.isNull(), "no vector").when(F.size(v) != self.width, "dimension").when(~finite, "not finite").when(~F.exists(v, lambda x: x != 0), "zero")
        judged = rows.select(self.key, self.column, reason.alias("reason"))
        self._write(judged.where("reason IS NULL"), False)
        return judged.where("reason IS NOT NULL").select(self.key, "reason")

    def delete(self, keys: DataFrame) -> None:
        self._write(keys.select(F.col(self.key).cast(self.key_type).alias(self.key)).distinct(), True)

    def rebuild(self, cells: int | None = None) -> None:
        """Fit on what is there now; the old files go once the new ones are complete."""
        old = f"{self.path}/vectors-{self.generation}"
        self._fit(self.table.select(self.key, self.column), cells)
        remove(self.spark, old)

    def clear(self) -> None:
        remove(self.spark, self.path)

    def search(self, queries: DataFrame, k: int = 10, mode: str = "balanced") -> DataFrame:
        """query_id, key, similarity, rank: the top k in the cells nearest to each query."""
        from sparkloom.functions.vectors import cosine

        probes = PROBES[mode] or len(self.centroids)
        q = self._place(queries.select(F.col("query_id").alias(self.key), F.col("vector").alias(self.column)), min(probes, len(self.centroids)))
        q = q.select(F.col(self.key).alias("query_id"), F.col(self.column).alias("__q"), "cell")
        hits = self.table.join(q, "cell").select("query_id", self.key, F.round(cosine(self.column, "__q"), 6).alias("similarity"))
        w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), self.key)
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hyperplane_codes(vectors: DataFrame, bits: int = 12, tables: int = 8, seed: int = 3, key: str = "content_id", column: str = "vector") -> DataFrame:
    """key, table, code: signs of random projections; equal codes make candidates."""
    width = len(vectors.select(column).head()[0])
    planes = np.random.default_rng(seed).standard_normal((tables * bits, width))
    sent = vectors.sparkSession.sparkContext.broadcast(planes)
    schema = T.StructType([vectors.schema[key], T.StructField("table", T.IntegerType()), T.StructField("code", T.LongType())])

    def run(batches):
        weight = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
            codes = ((x @ sent.value.T > 0).reshape(len(x), tables, bits) * weight).sum(2)
            take = pa.array(np.repeat(np.arange(len(x)), tables))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))), pa.array(codes.ravel())], names=schema.names)

    return vectors.select(key, column).mapInArrow(run, schema)


class ProductCodes:
    """``parts`` bytes per vector: the nearest of up to 256 centroids in each subspace."""

    def __init__(self, vectors: DataFrame, parts: int = 8, centroids: int = 256, column: str = "vector"):
        x = sample(vectors, column, SAMPLE // 5)
        if x.shape[1] % parts:
            raise ValueError("the dimension must be a multiple of parts")
        self.parts, self.column = parts, column
        self.books = np.stack([kmeans(s, centroids, 6, seed=i) for i, s in enumerate(np.split(x, parts, axis=1))])

    def encode(self, x: np.ndarray) -> np.ndarray:
        out = [((s**2).sum(1)[:, None] - 2 * s @ c.T + (c**2).sum(1)[None]).argmin(1) for s, c in zip(np.split(x, self.parts, axis=1), self.books)]
        return np.stack(out, axis=1).astype(np.uint8)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([c[code[:, i]] for i, c in enumerate(self.books)], axis=1)

    def distance(self, query: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Euclidean distances of a query to coded vectors, by a table per subspace."""
        tables = np.stack([((c - q) ** 2).sum(1) for q, c in zip(np.split(query, self.parts), self.books)])
        return np.sqrt(tables[np.arange(self.parts)[None, :], code].sum(1))

    def ratio(self) -> float:
        """Bytes of a float vector by bytes of its code."""
        return 4.0 * self.books.shape[2]

    def table(self, vectors: DataFrame, key: str = "content_id") -> DataFrame:
        """key, code BINARY, error (distance between a vector and its code)."""
        sent = vectors.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType([vectors.schema[key], T.StructField("code", T.BinaryType()), T.StructField("error", T.DoubleType())])

        def run(batches):
            me = sent.value
            for b in batches:
                x = np.array(b.column(1).to_pylist(), np.float64)
                code = me.encode(x)
                error = np.linalg.norm(x - me.decode(code), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=schema.names)

        return vectors.select(key, self.column).mapInArrow(run, schema)
