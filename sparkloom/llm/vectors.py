"""Most similar vectors for every vector: partitioned scan over anisotropically quantised codes.

Directions are put in cells by their nearest centroids. In each cell the vectors at home there are
compared with the codes of all vectors near it: the residual to the centroid is a product code of
``PARTS`` four-bit codewords, chosen to penalise the error along the vector (which changes high
inner products) more than the error across it. A query has a table of its products with all
codewords in a few bits each; the scan looks two codes up at a time and adds. What scores near the
bound is computed again from the vectors themselves: in the task where both are at home there, of
which only the best of each query leave it, and by a join otherwise, for the best scores of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import CANON, canonical_id, durable, rows_in, table

WIDTH = 128
PARTS, CODES = 64, 16
#: Inner products above this count in the loss; gives the weight of the parallel error.
NOISE_THRESHOLD = 0.2
WEIGHT = (WIDTH - 1) * NOISE_THRESHOLD**2 / (1 - NOISE_THRESHOLD**2)
#: Vectors a cell should hold, cells per vector, and the bound on the sample the index is fitted on.
CELL = 1000
SPILL = 4
SAMPLE = 65_536
PER_CELL = 32
#: Rows of one side that one task compares at once; larger cells are split into blocks.
QUERY_BLOCK, INDEX_BLOCK = 4096, 32_768
#: Rows of either side of one table scan, and the largest entry of a table by part.
SCAN_QUERIES, SCAN_ROWS, ENTRY = 256, 4096, 31
#: Scores of each vector that a task passes on where its vectors are not at home in one cell.
RERANK = 32


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    x = x / np.where(top > 0, top, 1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def centroids(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(home, kind="stable")
        filled, at = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], at, axis=0)
        c = x[rng.choice(len(x), k)].copy()  # empty cells start again somewhere
        c[filled] = sums
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def _parts(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), PARTS, -1)


def encode(x: np.ndarray, rest: np.ndarray, book: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """uint8[n, PARTS]: codewords of the residuals ``rest`` of unit vectors ``x``.

    Minimises |e|^2 + (WEIGHT - 1) (e . x)^2 of the error e, one part at a time."""
    xs, rs = _parts(x), _parts(rest)
    across = ((rs**2).sum(2)[:, :, None] - 2 * np.einsum("npd,pkd->npk", rs, book, optimize=True)) + (book**2).sum(2)[None]
    along = (rs * xs).sum(2)[:, :, None] - np.einsum("npd,pkd->npk", xs, book, optimize=True)
    code = across.argmin(2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for p in range(PARTS):
            others = total - along[rows, p, code[:, p]]
            code[:, p] = (across[:, p] + (WEIGHT - 1) * (others[:, None] + along[:, p]) ** 2).argmin(1)
            total = others + along[rows, p, code[:, p]]
    return code.astype(np.uint8)


def decode(code: np.ndarray, book: np.ndarray) -> np.ndarray:
    return book[np.arange(PARTS)[None, :], code].reshape(len(code), -1)


def codebook(x: np.ndarray, rest: np.ndarray, rng: np.random.Generator, rounds: int = 5) -> np.ndarray:
    """float32[PARTS, CODES, WIDTH / PARTS] of least anisotropic loss, by alternating minimisation."""
    xs, rs = _parts(x), _parts(rest)
    dims = xs.shape[2]
    book = np.stack([rs[rng.choice(len(x), CODES, replace=len(x) < CODES), p] for p in range(PARTS)]).astype(np.float32)
    for _ in range(rounds):
        code = encode(x, rest, book, sweeps=1)
        error = rs - book[np.arange(PARTS)[None, :], code]
        along = (error * xs).sum(2)
        total = along.sum(1)
        for p in range(PARTS):
            others = total - along[:, p]
            for k in range(CODES):
                own = code[:, p] == k
                if not own.any():
                    book[p, k] = rs[rng.integers(len(x)), p]
                    continue
                xp, rp = xs[own, p], rs[own, p]
                left = own.sum() * np.eye(dims) + (WEIGHT - 1) * xp.T @ xp
                right = rp.sum(0) + (WEIGHT - 1) * (xp * (others[own] + (xp * rp).sum(1))[:, None]).sum(0)
                book[p, k] = np.linalg.solve(left, right)
    return book


class Quantiser:
    """Cells, codebook and the score from which a pair is computed exactly; of bounded size."""

    def __init__(self, sample: np.ndarray, cells: int, least: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = unit(sample).astype(np.float32)
        self.cells = centroids(x, cells, rng)
        home = self.near(x, 1)[:, 0]
        self.book = codebook(x[:20_000], (x - self.cells[home])[:20_000], rng)
        # how far a true score at the bound is underrated: queries made at that angle to sampled vectors
        some = rng.choice(len(x), min(len(x), 20_000), replace=False)
        y = x[some]
        noise = rng.standard_normal(y.shape).astype(np.float32)
        noise -= (noise * y).sum(1, keepdims=True) * y
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        q = least * y + np.sqrt(1 - least**2) * noise
        code = encode(y, y - self.cells[home[some]], self.book)
        score = np.concatenate([self._table_scores(q[i : i + 2048], code[i : i + 2048]) for i in range(0, len(q), 2048)])
        score += (self.cells[home[some]] * q).sum(1)
        self.slack = float(max(0.03, np.quantile(least - score, 0.9998)))
        self.bound = least - self.slack

    def entries(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(products of each query with all codewords as whole numbers [part, code, query] up to ENTRY,
        what to add to their sum, and their unit, by query)."""
        e = np.einsum("qpd,pkd->pkq", _parts(q), self.book, optimize=True)
        low, high = e.min(1), e.max(1)
        step = np.maximum((high - low).max(0) / ENTRY, 1e-9)
        return np.rint((e - low[:, None]) / step).astype(np.uint8), low.sum(0), step

    def _table_scores(self, q: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The product of each query with the residual that its own code stands for, by its table."""
        e, base, step = self.entries(q)
        return base + step * e[np.arange(PARTS)[:, None], code.T, np.arange(len(q))].sum(0, dtype=np.int64)

    def scan(self, q: np.ndarray, packed: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of ``q``, row of ``packed``, score) of all pairs that score at least the bound, block by
        block; ``packed`` [byte, row] has two codes a byte, and rows of one ``home`` lie together."""
        starts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        for i in range(0, len(q), SCAN_QUERIES):
            part = q[i : i + SCAN_QUERIES]
            e, base, step = self.entries(part)
            table = (e[0::2][:, :, None] + e[1::2][:, None]).reshape(PARTS // 2, CODES * CODES, len(part))
            near = self.cells[home[starts]] @ part.T + base  # by home
            least = np.clip(np.ceil((self.bound - near) / step), 0, 65_535).astype(np.uint16)
            for j in range(0, packed.shape[1], SCAN_ROWS):
                codes = packed[:, j : j + SCAN_ROWS]
                n = codes.shape[1]
                total, four, one = (np.zeros((n, len(part)), t) for t in (np.uint16, np.uint8, np.uint8))
                for b in range(0, PARTS // 2, 4):  # four sums of two entries fit in a byte
                    np.take(table[b], codes[b], axis=0, out=four)
                    for c in range(b + 1, b + 4):
                        np.take(table[c], codes[c], axis=0, out=one)
                        four += one
                    total += four
                at = np.searchsorted(starts, np.arange(j, j + n), "right") - 1
                hit = np.empty(total.shape, bool)
                for h in range(at[0], at[-1] + 1):
                    own = slice(max(starts[h] - j, 0), (starts[h + 1] if h + 1 < len(starts) else packed.shape[1]) - j)
                    np.greater_equal(total[own], least[h], out=hit[own])
                xi, qi = np.nonzero(hit)
                yield qi + i, xi + j, near[at[xi], qi] + step[qi] * total[xi, qi]

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each unit vector, nearest first."""
        n = min(n, len(self.cells))
        s = x @ self.cells.T
        at = np.argpartition(-s, n - 1, axis=1)[:, :n]
        return np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), WIDTH)


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector of the rows with a key and WIDTH finite numbers that are not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            ok = np.isfinite(x).all(1) & (x != 0).any(1)  # a null number reads as NaN
            yield b.filter(pa.array(ok))

    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    rows = rows.where(f"key IS NOT NULL AND size(vector) = {WIDTH}")
    return rows.mapInArrow(run, "key string, vector array<float>")


def fit(classes: DataFrame, least: float) -> Quantiser | None:
    """Fitted on at most SAMPLE classes, chosen by hash; None without any class."""
    n = classes.count()
    if not n:
        return None
    cells = max(1, min(n // CELL, SAMPLE // PER_CELL))
    want = min(n, SAMPLE, max(8192, PER_CELL * cells))
    picked = classes if want == n else classes.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < int((1 << 30) * want / n))
    sample = _matrix(picked.select("vector").limit(SAMPLE).toArrow().column(0).combine_chunks())
    return Quantiser(sample, cells, least)


def best(group: np.ndarray, score: np.ndarray, then: np.ndarray, n: int) -> np.ndarray:
    """bool: the ``n`` highest scores of each group, of equal ones those with the least ``then``."""
    keep = np.zeros(len(group), bool)
    if len(group):
        order = np.lexsort((then, -score, group))
        g = group[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        nth = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        keep[order[nth < n]] = True
    return keep


class Candidates:
    """Rows of (group, other, score, then), of each group the ``n`` best so far; as many are held at most."""

    def __init__(self, n: int):
        self.n, self.rows, self.size = n, [np.empty((0,), np.int64)] * 2 + [np.empty(0)] + [np.empty((0,), np.int64)], 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]) > 4 * self.n:
            keep = best(columns[0], columns[2], columns[3], self.n)
            columns = tuple(c[keep] for c in columns)
        self.rows = [np.concatenate(x) for x in zip(self.rows, columns)]
        if len(self.rows[0]) > 2 * self.size + 100_000:
            self.prune()

    def prune(self) -> list[np.ndarray]:
        keep = best(self.rows[0], self.rows[2], self.rows[3], self.n)
        self.rows = [c[keep] for c in self.rows]
        self.size = len(self.rows[0])
        return self.rows


def scan_cell(index: Quantiser, q: pd.DataFrame, x: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """a, b, cosine of what the vectors at home in a cell (q: cls, vector) have near it (x: cls, first,
    home, code, vector if it is needed). Of those at home too, the k + 1 closest of each query with
    their cosine; of others, the RERANK best scores of each query and of each other, without one."""
    x = x.sort_values("home", kind="stable")
    exact = unit(np.stack(q["vector"].to_numpy()))
    qc, xc, first, home = q["cls"].to_numpy(), x["cls"].to_numpy(), x["first"].to_numpy(), x["home"].to_numpy()
    cell = int(q["cell"].iloc[0])
    packed = np.ascontiguousarray(np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1).T)
    order = np.argsort(qc)
    at = np.minimum(np.searchsorted(qc, xc, sorter=order), len(qc) - 1)
    at = np.where(qc[order[at]] == xc, order[at], -1)  # the other's row among the queries
    own = np.flatnonzero((home == cell) & (at < 0))  # at home in another block of this cell
    vectors = exact if not len(own) else np.concatenate([exact, unit(np.stack(x["vector"].to_numpy()[own]))])
    at[own] = len(exact) + np.arange(len(own))
    sure, byq, byx = Candidates(k + 1), Candidates(RERANK), Candidates(RERANK)
    for qi, xi, score in index.scan(exact.astype(np.float32), packed, home):
        other = qc[qi] != xc[xi]
        here = other & (at[xi] >= 0)
        qo, xo = qi[here], xi[here]
        if len(qo) > 0.05 * SCAN_QUERIES * SCAN_ROWS:  # dense: one product for all
            low, wide = qi.min(), np.unique(xo)
            cosine = (exact[low : qi.max() + 1] @ vectors[at[wide]].T)[qo - low, np.searchsorted(wide, xo)].round(6)
        else:
            cosine = np.concatenate([[0.0], *((exact[qo[j : j + 8192]] * vectors[at[xo[j : j + 8192]]]).sum(1) for j in range(0, len(qo), 8192))])[1:].round(6)
        ok = cosine >= least
        sure.add(qo[ok], xo[ok], cosine[ok], first[xo[ok]])
        far = other & ~here
        byq.add(qi[far], xi[far], score[far], first[xi[far]])
        byx.add(xi[far], qi[far], score[far], qi[far])
    qo, xo, cosine, _ = sure.prune()
    full = np.full(len(qc), -1.0)  # a query with k + 1 closer ones needs no lower score
    lowest = np.full(len(qc), np.inf)
    np.minimum.at(lowest, qo, cosine)
    many = np.bincount(qo, minlength=len(qc)) > k
    full[many] = lowest[many] - index.slack
    (qf, xf, score, _), (xb, qb, _, _) = byq.prune(), byx.prune()
    need = score >= full[qf]
    pairs = [(qc[qo], xc[xo], cosine), (qc[qf[need]], xc[xf[need]], np.nan), (qc[qb], xc[xb], np.nan)]
    return pd.concat([pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": c}) for a, b, c in pairs])


def close_pairs(classes: DataFrame, least: float, k: int) -> DataFrame:
    """a < b, cosine (rounded to 6 decimals): pairs of classes with a cosine of at least ``least``,
    among which are the k + 1 closest of each class.

    ``classes`` has cls BIGINT (unique), first BIGINT (by which equal cosines are ordered) and a valid
    vector, and is read several times: pass a written table. Every class is indexed and every class
    is a query; what is written grows with their number, not with that of close pairs.
    """
    spark = classes.sparkSession
    index = fit(classes, least)
    schema = "a long, b long, cosine double"
    if index is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x = unit(_matrix(part.column(2))).astype(np.float32)
                near = sent.value.near(x, SPILL)
                code = encode(x, x - sent.value.cells[near[:, 0]], sent.value.book)
                packed = (code[:, 0::2] << 4) | code[:, 1::2]
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS // 2), len(x), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
                flat = near.astype(np.int32).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, codes], names=["cls", "first", "vector", "near", "code"])

    placed = durable(classes.select("cls", "first", "vector").mapInArrow(place, "cls long, first long, vector array<float>, near array<int>, code binary"), "placed")
    homes = placed.select(F.col("near")[0].alias("cell"), "cls", "vector")
    sizes = placed.select(F.posexplode("near").alias("nth", "cell"))
    sizes = sizes.groupBy("cell").agg(F.count("*").alias("x"), F.count(F.when(F.col("nth") == 0, 1)).alias("q")).collect()  # a row per cell
    qs = {r["cell"]: -(-r["q"] // QUERY_BLOCK) for r in sizes if r["q"] > QUERY_BLOCK}
    xs = {r["cell"]: -(-r["x"] // INDEX_BLOCK) for r in sizes if r["x"] > INDEX_BLOCK}
    # where a cell's queries are in several blocks, the others' vectors are sent along
    vector = F.when((F.col("nth") == 0) & F.col("cell").isin(list(qs)), F.col("vector")).alias("vector") if qs else F.lit(None).cast("array<float>").alias("vector")
    spilled = placed.select(F.posexplode("near").alias("nth", "cell"), F.col("near")[0].alias("home"), "cls", "first", "code", *["vector"] * bool(qs))
    spilled = spilled.select("cell", "home", "cls", "first", "code", vector)

    def blocks(of: dict, name: str):
        count = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in of.items() for v in kv)), F.col("cell")), F.lit(1)) if of else F.lit(1)
        return F.explode(F.sequence(F.lit(0), count - 1)).alias(name), F.pmod(F.xxhash64("cls"), count).cast("int").alias(name)

    (all_q, own_q), (all_x, own_x) = blocks(qs, "qb"), blocks(xs, "xb")
    queries = homes.select("cell", own_q, "cls", "vector").select("*", all_x)
    spilled = spilled.select("cell", own_x, "home", "cls", "first", "code", "vector").select("*", all_q)

    def scan(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "cosine": np.empty(0)})
        return scan_cell(sent.value, q, x, k, least)

    keys = ["cell", "qb", "xb"]
    found = queries.groupBy(*keys).cogroup(spilled.groupBy(*keys)).applyInPandas(scan, schema)
    found = durable(found, "close")
    known = found.where("cosine IS NOT NULL")
    open_ = durable(found.where("cosine IS NULL").select("a", "b").distinct(), "open")
    needed = rows_in(classes.select("cls", "vector"), open_.select(F.explode(F.array("a", "b")).alias("cls")), ["cls"])
    va = needed.select(F.col("cls").alias("a"), F.col("vector").alias("va"))
    vb = needed.select(F.col("cls").alias("b"), F.col("vector").alias("vb"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            cosine = (unit(_matrix(r.column(2))) * unit(_matrix(r.column(3)))).sum(1).round(6)
            out = pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(cosine)], names=["a", "b", "cosine"])
            yield out.filter(pa.array(cosine >= least))

    joined = open_.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(rerank, schema)
    return known.unionAll(joined).dropDuplicates(["a", "b"])


def nearest(rows: DataFrame, key: str, vector: str, k: int = 5, least: float = 0.85) -> DataFrame:
    """content_a, content_b, cosine: pairs with a cosine of at least ``least`` of which one is among the ``k`` closest
    others of the other (equal cosine, rounded to 6 decimals: smaller key first).

    Of several valid vectors of a key one is taken, the same in every run. Null keys and vectors that are null,
    of another length, not finite or all zero are left out. Keys with the same vector are one class
    while searching; of a class only its ``k + 1`` first keys can be among the closest of anything,
    so only those are expanded as neighbours. Extra columns are ignored.
    """
    vectors = valid_vectors(rows, key, vector).withColumn("cls", F.xxhash64("vector"))
    member = durable(vectors.groupBy("key").agg(F.max("cls").alias("cls")), "members")
    start = F.conv(F.hex(F.rpad(F.substring(F.col("key").cast("binary"), 1, 7), 7, F.lit(b"\0"))), 16, 10).cast("long")
    classes = durable(vectors.groupBy("cls").agg(F.first("vector").alias("vector"), F.min(start).alias("first")), "classes")
    pairs = durable(close_pairs(classes, least, k), "pairs")
    by_key = Window.partitionBy("cls").orderBy("key")
    first = member.withColumn("nth", F.row_number().over(by_key)).where(F.col("nth") <= k + 1).select(F.col("cls").alias("x"), F.col("key").alias("other"))
    both = pairs.select(F.col("a").alias("q"), F.col("b").alias("x"), "cosine").unionAll(pairs.select(F.col("b").alias("q"), F.col("a").alias("x"), "cosine"))
    far = both.join(first, "x").select("q", "other", "cosine")
    same = first.select(F.col("x").alias("q"), "other", F.lit(1.0).alias("cosine"))
    order = Window.partitionBy("q").orderBy(F.col("cosine").desc(), "other")
    close = far.unionAll(same).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    mine = close.join(member.withColumnRenamed("cls", "q"), "q").where("key <> other")
    order = Window.partitionBy("key").orderBy(F.col("cosine").desc(), "other")
    mine = mine.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    out = mine.select(F.least("key", "other").alias("content_a"), F.greatest("key", "other").alias("content_b"), "cosine")
    return out.dropDuplicates(["content_a", "content_b"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [table(spark, sf_dir, t).select(canonical_id("content_id").alias("content_id"), "vector") for t in ("exported_embedding", "stored_embedding")]
    return nearest(rows[0].unionByName(rows[1]), "content_id", "vector").select("content_a", "content_b")


QUERIES = {"p5_found": p5_found}
#: All pairs by brute force.
ORACLE = {
    "p5_found": f"""WITH v AS (SELECT {CANON.format("content_id")} AS id, vector FROM exported_embedding UNION ALL SELECT {CANON.format("content_id")}, vector FROM stored_embedding),
  ok AS (SELECT id, any_value(CAST(vector AS DOUBLE[128])) AS v FROM v WHERE id IS NOT NULL AND len(vector) = 128
    AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1),
  p AS (SELECT a.id AS a, b.id AS b, round(array_cosine_similarity(a.v, b.v), 6) AS c FROM ok a JOIN ok b ON a.id < b.id),
  d AS (SELECT a, b, c FROM p WHERE c >= 0.85 UNION ALL SELECT b, a, c FROM p WHERE c >= 0.85)
  SELECT DISTINCT least(a, b) AS content_a, greatest(a, b) AS content_b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM d) WHERE n <= 5"""
}
