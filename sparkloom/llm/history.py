"""Deduplicating new batches against all history: a segment index for bounded edit distance.

The *canonical string* of a text is its set of word triples in a fixed global order (rare first);
reordered sentences have the same one. Two texts are alike if they share at least half of their
triples, which bounds the edit (insert/delete) distance of their canonical strings of lengths n and
m by (n + m) div 3. Of a stored string at most n div 2 elements can be missing in one alike to it.
So of the first n div 2 + m elements, each stored as a *segment* under the string's length band and
with its own position, at least m are met by elements of the probing string. Which elements probe a
length band, and which positions they may meet, follows from the same bound. A pair is verified if
it meets in m segments. Segments of more than one triple would not do: at this distance a text can
lose an element out of every such segment.

An index is a folder of bucketed tables: segments by hash, strings by class, ids. A batch is hashed
once, probes the stored buckets (which are not shuffled) and appends what it is accepted with; no
text is stored, and none of an earlier batch is read again.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import CANON, Scratch, canonical_id, exists, shared_dir, table
from sparkloom.llm.rarity import by_rarity, triple_levels
from sparkloom.llm.triples import distinct, mix, set_hash, slices, triple_sets

#: Bytes kept of a triple's hash; equal ones of different triples would change a count by one.
TOKEN_BYTES = 6
#: Segments a pair must have in common before it is verified (all that it must share, if those are fewer).
MATCHES = 4
#: Rows of a batch that one task may hold to look them up in a bucket.
BUILD_ROWS = 2_000_000
#: Items and links of a batch up to which one task decides them; more are decided in rounds.
ONE_TASK = 300_000
#: Waiting batches are admitted together while they hold at most this part of the items taken before, and so many at most.
TOGETHER, MOST_TOGETHER = 0.5, 64
TABLES = {"segments": ("segment", "segment BIGINT, cls BIGINT, n INT, at INT"), "strings": ("cls", "cls BIGINT, tokens BINARY"), "ids": ("id", "id STRING")}


def packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Sets of hashes as binary values, TOKEN_BYTES of each hash (its upper ones)."""
    size = TOKEN_BYTES
    data = np.ascontiguousarray((values >> np.uint64(64 - 8 * size)).view(np.uint8).reshape(-1, 8)[:, :size])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * size).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, their lower bits 0; n+1 offsets)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, TOKEN_BYTES)
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, 8 - TOKEN_BYTES :] = data
    return wide.view(np.uint64).ravel(), (offsets - offsets[0]) // TOKEN_BYTES


def hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cls BIGINT (null for texts without triples), tokens (their triples, packed).

    ``rows`` has keys, realm INT (texts of different realms are never compared) and text. Texts of
    one realm with the same set of triples have the same cls."""
    schema = rows.select(*keys, F.lit(None).cast("long").alias("cls"), F.lit(None).cast("binary").alias("tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values, offsets = triple_sets(b.column(len(keys) + 1))
            realm = np.asarray(b.column(len(keys)).to_numpy(zero_copy_only=False), np.int64)
            cls = pa.array(set_hash(values, offsets) ^ (realm * 0x2545F4914F6CDD1D), pa.int64(), mask=np.diff(offsets) == 0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], cls, packed(values, offsets)], names=schema.names)

    return rows.select(*keys, "realm", "text").mapInArrow(run, schema)


def canonical(classes: DataFrame, levels: np.ndarray) -> DataFrame:
    """cls, realm, tokens in the global order."""
    sent = classes.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values, offsets = unpacked(b.column(2))
            values, _, _ = by_rarity(values, offsets, sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(values, offsets)], names=["cls", "realm", "tokens"])

    return classes.select("cls", "realm", "tokens").mapInArrow(run, "cls long, realm int, tokens binary")


def _keys(values: np.ndarray, realm: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The hash under which an element is stored and sought: of itself, its realm and length band."""
    place = realm.astype(np.uint64) * np.uint64(64) + band.astype(np.uint64)
    return (mix(values + place * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)).view(np.int64)


def _bands(n: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(n, 1))[1] - 1  # floor of the binary logarithm


def segments(strings: DataFrame, banded: bool = True) -> DataFrame:
    """What is stored of each canonical string: segment, cls, n (length), at (position).

    Unbanded segments also probe each other, so that one shuffle serves both sides of a batch's own join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values, offsets = unpacked(b.column(2))
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(values)) - offsets[:-1][owner]
            keep = at < (n // 2 + MATCHES)[owner]
            owner, at = owner[keep], at[keep]
            realm = np.asarray(b.column(1).to_numpy(zero_copy_only=False), np.int64)
            key = _keys(values[keep], realm[owner], _bands(n)[owner] if banded else np.full(len(owner), 63))
            yield _postings(key, b.column(0), owner, n, at)

    return strings.select("cls", "realm", "tokens").mapInArrow(run, TABLES["segments"][1])


def probes(strings: DataFrame) -> DataFrame:
    """What each string seeks, by length band: the shortest string of a band that may be alike says
    how many elements, rare first, are needed there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values, offsets = unpacked(b.column(2))
            n = np.diff(offsets)
            realm = np.asarray(b.column(1).to_numpy(zero_copy_only=False), np.int64)
            for step in (-1, 0, 1):
                band = _bands(n) + step
                low = np.maximum(np.left_shift(1, np.maximum(band, 0)), -(-n // 2))
                least = (n + low + 2) // 3
                most = np.where((band >= 0) & (low <= np.minimum(2 * n, np.left_shift(2, np.maximum(band, 0)) - 1)), np.minimum(n, n - least + np.minimum(MATCHES, least)), 0)
                owner = np.repeat(np.arange(len(n)), most)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most)
                yield _postings(_keys(values[offsets[:-1][owner] + at], realm[owner], band[owner]), b.column(0), owner, n, at)

    return strings.select("cls", "realm", "tokens").mapInArrow(run, TABLES["segments"][1])


def _postings(key: np.ndarray, cls: pa.Array, owner: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(key), cls.take(pa.array(owner)), pa.array(n[owner].astype(np.int32)), pa.array(at.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "cls", "n", "at"])


def meet(probing: DataFrame, stored: DataFrame, within: bool = False) -> DataFrame:
    """x (probing), y (stored): classes to verify, each pair once; ``within``: both are of the same
    strings, and of the two directions the one to the shorter string is enough."""
    a = probing.select("segment", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("at").alias("i"))
    b = stored.select("segment", F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("at").alias("j"))
    least = F.expr("(nx + ny + 2) div 3")  # what alike texts of these lengths share
    need = F.least(F.lit(MATCHES), least)
    ok = (F.col("i") < F.col("nx") - least + need) & (F.col("j") < F.col("ny") - least + need)
    ok = ok & (F.col("nx") <= 2 * F.col("ny")) & (F.col("ny") <= 2 * F.col("nx"))
    ok = ok & (F.expr("least(i, j) + 1 + least(nx - i, ny - j) - 1") >= least)  # enough before and behind this place
    if within:
        ok = ok & ((F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x"))))
    met = a.join(b.hint("merge") if within else b, "segment").where(ok).select("x", "y", need.alias("need"))
    return met.groupBy("x", "y", "need").agg(F.count("*").alias("met")).where("met >= need").select("x", "y")


def bounded(pairs: DataFrame, probing: DataFrame, stored: DataFrame) -> DataFrame:
    """The pairs whose canonical strings are within the bounded edit distance: x, y, distance."""
    a = probing.select(F.col("cls").alias("x"), F.col("tokens").alias("tx"))
    b = stored.select(F.col("cls").alias("y"), F.col("tokens").alias("ty"))
    both = pairs.join(b.hint("merge"), "y").join(a.hint("merge"), "x").select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in slices(batches, 512):
            (va, oa), (vb, ob) = unpacked(r.column(2)), unpacked(r.column(3))
            na, nb, pair = np.diff(oa), np.diff(ob), np.arange(r.num_rows)
            _, all_ = distinct(np.concatenate([va, vb]), np.concatenate([np.repeat(pair, na), np.repeat(pair, nb)]), r.num_rows)
            distance = 2 * np.diff(all_) - na - nb  # deletions and insertions
            out = pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(distance, pa.int64())], names=["x", "y", "distance"])
            yield out.filter(pa.array(3 * distance <= na + nb))

    return both.mapInArrow(run, "x long, y long, distance long")


def alongside(spark: SparkSession) -> SparkSession:
    """Another session of the same application with the same settings."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            own.conf.set(k, v)
    return own


def steady(spark: SparkSession) -> SparkSession:
    """A session of the same application without adaptive plans and broadcasts, which take a job and
    threads of the driver for each exchange: too much for the many small steps of a batch."""
    own = alongside(spark)
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return own


def few_buckets(spark: SparkSession) -> int:
    """A third of the shuffle partitions, but not fewer than there are cores: each of the many steps of
    a batch takes as many tasks, and a batch is a small part of what those partitions are meant for."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-most // 3)))


def at_once(*jobs: Callable) -> list:
    """What the jobs return; they run side by side, since each alone leaves cores idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


class SegmentIndex:
    """All that was accepted so far, in a shared folder: segments, canonical strings and ids.

    The order of triples is fixed by the first batch with texts, since it must stay the same; later
    batches only make it less selective, never wrong. It lies beside the tables with the number of
    buckets, so that an index opened again goes on with both. A batch counts once its number is in
    ``commits``; what a broken append left behind is not read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.steady, self.wide = spark, path.rstrip("/"), steady(spark), alongside(spark)
        self.buckets = buckets or few_buckets(spark)
        self.levels: np.ndarray | None = None
        self._load()

    def _load(self) -> None:
        if exists(self.spark, f"{self.path}/levels"):
            kept = self.spark.read.schema("levels binary, buckets int").parquet(f"{self.path}/levels").head()
            if kept is None:
                raise ValueError(f"the order of triples in {self.path}/levels can't be read")
            self.levels, self.buckets = np.frombuffer(kept["levels"], np.uint8), kept["buckets"]
        elif self._marks("commits"):
            raise ValueError(f"{self.path} has batches but not the order of triples they were made with")
        for own in (self.steady, self.wide):  # so that what meets the buckets is shuffled into as many
            own.conf.set("spark.sql.shuffle.partitions", self.buckets)

    def order(self, classes: DataFrame) -> np.ndarray:
        """The global order of triples; made from ``classes`` (cls, realm, tokens) if there is none."""
        if self.levels is None:
            self._load()  # another may have appended since
        if self.levels is None:
            levels = triple_levels(classes, "tokens", unpacked)
            kept = self.spark.createDataFrame([(bytearray(levels.tobytes()), self.buckets)], "levels binary, buckets int")
            kept.coalesce(1).write.mode("error").parquet(f"{self.path}/levels")
            self.levels = levels
        return self.levels

    def _table(self, what: str) -> str:
        """The bucketed table, known to this session's catalogue by its folder."""
        name = f"sparkloom_{what}_{hashlib.md5(self.path.encode()).hexdigest()}"
        by, columns = TABLES[what]
        where = f"{self.path}/{what}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, part BIGINT) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return name

    def stored(self, spark: SparkSession | None = None) -> dict[str, DataFrame]:
        """segments, strings and ids of all batches committed by now; empty if there is none yet.

        A batch that began to be appended and didn't end is left out."""
        if self.levels is None:
            self._load()  # another may have appended since
        done = self._marks("commits")
        if self.levels is None or not done:
            return {}
        broken, out = sorted(self._marks("begun") - done), {}
        spark = spark or self.spark
        for what in TABLES:
            spark.catalog.refreshTable(name := self._table(what))
            rows = spark.table(name)
            out[what] = (rows.where(~F.col("part").isin(broken)) if broken else rows).drop("part")
        return out

    def _marks(self, which: str) -> set[int]:
        """The numbers of the batches that began to be appended, or ended: an empty file each."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{which}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {int(f.getPath().getName()) for f in fs.listStatus(p)} if fs.exists(p) else set()

    def _mark(self, which: str, part: int) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{which}/{part}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p).close()

    def _postings(self, strings: DataFrame) -> int:
        """What strings probe with at most, by the size of their files (hashes don't compress)."""
        return 2 * sum(self._length(f) for f in strings.inputFiles()) // TOKEN_BYTES

    def _length(self, file: str) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(file)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()

    def probe(self, strings: DataFrame, stored: dict[str, DataFrame] | None = None, scratch: Scratch | None = None) -> DataFrame:
        """x (new class), y (stored class), distance of all alike pairs; empty for an empty index.

        ``strings``: cls, realm, tokens as ``canonical`` gives them, as a written table. The stored
        buckets are read without a shuffle, and without a sort if the batch is small for them."""
        stored = self.stored() if stored is None else stored
        if not stored:
            return self.spark.createDataFrame([], "x long, y long, distance long")
        how, scratch = "shuffle_hash" if self._postings(strings) <= BUILD_ROWS * self.buckets else "merge", scratch or Scratch(self.spark)
        pairs = scratch.keep(meet(probes(strings).hint(how), stored["segments"]), "pairs")
        return bounded(pairs, strings, pairs.select(F.col("y").alias("cls")).distinct().hint(how).join(stored["strings"], "cls"))

    def append(self, strings: DataFrame, ids: DataFrame, together: str = "") -> None:
        """Add classes (cls, realm, tokens) and ids that are not in the index yet, as one batch.

        ``together`` names the table whose rows lie in partitions by bucket already."""
        part = uuid.uuid4().int >> 65
        self._mark("begun", part)

        def add(what: str, rows: DataFrame) -> None:
            by = TABLES[what][0]
            rows = (rows if what == together else rows.repartition(self.buckets, by)).withColumn("part", F.lit(part).cast("long"))
            rows.sortWithinPartitions(by).write.insertInto(self._table(what))

        at_once(lambda: add("segments", segments(strings)), lambda: add("strings", strings.select("cls", "tokens")), lambda: add("ids", ids.select("id")))
        self._mark("commits", part)

    def admit(self, rows: DataFrame) -> DataFrame:
        """Take one batch of items, or a few in their order, and append what is accepted; the refused items: keys.

        ``rows``: kind, row_id, item_no (which tell items apart and give their order, nulls first),
        id, realm (0 to 65,535, one for each kind), text, and turn (0 to 8,191) if they are of several batches,
        the batch of turn 0 coming first. An item is refused if one accepted before, in this batch or any earlier,
        has its id or an alike text. Null ids equal none; null, empty and short texts (under 8
        words) are alike to none, so such an item is refused by its id only.
        """
        spark, keys = self.spark, ["kind", "row_id", "item_no"]
        wide, small = Scratch(self.wide), Scratch(self.steady)  # for joins of postings and texts, and for all else
        rows = rows if "turn" in rows.columns else rows.withColumn("turn", F.lit(0))
        items = small.keep(hashed(rows, [*keys, "turn", "id", "realm"]), "batch")
        row = "cast(turn as decimal(38,0)) * 36893488147419103232 + coalesce(cast(row_id as decimal(38,0)), -9223372036854775809)"
        ranked = F.expr(f"(({row}) * 4294967296 + coalesce(item_no, -1)) * 65536 + realm").cast("decimal(38,0)")
        items = items.withColumn("ord", ranked)
        left = items.where("id IS NOT NULL OR cls IS NOT NULL").groupBy("id", "cls").agg(F.min("ord").alias("ord"))
        # of the same id and class only the first can be accepted: what refuses it refuses the rest
        if stored := self.stored(self.steady):
            for key, what in (("id", "ids"), ("cls", "strings")):
                met = left.select(key).where(f"{key} IS NOT NULL").distinct().hint("shuffle_hash").join(stored[what].select(key), key)
                left = left.join(met, key, "left_anti")
        n_left, n_links = Observation(), Observation()
        left = small.keep(left.select("ord", "id", "cls").observe(n_left, F.count("*").alias("n")), "left")
        # texts are brought together by class once; what follows reads their buckets
        first = items.where("cls IS NOT NULL").groupBy("cls").agg(F.first("realm").alias("realm"), F.first("tokens").alias("tokens"))
        first = first.join(left.where("cls IS NOT NULL").select("cls").distinct(), "cls", "left_semi")
        first = first if self.levels is not None else small.keep(first, "first")
        name = small.bucketed(canonical(first, self.order(first)), "strings", "cls", self.buckets)
        if self._postings(self.steady.table(name)) <= BUILD_ROWS:  # no task can get too many, whatever the skew
            wide.spark = self.steady
        strings = wide.spark.table(name)
        met = self.probe(strings, self.stored(wide.spark), small).select(F.col("x").alias("cls")).distinct()
        near = wide.keep(met, "near")
        new = strings.join(near.hint("merge"), "cls", "left_anti")
        own = segments(new, banded=False)
        links = wide.keep(bounded(meet(own, own, within=True), new, new).select("x", "y").observe(n_links, F.count("*").alias("n")), "links")
        strings = self.steady.table(name)
        near, links = (self.steady.read.schema(df.schema).parquet(path) for df, path in zip((near, links), wide.paths))
        few = n_left.get["n"] + n_links.get["n"] <= ONE_TASK
        left = left.join(near, "cls", "left_anti").select("ord", "id", "cls")
        taken = small.keep(accept_in_one_task(left, links), "taken") if few else accept_in_order(left, links, small)
        free = items.where("id IS NULL AND cls IS NULL").select("ord")
        accepted = taken.where("cls IS NOT NULL").select("cls")
        refused = Scratch(spark)
        _, out = at_once(
            lambda: self.append(strings.join(accepted, "cls", "left_semi"), taken.where("id IS NOT NULL").select("id"), "strings"),
            lambda: refused.keep(items.join(taken.select("ord").unionAll(free), "ord", "left_anti").select(*keys), "refused"),
        )
        wide.drop()
        small.drop()
        gc.collect()
        spark._jvm.System.gc()  # shuffle files of this batch go only when the driver's references to them do
        return out


def accept_in_one_task(items: DataFrame, links: DataFrame) -> DataFrame:
    """``accept_in_order`` of a few items and links, their number checked by the caller: one after the other."""
    rows = items.select("ord", "id", "cls", F.lit(None).cast("long").alias("to"))
    rows = rows.unionAll(links.select(F.lit(None).cast("decimal(38,0)"), F.lit(None).cast("string"), "x", "y")).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, list[int]] = {}
        left, ids, closed, out = [], set(), set(), []
        for b in batches:
            for n, i, c, to in zip(*(x.to_pylist() for x in b.columns)):
                if n is None:
                    near.setdefault(c, []).append(to)
                    near.setdefault(to, []).append(c)
                else:
                    left.append((n, i, c))
        for n, i, c in sorted(left, key=lambda x: x[0]):
            if i in ids or c in closed:
                continue
            out.append((n, i, c))
            if i is not None:
                ids.add(i)
            if c is not None:
                closed.add(c)
                closed.update(near.get(c, ()))
        columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.decimal128(38, 0), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["ord", "id", "cls"])

    return rows.mapInArrow(run, "ord decimal(38,0), id string, cls long")


def accept_in_order(items: DataFrame, links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """ord, id, cls of the items accepted when taken by ``ord``: an item is accepted unless one
    accepted before has the same id, the same class, or a class linked to its own.

    ``items``: ord unique, id, cls (either may be null and then equals none); ``links``: x, y
    with each pair in one direction. Each round accepts all items that nothing undecided before
    them can still refuse, and drops what they refuse, with its links; only groupings and equi-joins
    on ids and classes are used, so a group of any size is never held by one task. The rounds end
    when nothing is undecided, which takes as many as the longest chain of items that wait on each other.
    """
    scratch = scratch or Scratch(items.sparkSession)
    both = links.select("x", "y").unionAll(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    left, parts = items.select("ord", "id", "cls"), []
    while True:
        by_id = left.where("id IS NOT NULL").groupBy("id").agg(F.min("ord").alias("o_id"))
        by_cls = left.where("cls IS NOT NULL").groupBy("cls").agg(F.min("ord").alias("o_cls"))
        near = both.join(by_cls, both.y == by_cls.cls).groupBy("x").agg(F.min("o_cls").alias("o_near"))
        turn = by_cls.join(near, by_cls.cls == near.x, "left").select("cls", F.least("o_cls", F.coalesce("o_near", "o_cls")).alias("o_cls"))
        ready = F.expr("ord <= coalesce(o_id, ord) AND ord <= coalesce(o_cls, ord)").alias("ready")
        seen = Observation()
        now = left.join(by_id, "id", "left").join(turn, "cls", "left").select("ord", "id", "cls", ready).observe(seen, F.count_if(~F.col("ready")).alias("waiting"))
        now = scratch.keep(now, "round")
        taken = now.where("ready").drop("ready")
        parts.append(taken)
        if not seen.get["waiting"]:
            break
        own = taken.where("cls IS NOT NULL").select("cls")
        closed = scratch.keep(own.unionAll(both.join(own, both.x == own.cls, "left_semi").select(F.col("y").alias("cls"))).distinct(), "closed")
        left = now.where("NOT ready").drop("ready").join(taken.where("id IS NOT NULL").select("id"), "id", "left_anti").join(closed, "cls", "left_anti")
        both = both.join(closed, both.x == closed.cls, "left_anti").join(closed, both.y == closed.cls, "left_anti")
        if len(parts) % 4 == 0:  # short lineage, however long the chains are
            left, both = scratch.keep(left.select("ord", "id", "cls"), "undecided"), scratch.keep(both, "open")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def batch_items(exported: DataFrame, sessions: DataFrame) -> DataFrame:
    """kind, batch_no, row_id, item_no, id (canonical), realm, text of all embeddings and updates."""
    e = exported.select(
        F.lit("embedding").alias("kind"), "batch_no", "row_id", F.lit(0).alias("item_no"), canonical_id("content_id").alias("id"), F.lit(0).alias("realm"), "text"
    )
    u = sessions.select("batch_no", "row_id", F.posexplode("updates").alias("item_no", "u"))
    text = F.concat_ws(" ", "u.content.title", "u.content.description", "u.content.details", "u.content.examples", "u.content.implications")
    u = u.select(F.lit("update").alias("kind"), "batch_no", "row_id", "item_no", canonical_id("u.id").alias("id"), F.lit(1).alias("realm"), text.alias("text"))
    return e.unionByName(u)


def taken_together(sizes: list[int]) -> list[list[int]]:
    """The places of the batches that are admitted together, in order, by the numbers of their items."""
    out: list[list[int]] = []
    before = held = 0
    for k, n in enumerate(sizes):
        if out and held + n <= TOGETHER * before and len(out[-1]) < MOST_TOGETHER:
            out[-1].append(k)
            held += n
        else:
            before, held = before + held, n
            out.append([k])
    return out


def repeats(rows: DataFrame) -> DataFrame:
    """kind, row_id, item_no of the items of ``batch_items`` that are not accepted.

    The batches (one number each, nulls first) are laid out as they would arrive and admitted in
    this order to a new index, as ``SegmentIndex.admit`` states. All of them wait already, so
    small ones are admitted together: else what is stored is read once for every one of them, which
    for many batches is work in proportion to the square of their number.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    rows = rows.withColumn("id", F.concat("kind", F.lit(" "), "id"))
    arrived = scratch.keep(rows, "arrived", by="batch_no")
    batches = sorted(map(tuple, arrived.groupBy("batch_no").count().collect()), key=lambda b: (b[0] is not None, b[0]))  # a row a batch
    index = SegmentIndex(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")
    out = rows.select("kind", "row_id", "item_no").where("false")
    for places in taken_together([n for _, n in batches]):
        waiting = [arrived.where(F.col("batch_no").eqNullSafe(batches[k][0])).withColumn("turn", F.lit(i)) for i, k in enumerate(places)]
        out = out.unionAll(index.admit(reduce(DataFrame.unionAll, waiting)))
    scratch.drop()
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch_items(table(spark, sf_dir, "exported_embedding"), table(spark, sf_dir, "exported_session"))
    return repeats(rows).select("kind", F.col("row_id").cast("long").alias("row_id"), F.col("item_no").cast("int").alias("item_no"))


QUERIES = {"p2_found": p2_found}
#: Items one after the other: the numbers of the refused are carried along.
ORACLE = {
    "p2_found": f"""WITH RECURSIVE u AS (SELECT batch_no, row_id, unnest(updates) AS u, generate_subscripts(updates, 1) - 1 AS item_no FROM exported_session),
  it AS (SELECT *, row_number() OVER (ORDER BY kind, batch_no NULLS FIRST, row_id, item_no) AS o FROM (
    SELECT 'embedding' AS kind, batch_no, row_id, CAST(0 AS INTEGER) AS item_no, {CANON.format("content_id")} AS id, text FROM exported_embedding
    UNION ALL SELECT 'update', batch_no, row_id, CAST(item_no AS INTEGER), {CANON.format("u.id")}, concat_ws(' ', u.content.title, u.content.description,
      array_to_string(u.content.details, ' '), array_to_string(u.content.examples, ' '), array_to_string(u.content.implications, ' ')) FROM u)),
  w AS (SELECT o, kind, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM it),
  g AS (SELECT o, kind, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 8),
  n AS (SELECT o, count(*) AS n FROM g GROUP BY 1),
  m AS (SELECT a.o AS lo, b.o AS hi, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.kind = b.kind AND a.o < b.o GROUP BY 1, 2),
  c AS (SELECT lo, hi FROM m JOIN n x ON x.o = lo JOIN n y ON y.o = hi WHERE 2 * m >= x.n + y.n - m
    UNION SELECT a.o, b.o FROM it a JOIN it b ON a.kind = b.kind AND a.id = b.id AND a.o < b.o),
  k AS MATERIALIZED (SELECT hi, list(lo) AS los, row_number() OVER (ORDER BY hi) AS n FROM c GROUP BY hi),
  s AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS refused
    UNION ALL SELECT k.n, CASE WHEN len(list_filter(k.los, lambda x: NOT list_contains(s.refused, x))) > 0 THEN list_append(s.refused, k.hi) ELSE s.refused END FROM s JOIN k ON k.n = s.n + 1)
  SELECT kind, row_id, item_no FROM it WHERE o IN (SELECT unnest(refused) FROM s WHERE n = (SELECT max(n) FROM s))"""
}
