"""Mixing sources to target weights with capped repetition."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.bpe import NAME, TOKENIZERS, count_tokens
from sparkloom.llm.common import durable, table

#: Hash cells per source in which the fractional repetition is cut; a bound on what a window sees.
CELLS = 4096
MAX_SOURCES = 10_000


def water_fill(weight: Mapping[str, float], capacity: Mapping[str, float], total: float) -> dict[str, float]:
    """Split ``total`` by ``weight`` with nobody above its capacity.

    Sources whose part exceeds their capacity are clamped to it and the excess is shared among the
    rest in proportion to their weights, until no part exceeds. The sum is ``total`` or, if all are
    clamped, the sum of capacities. Sources without weight or capacity get 0.
    """
    part = {s: 0.0 for s in weight}
    free = {s for s, w in weight.items() if w > 0 and capacity.get(s, 0) > 0}
    rest = float(total)
    while free and rest > 0:
        unit = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit >= capacity[s]}
        if not over:
            for s in free:
                part[s] = weight[s] * unit
            break
        for s in over:
            part[s] = float(capacity[s])
            rest -= part[s]
        free -= over
    return part


def exact_total(weight: Mapping[str, float], capacity: Mapping[str, float]) -> float:
    """The largest total at which every source with records still reaches its share."""
    ok = {s: w for s, w in weight.items() if w > 0 and capacity.get(s, 0) > 0}
    return sum(ok.values()) * min((capacity[s] / w for s, w in ok.items()), default=0.0)


def plan_mixture(sized: DataFrame, targets: DataFrame, total: float | None = None) -> dict[str, tuple[float, float]]:
    """source -> (epochs, renormalised share). Only one row per source reaches the driver."""
    rows = targets.where("source IS NOT NULL AND target_share > 0").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = [r["source"] for r in rows]
    if len({*names}) < len(names):
        raise ValueError("a source is listed twice")
    have = {r[0]: r[1] for r in sized.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("size")).collect()} if names else {}
    weight = {r["source"]: float(r["target_share"]) for r in rows}
    room = {r["source"]: float(have.get(r["source"]) or 0) * max(0, r["max_repeats"] or 0) for r in rows}
    part = water_fill(weight, room, exact_total(weight, room) if total is None else total)
    return {s: (part[s] / have[s] if have.get(s) else 0.0, weight[s]) for s in names}


def mix(sized: DataFrame, targets: DataFrame, key: str, total: float | None = None, seed: int = 42) -> DataFrame:
    """How often each record is used: key, source, size, times (only records used at least once).

    ``sized`` has key, source and size >= 0; ``targets`` has source (unique), target_share and
    max_repeats. Each source is repeated ``floor(epochs)`` times as a whole; of the fraction left,
    records in seeded hash order are added while their running size stays within it, so a source
    misses its part by less than one record and no record is used more than max_repeats times.
    ``total`` is the mixture's size; by default the largest at which all sources with records
    reach their share exactly. A larger one is water-filled under the caps.

    The running size is taken over ``CELLS`` hash cells per source first and over single records
    only inside the one cell where the cut falls, so no window ever sees a whole source.
    Null and unlisted sources are not used; null sizes count as 0 (such records are used with
    whole repetitions only); sources without records get nothing. Ties in the hash are broken by
    key, and repeated keys are separate records whose order among themselves has no effect on sizes.
    """
    spark = sized.sparkSession
    epochs = {s: e for s, (e, _) in plan_mixture(sized, targets, total).items() if e > 0}
    schema = "source string, whole int, fraction double"
    rule = [(s, int(e + 1e-9), max(0.0, e - int(e + 1e-9))) for s, e in epochs.items()]
    rules = F.broadcast(spark.createDataFrame(rule, schema))  # at most MAX_SOURCES rows
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    rows = sized.select(F.col(key), "source", F.coalesce("size", F.lit(0)).alias("size")).join(rules, "source")
    rows = rows.withColumn("__h", h).withColumn("__cell", F.pmod("__h", F.lit(CELLS)).cast("int"))
    cells = rows.where("fraction > 0").groupBy("source", "__cell", "fraction").agg(F.sum("size").alias("__n"))
    by_cell = Window.partitionBy("source").orderBy("__cell")
    whole = Window.partitionBy("source")
    cells = cells.withColumn("__upto", F.sum("__n").over(by_cell)).withColumn("__want", F.sum("__n").over(whole) * F.col("fraction"))
    cells = cells.select("source", "__cell", (F.col("__upto") - F.col("__n")).alias("__before"), "__upto", "__want")
    cells = cells.where("__before < __want")  # the cells in which something is taken
    rows = rows.join(cells, ["source", "__cell"], "left")
    inner = F.col("__upto") > F.col("__want")  # the cut falls here
    cut = rows.where(inner).withColumn("__run", F.sum("size").over(Window.partitionBy("source").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("times", F.col("whole") + F.when(F.col("__before") + F.col("__run") <= F.col("__want"), 1).otherwise(0))
    rest = rows.where(F.coalesce(~inner, F.lit(True))).withColumn("times", F.col("whole") + F.when(F.col("__upto").isNotNull() & (F.col("size") > 0), 1).otherwise(0))
    columns = [key, "source", "size", F.col("times").cast("int").alias("times")]
    return rest.select(*columns).unionByName(cut.select(*columns)).where("times > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target_share, records used, tokens used, and the share really reached."""
    used = mixed.groupBy("source").agg(F.count("*").alias("n_records"), F.sum(F.col("size") * F.col("times")).alias("n_tokens"), F.max("times").alias("max_times"))
    out = targets.select("source", "target_share").join(used, "source", "left")
    tokens = F.coalesce("n_tokens", F.lit(0))
    total = F.sum(tokens).over(Window.partitionBy(F.lit(1)))  # one row per source
    return out.select(
        "source",
        "target_share",
        F.coalesce("n_records", F.lit(0)).alias("n_records"),
        tokens.alias("n_tokens"),
        F.coalesce("max_times", F.lit(0)).alias("max_times"),
        F.when(total > 0, tokens / total).otherwise(0.0).alias("reached_share"),
    )


def sized_documents(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """doc_id, source and size in tokens; written once, since planning and sampling both read it."""
    counted = count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"], folder=folder, name=name)
    return durable(counted.withColumnRenamed("n_tokens", "size"), "sized")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_target"), "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p7_mix_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture as large as all listed sources together: scarce sources are clamped to their caps,
    the others take over what is missing."""
    sized, targets = sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_target")
    listed = targets.where("target_share > 0").select("source").distinct()
    total = sized.join(F.broadcast(listed), "source", "left_semi").agg(F.sum("size")).head()[0]
    return mix(sized, targets, "doc_id", total=float(total or 0))


def p7_shares_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(p7_mix_full(spark, sf_dir), table(spark, sf_dir, "mix_target"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_mix_full": p7_mix_full, "p7_shares_full": p7_shares_full}
ORACLE: dict = {}
