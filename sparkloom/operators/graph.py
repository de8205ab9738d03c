"""The knowledge graph: entities, edges, and queries on them.

Edges are (session_id, src, dst, relation). Iterative queries keep the frontier as a DataFrame, cut
its lineage in the shared folder every round, and never collect nodes or edges to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.lineage import durable
from sparkloom.sources.model import PRIORITY

INVERSE = "inverse_"


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge seen from both ends: node, other, relation (inverse ones marked)."""
    keep = [c for c in ("session_id",) if c in edges.columns]
    out = edges.select(*keep, F.col("src").alias("node"), F.col("dst").alias("other"), "relation")
    back = edges.select(*keep, F.col("dst").alias("node"), F.col("src").alias("other"), F.concat(F.lit(INVERSE), "relation").alias("relation"))
    return out.unionByName(back)


def plain_relation(c: Column) -> Column:
    return F.regexp_replace(c, f"^{INVERSE}", "")


def entities(mentions: DataFrame) -> DataFrame:
    """session_id, name, mention_count, first and last mention."""
    return mentions.groupBy("session_id", "name").agg(F.count("*").alias("mention_count"), F.min("ts").alias("first_mentioned"), F.max("ts").alias("last_mentioned"))


def typed_entities(mentions: DataFrame) -> DataFrame:
    """Entities with a type, inferred from their first mention and their name."""
    from sparkloom.operators.extract import entity_type

    first = F.min_by("update_type", F.struct("ts", "update_id"))
    e = mentions.groupBy("session_id", "name").agg(F.count("*").alias("mention_count"), F.min("ts").alias("first_mentioned"), F.max("ts").alias("last_mentioned"), first.alias("__t"))
    return e.withColumn("entity_type", entity_type(F.col("__t"), F.col("name"))).drop("__t")


def entity_search(entities_: DataFrame, query: str) -> DataFrame:
    """Entities whose name holds a text, in any case."""
    from sparkloom.functions import text, validate

    return entities_.where(text.contains(F.col("name"), validate.query_arg(query)))


def of_type(typed: DataFrame, kind: str) -> DataFrame:
    """Entities of a type, given in any case; an unknown one is Concept."""
    from sparkloom.functions import validate

    return typed.where(F.col("entity_type") == validate.entity_type(kind))


def degrees(edges: DataFrame) -> DataFrame:
    """Both directions counted; self loops twice."""
    return symmetric(edges).groupBy("session_id", F.col("node").alias("name")).agg(F.count("*").alias("degree"))


def importance(entities_: DataFrame, edges: DataFrame, by_mentions: bool = False) -> DataFrame:
    """importance (1, or log2 of the mentions if that is more) and score = importance + 0.1 degree."""
    base = F.greatest(F.log2(F.col("mention_count").cast("double")), F.lit(1.0)) if by_mentions else F.lit(1.0)
    out = entities_.join(degrees(edges), ["session_id", "name"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    out = out.withColumn("importance", F.round(base, 6))
    return out.withColumn("score", F.round(F.col("importance") + F.col("degree") * 0.1, 6))


def top_entities(scored: DataFrame, n: int = 100, by: str = "score") -> DataFrame:
    """The first ``n`` of each session, ties by name."""
    w = Window.partitionBy("session_id").orderBy(F.col(by).desc_nulls_last(), "name")
    return scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def stats(entities_: DataFrame, edges: DataFrame) -> DataFrame:
    """Per session: nodes, edges, average degree (0 without nodes)."""
    ends = edges.select("session_id", F.explode(F.array("src", "dst")).alias("name")).unionByName(entities_.select("session_id", "name"))
    n = ends.groupBy("session_id").agg(F.countDistinct("name").alias("nodes"))
    m = edges.groupBy("session_id").agg(F.count("*").alias("edges"))
    out = n.join(m, "session_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return out.withColumn("average_degree", F.round(F.when(F.col("nodes") > 0, 2.0 * F.col("edges") / F.col("nodes")).otherwise(0.0), 6))


def neighbours(edges: DataFrame, name: str | None = None, relation: str | None = None) -> DataFrame:
    """node, neighbours: sorted distinct names in both directions; a name without an exact match is
    looked up without case."""
    s = symmetric(edges)
    if relation is not None:
        s = s.where(plain_relation(F.col("relation")) == relation)
    if name is not None:
        exact = s.where(F.col("node") == name)
        if exact.isEmpty():
            exact = s.where(F.lower("node") == name.lower())
        s = exact
    return s.groupBy("node").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def relationships(edges: DataFrame, name: str) -> DataFrame:
    return symmetric(edges).where(F.col("node") == name).select("node", "other", "relation")


def grouped_relations(edges: DataFrame) -> DataFrame:
    """relation, n, and the distinct sources and targets."""
    return edges.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def distances(edges: DataFrame, start: DataFrame, most: int | None = None, directed: bool = False, same_session: bool = True) -> DataFrame:
    """Breadth first from each row of ``start`` (origin and node, with session_id): node, depth, parent.

    Every round joins the frontier with the edges, keeps one parent (the first by name) per new node
    and drops nodes met before by an anti join on the visited table, until none is new or ``most``
    steps are made.
    """
    keys = ["session_id"] if same_session else []
    e = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("next")) if directed else symmetric(edges).select(*keys, "node", F.col("other").alias("next"))
    e = durable(e.distinct(), "edges")
    found = durable(start.select(*keys, "origin", "node").distinct().withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast("string")), "visited")
    frontier = found
    ids = [*keys, "origin", "node"]
    for depth in range(1, most + 1) if most is not None else count(1):
        step = frontier.select(*keys, "origin", "node").join(e, [*keys, "node"])
        step = step.groupBy(*keys, "origin", F.col("next").alias("to")).agg(F.min("node").alias("parent"))
        step = step.select(*keys, "origin", F.col("to").alias("node"), F.lit(depth).alias("depth"), "parent")
        frontier = durable(step.join(found.select(*ids), ids, "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int | None = None, directed: bool = True) -> DataFrame:
    """session_id, origin, target, path: one shortest path per pair (the first by parents' names).

    Paths of any length, or of at most ``most`` steps. Paths are walked back from the targets, one
    step of all of them a round; finished ones are written and not carried on.
    """
    start = pairs.select("session_id", "origin", F.col("origin").alias("node"))
    d = durable(distances(edges, start, most, directed), "distances")
    walk = pairs.select("session_id", "origin", "target").join(d.select("session_id", "origin", F.col("node").alias("target"), "parent"), ["session_id", "origin", "target"])
    walk = walk.withColumn("path", F.array("target"))
    back = d.select("session_id", "origin", F.col("node").alias("__at"), F.col("parent").alias("__up"))
    done = []
    while True:
        walk = durable(walk, "walk")
        done.append(walk.where("parent IS NULL").select("session_id", "origin", "target", "path"))
        left = walk.where("parent IS NOT NULL")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        left = left.withColumn("path", F.concat(F.array("parent"), "path")).withColumnRenamed("parent", "__at")
        walk = left.join(back, ["session_id", "origin", "__at"]).select("session_id", "origin", "target", F.col("__up").alias("parent"), "path")


def network(edges: DataFrame, start: DataFrame, depth: int = 2, rim_edges: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges among them); without ``rim_edges`` those between two nodes at the
    greatest depth are left out."""
    nodes = durable(distances(edges, start, depth), "nodes")
    a = nodes.select("session_id", "origin", F.col("node").alias("src"), F.col("depth").alias("__a"))
    b = nodes.select("session_id", "origin", F.col("node").alias("dst"), F.col("depth").alias("__b"))
    inside = edges.join(a, ["session_id", "src"]).join(b, ["session_id", "origin", "dst"])
    if not rim_edges:
        inside = inside.where(~((F.col("__a") == depth) & (F.col("__b") == depth)))
    return nodes, inside.select("session_id", "origin", "src", "dst", "relation").distinct()


def trace(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """session_id, origin, parent, relation, node, depth: how each node was first reached; relations
    followed against their direction are marked inverse."""
    d = distances(edges, start, depth).where("parent IS NOT NULL")
    r = symmetric(edges).groupBy("session_id", F.col("node").alias("parent"), F.col("other").alias("node")).agg(F.min("relation").alias("relation"))
    return d.join(r, ["session_id", "parent", "node"]).select("session_id", "origin", "parent", "relation", "node", "depth")


def prioritised(traced: DataFrame, n: int = 10) -> DataFrame:
    """Relations of each origin by priority, then depth; ``n`` kept."""
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), plain_relation(F.col("relation")))
    place = F.when(place == 0, len(PRIORITY) + 1).otherwise(place)
    w = Window.partitionBy("session_id", "origin").orderBy(place, "depth", "parent", "node")
    return traced.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def components(edges: DataFrame, strong: bool = False) -> DataFrame:
    """session_id, node, component (smallest name in it).

    Weak ones by label propagation with pointer jumping; strong ones by peeling: in each round the
    nodes reached forwards and backwards from the smallest undecided name of their colour are one
    component, the rest is split by what reached it.
    """
    e = durable(edges.select("session_id", "src", "dst").distinct(), "edges")
    nodes = e.select("session_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    if not strong:
        return _labels(e.unionByName(e.select("session_id", F.col("dst").alias("src"), F.col("src").alias("dst"))), nodes)
    out = None
    left = durable(nodes, "nodes")
    while not left.isEmpty():
        forward = durable(_labels(e, left), "forward")  # smallest name that reaches the node
        same = e.join(forward.select("session_id", F.col("node").alias("src"), F.col("component").alias("a")), ["session_id", "src"])
        same = same.join(forward.select("session_id", F.col("node").alias("dst"), F.col("component").alias("b")), ["session_id", "dst"]).where("a = b")
        backward = _labels(same.select("session_id", F.col("dst").alias("src"), F.col("src").alias("dst")), forward.select("session_id", "node"), roots=forward.where("node = component").select("session_id", "node"))
        both = durable(forward.join(backward.where("component IS NOT NULL").select("session_id", "node", F.col("component").alias("back")), ["session_id", "node"]).where("component = back").select("session_id", "node", "component"), "component")
        out = both if out is None else out.unionByName(both)
        left = durable(left.join(both, ["session_id", "node"], "left_anti"), "left")
        e = durable(e.join(left.select("session_id", F.col("node").alias("src")), ["session_id", "src"], "left_semi").join(left.select("session_id", F.col("node").alias("dst")), ["session_id", "dst"], "left_semi"), "edges")
    return out if out is not None else nodes.withColumn("component", F.col("node"))


def _labels(edges: DataFrame, nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The smallest name (of ``roots``, if given) from which each node is reached along the edges."""
    if roots is None:
        now = nodes.withColumn("component", F.col("node"))
    else:
        now = nodes.join(roots.withColumn("component", F.col("node")), ["session_id", "node"], "left")
    now = durable(now, "labels")
    while True:
        seen = edges.join(now.where("component IS NOT NULL").select("session_id", F.col("node").alias("src"), "component"), ["session_id", "src"])
        best = seen.groupBy("session_id", F.col("dst").alias("node")).agg(F.min("component").alias("c"))
        new = now.join(best, ["session_id", "node"], "left").withColumn("moved", F.expr("c IS NOT NULL AND (component IS NULL OR c < component)"))
        new = durable(new.select("session_id", "node", F.expr("CASE WHEN moved THEN c ELSE component END AS component"), "moved"), "labels")
        now = new.select("session_id", "node", "component")
        if new.where("moved").isEmpty():
            return now


def communities(edges: DataFrame) -> DataFrame:
    """Strongly connected components of more than one node: session_id, component, members (sorted)."""
    c = components(edges, strong=True)
    return c.groupBy("session_id", "component").agg(F.count("*").alias("size")).where("size > 1")


def path_text(nodes: Column, relations: Column) -> Column:
    """``a ─REL→ b ─REL→ c`` of an array of names and one of relations."""
    rest = F.zip_with(relations, F.slice(nodes, 2, 1_000_000), lambda r, n: F.concat(F.lit(" ─"), r, F.lit("→ "), n))
    return F.concat(nodes[0], F.array_join(rest, ""))


def entity_context(entities_: DataFrame, edges: DataFrame) -> DataFrame:
    """session_id, name, text: description of an entity with at most five neighbours by name."""
    other = symmetric(edges).select("session_id", F.col("node").alias("name"), "other").distinct()
    w = Window.partitionBy("session_id", "name").orderBy("other")
    few = other.withColumn("n", F.row_number().over(w)).where("n <= 5").groupBy("session_id", "name").agg(F.array_sort(F.collect_list("other")).alias("others"))
    out = entities_.join(few, ["session_id", "name"], "left")
    related = F.when(F.size("others") > 0, F.concat(F.lit("Related to: "), F.array_join("others", ", ")))
    mentioned = F.concat(F.lit("Mentioned "), F.col("mention_count").cast("string"), F.lit(" times"))
    return out.select("session_id", "name", F.concat_ws(". ", F.col("name"), related, mentioned).alias("text"))


def entity_description(typed: DataFrame, edges: DataFrame) -> DataFrame:
    """``entity_context`` of typed entities, with their type behind the name."""
    text = entity_context(typed, edges).withColumnRenamed("text", "__text")
    out = typed.select("session_id", "name", "entity_type").join(text, ["session_id", "name"])
    rest = F.expr("substring(__text, char_length(name) + 1)")
    return out.select("session_id", "name", F.concat("name", F.lit(". Type: "), "entity_type", rest).alias("text"))


def network_page(scored: DataFrame, edges: DataFrame, n_nodes: int = 50, n_edges: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one page of each session's network: ``n_nodes`` entities by score from
    ``offset`` on, and the first ``n_edges`` edges among them in the nodes' order."""
    w = Window.partitionBy("session_id").orderBy(F.col("score").desc_nulls_last(), "name")
    nodes = scored.withColumn("nth", F.row_number().over(w)).where(f"nth <= {offset + n_nodes}").where(f"nth > {offset}")
    at = nodes.select("session_id", "name", "nth")
    inside = edges.join(at.select("session_id", F.col("name").alias("src"), F.col("nth").alias("i")), ["session_id", "src"])
    inside = inside.join(at.select("session_id", F.col("name").alias("dst"), F.col("nth").alias("j")), ["session_id", "dst"])
    w = Window.partitionBy("session_id").orderBy("i", "j", "relation")
    return nodes, inside.withColumn("nth", F.row_number().over(w)).where(f"nth <= {n_edges}").select("session_id", "src", "dst", "relation", "nth")


# -- retrieval enriched by the graph ---------------------------------------------------------------


#: Bits of the set of names that ``text_entities`` sends to all tasks: 8 MB, whatever the data.
NAME_BITS = 26


def text_entities(texts: DataFrame, entities_: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, session_id, name: entities whose name is a word of the text (of two bytes or more),
    punctuation around it and case left out.

    Hashes of the names are set in a bit set of fixed size, so that nearly all other words are
    dropped where the text is read; the rest meet the names in a join that sorts both sides, since
    Spark takes exploded words for far fewer than they are and would broadcast them."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", "")))
    words = F.array_distinct(F.filter(words, lambda w: F.octet_length(w) >= 2))
    names = durable(entities_.select("session_id", "name", F.lower("name").alias("w")), "names")
    found = _words_among(texts.select(key, "session_id", words.alias("words")), names, key)
    return found.join(names.hint("merge"), ["session_id", "w"]).select(key, "session_id", "name").distinct()


def _words_among(words: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, session_id, w: of the words of each row those that are among ``names`` (session_id, w),
    and a few others. At most 2**20 words of bits reach the driver."""

    def slot(w: Column) -> Column:
        return F.pmod(F.xxhash64("session_id", w), F.lit(1 << NAME_BITS))

    set_ = names.select(slot(F.col("w")).alias("slot")).selectExpr("cast(slot div 64 as int) AS word", "shiftleft(1L, cast(slot % 64 as int)) AS bit")
    set_ = set_.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (NAME_BITS - 6), np.int64)
    bits[set_.column("word").to_numpy()] = set_.column("bits").to_numpy()
    sent = words.sparkSession.sparkContext.broadcast(bits.view(np.uint64))
    schema = words.select(key, "session_id", F.lit("").alias("w")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(3).flatten().to_numpy(zero_copy_only=False)
            hit = pa.array(np.flatnonzero((sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)))
            owner = pc.list_parent_indices(b.column(2)).take(hit)
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), b.column(2).flatten().take(hit)], names=schema.names)

    return words.select(key, "session_id", "words", F.transform("words", slot).alias("slots")).mapInArrow(run, schema)


#: Points of a relation for what it leads to, for its type (the first of PRIORITY) and its depth.
TO_QUERY, TO_NEIGHBOUR, BY_TYPE, BY_DEPTH = 100, 50, (30, 20, 10), {1: 20, 2: 10}


def relevance(relations: DataFrame, query_entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The relations (session_id, relation, node, depth and any more) with their relevance to the
    entities of a query (session_id, name): whether they lead to one of them or to a neighbour of
    one, in any case, their type and their depth. Without entities in a session it is null there."""
    q = query_entities.select("session_id", F.lower("name").alias("__n")).distinct()
    own = symmetric(edges).select("session_id", "node", F.lower("other").alias("__o"))
    near = own.join(query_entities.select("session_id", F.col("name").alias("node")).distinct(), ["session_id", "node"], "left_semi")
    near = near.select("session_id", F.col("__o").alias("__n")).distinct().withColumn("__near", F.lit(TO_NEIGHBOUR))
    some = q.select("session_id").distinct().withColumn("__some", F.lit(True))
    out = relations.withColumn("__n", F.lower("node")).join(q.withColumn("__hit", F.lit(TO_QUERY)), ["session_id", "__n"], "left")
    out = out.join(near, ["session_id", "__n"], "left").join(some, "session_id", "left")
    kind, depth = F.lit(0), F.lit(0)
    for name, points in zip(PRIORITY, BY_TYPE):
        kind = F.when(plain_relation(F.col("relation")) == name, points).otherwise(kind)
    for n, points in BY_DEPTH.items():
        depth = F.when(F.col("depth") == n, points).otherwise(depth)
    total = F.coalesce("__hit", F.lit(0)) + F.coalesce("__near", F.lit(0)) + kind + depth
    return out.withColumn("relevance", F.when(F.col("__some"), total)).drop("__n", "__hit", "__near", "__some")


def relevant(relations: DataFrame, query_entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations of some relevance; all where the query has no entities."""
    return relevance(relations, query_entities, edges).where("relevance IS NULL OR relevance > 0")


def worth_enriching(entities_: DataFrame, least: int = 5) -> bool:
    """Whether the graph has enough entities to help."""
    return entities_.limit(least).count() >= least


def expanded_query(query: str, edges: DataFrame, n: int = 5) -> DataFrame:
    """word, node, neighbours (at most ``n`` by name) of the query's words longer than three bytes."""
    spark = edges.sparkSession
    words = [w for w in dict.fromkeys(query.lower().split()) if len(w.encode()) > 3]
    w = spark.createDataFrame([(x,) for x in words], "word string")
    s = symmetric(edges).select("node", "other").distinct().join(F.broadcast(w), F.lower("node") == F.col("word"))
    by_name = Window.partitionBy("word", "node").orderBy("other")
    few = s.withColumn("n", F.row_number().over(by_name)).where(F.col("n") <= n)
    return few.groupBy("word", "node").agg(F.array_sort(F.collect_list("other")).alias("neighbours"))
