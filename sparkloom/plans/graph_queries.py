"""Queries on the knowledge graph that updates create."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.operators import summary as Y
from sparkloom.sources import tables as T
from sparkloom.sources.model import PRIORITY
from sparkloom.sources.tables import with_tables

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


SYM = "sym AS (SELECT session_id, src AS node, dst AS other, relation FROM edge UNION ALL SELECT session_id, dst, src, 'inverse_' || relation FROM edge)"
ENT = "ent AS (SELECT session_id, name, count(*) AS mention_count, min(ts) AS first_mentioned, max(ts) AS last_mentioned FROM mention GROUP BY 1, 2)"
DEG = "deg AS (SELECT session_id, node AS name, count(*) AS degree FROM sym GROUP BY 1, 2)"
IMP = """imp AS (SELECT session_id, name, mention_count, last_mentioned, coalesce(degree, 0) AS degree, CAST(1.0 AS DOUBLE) AS importance,
  round(CAST(1.0 AS DOUBLE) + coalesce(degree, 0) * CAST(0.1 AS DOUBLE), 6) AS score FROM ent LEFT JOIN deg USING (session_id, name))"""


def _tables(spark, d):
    m, e = T.mentions(spark, d), T.edges(spark, d)
    return G.entities(m), e


def _scored(spark, d, **kw):
    return G.importance(*_tables(spark, d), **kw)


@query("ag1_entities", with_tables("upd mention", f", {ENT} SELECT * FROM ent"))
def _(spark, d):
    return G.entities(T.mentions(spark, d))


@query("src12_edges", with_tables("upd edge", "SELECT session_id, src, dst, relation FROM edge"))
def _(spark, d):
    return T.edges(spark, d)


@query("gr1_neighbours", with_tables("upd edge", f", {SYM} SELECT node, array_to_string(list_sort(list(DISTINCT other)), '|') AS neighbours FROM sym GROUP BY 1"))
def _(spark, d):
    return G.neighbours(T.edges(spark, d)).select("node", F.array_join("neighbours", "|").alias("neighbours"))


@query("gr2_neighbours_by_relation", with_tables("upd edge", f", {SYM} SELECT node, array_to_string(list_sort(list(DISTINCT other)), '|') AS neighbours FROM sym WHERE replace(relation, 'inverse_', '') = 'DependsOn' GROUP BY 1"))
def _(spark, d):
    return G.neighbours(T.edges(spark, d), relation="DependsOn").select("node", F.array_join("neighbours", "|").alias("neighbours"))


@query("gr3_relationships", with_tables("upd edge", f", {SYM} SELECT node, other, relation FROM sym WHERE node = (SELECT min(src) FROM edge)"))
def _(spark, d):
    e = T.edges(spark, d)
    return G.relationships(e, e.agg(F.min("src")).head()[0] or "")


@query("ag3_degrees", with_tables("upd edge", f", {SYM}, {DEG} SELECT session_id, name, degree FROM deg"))
def _(spark, d):
    return G.degrees(T.edges(spark, d))


@query("ag4_importance", with_tables("upd mention edge", f", {SYM}, {ENT}, {DEG}, {IMP} SELECT session_id, name, mention_count, degree, importance, score FROM imp"))
def _(spark, d):
    return _scored(spark, d).select("session_id", "name", "mention_count", "degree", "importance", "score")


@query("ag2_importance_by_mentions", with_tables("upd mention", f", {ENT} SELECT session_id, name, round(greatest(log2(mention_count), 1.0), 6) AS importance FROM ent"))
def _(spark, d):
    return _scored(spark, d, by_mentions=True).select("session_id", "name", "importance")


_TOP = "SELECT session_id, name, nth FROM (SELECT session_id, name, row_number() OVER (PARTITION BY session_id ORDER BY {0} DESC NULLS LAST, name) AS nth FROM imp) WHERE nth <= {1}"


@query("tk5_top_entities", with_tables("upd mention edge", f", {SYM}, {ENT}, {DEG}, {IMP} {_TOP.format('score', 10)}"))
def _(spark, d):
    return G.top_entities(_scored(spark, d), 10).select("session_id", "name", "nth")


@query("tk4_recent_entities", with_tables("upd mention edge", f", {SYM}, {ENT}, {DEG}, {IMP} {_TOP.format('last_mentioned', 5)}"))
def _(spark, d):
    return G.top_entities(_scored(spark, d), 5, by="last_mentioned").select("session_id", "name", "nth")


@query("levels_entities", with_tables("upd mention edge", f""", {SYM}, {ENT}, {DEG}, {IMP} SELECT session_id, name,
  CASE WHEN score >= 2 THEN 'Critical' WHEN score >= 1.5 THEN 'High' WHEN score >= 1 THEN 'Medium' WHEN score >= 0.5 THEN 'Low' ELSE 'Minimal' END AS importance_level,
  CASE WHEN dd = 0 THEN 'Today' WHEN dd BETWEEN 1 AND 3 THEN 'Recent' WHEN dd BETWEEN 4 AND 7 THEN 'ThisWeek' WHEN dd BETWEEN 8 AND 30 THEN 'ThisMonth' ELSE 'Old' END AS recency_level
  FROM (SELECT *, date_sub('day', last_mentioned, TIMESTAMP '2026-01-01') AS dd FROM imp)"""))
def _(spark, d):
    out = Y.entity_levels(_scored(spark, d), F.lit(datetime(2026, 1, 1)))
    return out.select("session_id", "name", "importance_level", "recency_level")


@query("ag5_graph_stats", with_tables("upd mention edge", f""", {ENT}, n AS (SELECT session_id, count(DISTINCT name) AS nodes FROM (SELECT session_id, src AS name FROM edge UNION ALL SELECT session_id, dst FROM edge UNION ALL SELECT session_id, name FROM ent) GROUP BY 1),
  m AS (SELECT session_id, count(*) AS edges FROM edge GROUP BY 1) SELECT session_id, nodes, coalesce(edges, 0) AS edges, round(2.0 * coalesce(edges, 0) / nodes, 6) AS average_degree FROM n LEFT JOIN m USING (session_id)"""))
def _(spark, d):
    return G.stats(*_tables(spark, d))


@query("ag12_grouped_relations", with_tables("upd edge", "SELECT relation, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edge GROUP BY 1"))
def _(spark, d):
    return G.grouped_relations(T.edges(spark, d))


def _starts(edges):
    """The first source by name of each session."""
    return edges.groupBy("session_id").agg(F.min("src").alias("node")).withColumn("origin", F.col("node"))


_START = "st AS (SELECT session_id, min(src) AS origin FROM edge GROUP BY 1)"
_WALK = """SELECT session_id, origin, node, min(depth) AS depth FROM bfs GROUP BY 1, 2, 3"""


def _bfs(names: str, step: str, depth: int) -> str:
    base = with_tables(names, "")
    return base.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", {SYM}, {_START}, nx AS (SELECT DISTINCT session_id, {step} FROM {'sym' if 'node' in step else 'edge'}),
  bfs AS (SELECT session_id, origin, origin AS node, 0 AS depth FROM st UNION SELECT b.session_id, b.origin, n.b, b.depth + 1 FROM bfs b JOIN nx n ON n.session_id = b.session_id AND n.a = b.node WHERE b.depth < {depth})
  """


@query("gr5_distances", _bfs("upd edge", "node AS a, other AS b", 3) + _WALK)
def _(spark, d):
    e = T.edges(spark, d)
    return G.distances(e, _starts(e), 3).select("session_id", "origin", "node", "depth")


@query("gr6_directed_distances", _bfs("upd edge", "src AS a, dst AS b", 4) + _WALK)
def _(spark, d):
    e = T.edges(spark, d)
    return G.distances(e, _starts(e), 4, directed=True).select("session_id", "origin", "node", "depth")


@query("gr6_shortest_paths", _bfs("upd edge", "src AS a, dst AS b", 4) + f"SELECT session_id, origin, node AS target, depth + 1 AS n_nodes FROM ({_WALK})")
def _(spark, d):
    e = T.edges(spark, d)
    start = _starts(e)
    targets = G.distances(e, start, 4, directed=True).select("session_id", "origin", F.col("node").alias("target"))
    return G.shortest_paths(e, targets, 4).select("session_id", "origin", "target", F.size("path").alias("n_nodes"))


@query("gr5b_network", _bfs("upd edge", "node AS a, other AS b", 2) + f""", w AS ({_WALK}) SELECT DISTINCT e.session_id, a.origin, e.src, e.dst, e.relation FROM edge e
  JOIN w a ON a.session_id = e.session_id AND a.node = e.src JOIN w b ON b.session_id = e.session_id AND b.node = e.dst AND b.origin = a.origin""".replace(", w AS", ", w AS"))
def _(spark, d):
    e = T.edges(spark, d)
    return G.network(e, _starts(e), 2)[1]


@query("gr5_network_without_rim", _bfs("upd edge", "node AS a, other AS b", 2) + f""", w AS ({_WALK}) SELECT DISTINCT e.session_id, a.origin, e.src, e.dst, e.relation FROM edge e
  JOIN w a ON a.session_id = e.session_id AND a.node = e.src JOIN w b ON b.session_id = e.session_id AND b.node = e.dst AND b.origin = a.origin WHERE NOT (a.depth = 2 AND b.depth = 2)""")
def _(spark, d):
    e = T.edges(spark, d)
    return G.network(e, _starts(e), 2, rim_edges=False)[1]


_TRACE = _bfs("upd edge", "node AS a, other AS b", 2) + f""", w AS ({_WALK}),
  up AS (SELECT w.session_id, w.origin, min(p.node) AS parent, w.node, w.depth FROM w JOIN w p ON p.session_id = w.session_id AND p.origin = w.origin AND p.depth = w.depth - 1
    JOIN nx ON nx.session_id = w.session_id AND nx.a = p.node AND nx.b = w.node GROUP BY 1, 2, 4, 5),
  tr AS (SELECT up.session_id, up.origin, up.parent, min(s.relation) AS relation, up.node, up.depth FROM up JOIN sym s ON s.session_id = up.session_id AND s.node = up.parent AND s.other = up.node GROUP BY 1, 2, 3, 5, 6)"""
_PLAIN = "regexp_replace(relation, '^inverse_', '')"
_PLACE = f"CASE {_PLAIN} " + " ".join(f"WHEN '{r}' THEN {i + 1}" for i, r in enumerate(PRIORITY)) + f" ELSE {len(PRIORITY) + 1} END"
_QE = "qe AS (SELECT session_id, min(src) AS name FROM edge GROUP BY 1), qn AS (SELECT DISTINCT session_id, lower(other) AS name FROM sym JOIN qe USING (session_id) WHERE node = qe.name)"


def _points(depth: str) -> str:
    hit = "(SELECT count(*) FROM qe WHERE qe.session_id = r.session_id AND lower(qe.name) = lower(r.node))"
    near = "(SELECT count(*) FROM qn WHERE qn.session_id = r.session_id AND qn.name = lower(r.node))"
    kind = f"CASE {_PLAIN} " + " ".join(f"WHEN '{r}' THEN {p}" for r, p in zip(PRIORITY, G.BY_TYPE)) + " ELSE 0 END"
    return f"CAST(100 * {hit} + 50 * {near} + {kind} + {depth} AS INTEGER)"


@query("gr4_trace", _TRACE + " SELECT * FROM tr")
def _(spark, d):
    e = T.edges(spark, d)
    return G.trace(e, _starts(e), 2)


@query("gr9_prioritised", _TRACE + f""" SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, origin ORDER BY {_PLACE}, depth, parent, node) AS INTEGER) AS nth FROM tr) WHERE nth <= 10""")
def _(spark, d):
    e = T.edges(spark, d)
    return G.prioritised(G.trace(e, _starts(e), 2)).select("session_id", "origin", "parent", "relation", "node", "depth", "nth")


def _reach(sym: bool) -> str:
    step, table = ("node AS a, other AS b", "sym") if sym else ("src AS a, dst AS b", "edge")
    return with_tables("upd edge", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", {SYM}, nx AS (SELECT DISTINCT session_id, {step} FROM {table}),
  nodes AS (SELECT DISTINCT session_id, node FROM sym),
  r AS (SELECT session_id, node AS a, node AS b FROM nodes UNION SELECT r.session_id, r.a, nx.b FROM r JOIN nx ON nx.session_id = r.session_id AND nx.a = r.b) """


@query("gr7_weak_components", _reach(True) + "SELECT session_id, a AS node, min(b) AS component FROM r GROUP BY 1, 2")
def _(spark, d):
    return G.components(T.edges(spark, d))


@query("gr7_communities", _reach(False) + """SELECT session_id, component, count(*) AS size FROM (SELECT x.session_id, x.a AS node, min(x.b) AS component FROM r x
  JOIN r y ON y.session_id = x.session_id AND y.a = x.b AND y.b = x.a GROUP BY 1, 2) GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, d):
    return G.communities(T.edges(spark, d))


@query("gr8_entity_context", with_tables("upd mention edge", f""", {SYM}, {ENT}, o AS (SELECT session_id, node AS name, other, row_number() OVER (PARTITION BY session_id, node ORDER BY other) AS n FROM (SELECT DISTINCT session_id, node, other FROM sym)),
  f AS (SELECT session_id, name, string_agg(other, ', ' ORDER BY other) AS others FROM o WHERE n <= 5 GROUP BY 1, 2)
  SELECT session_id, name, name || coalesce('. Related to: ' || others, '') || '. Mentioned ' || mention_count || ' times' AS text FROM ent LEFT JOIN f USING (session_id, name)"""))
def _(spark, d):
    return G.entity_context(*_tables(spark, d))


_WORDS = """wd AS (SELECT DISTINCT update_id, session_id, lower(regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) AS w FROM (SELECT update_id, session_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\s+')) AS w FROM tx)),
  te AS (SELECT DISTINCT update_id, wd.session_id, name FROM wd JOIN ent ON ent.session_id = wd.session_id AND lower(ent.name) = wd.w WHERE strlen(wd.w) >= 2)"""
_RICH = "concat_ws(' ', title, description, array_to_string(coalesce(creates_entities, []), ' '))"


def _rich(spark, d):
    names = F.array_join(F.coalesce("creates_entities", F.array().cast("array<string>")), " ")
    return T.updates(spark, d).select("update_id", "session_id", F.concat_ws(" ", "title", "description", names).alias("text"))


@query("gr11_text_entities", with_tables("upd mention edge", f", {ENT}, tx AS (SELECT update_id, session_id, {_RICH} AS text FROM upd), {_WORDS} SELECT update_id, session_id, name FROM te"))
def _(spark, d):
    return G.text_entities(_rich(spark, d), G.entities(T.mentions(spark, d)), "update_id")


@query("gr12_relevance", _TRACE + f", {_QE}, sc AS (SELECT session_id, origin, node, relation, depth, {_points('CASE depth WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 0 END')} AS relevance FROM tr r) SELECT * FROM sc WHERE relevance > 0")
def _(spark, d):
    e = T.edges(spark, d)
    traced = G.trace(e, _starts(e), 2).select("session_id", "origin", "node", "relation", "depth")
    return G.relevant(traced, _query_entities(e), e)


def _query_entities(edges):
    """The first source by name of each session, as the entities of a query."""
    return edges.groupBy("session_id").agg(F.min("src").alias("name"))


@query("gr13_query_analysis", with_tables("upd edge", f""", {SYM}, qe AS (SELECT session_id, min(src) AS name FROM edge GROUP BY 1),
  o AS (SELECT session_id, node AS name, other, row_number() OVER (PARTITION BY session_id, node ORDER BY other) AS n FROM (SELECT DISTINCT session_id, node, other FROM sym JOIN qe USING (session_id) WHERE node = qe.name))
  SELECT session_id, name, string_agg(other, '|' ORDER BY other) AS related FROM o WHERE n <= 5 GROUP BY 1, 2"""))
def _(spark, d):
    from sparkloom.operators import retrieval

    e = T.edges(spark, d)
    return retrieval.query_analysis(_query_entities(e), e).select("session_id", "name", F.array_join("related", "|").alias("related"))


@query("gr14_enriched_results", with_tables("upd mention edge", f""", {SYM}, {ENT}, {_QE}, tx AS (SELECT update_id, session_id, {_RICH} AS text FROM upd), {_WORDS},
  f3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY update_id, session_id ORDER BY name) AS n FROM te) WHERE n <= 3),
  fo AS (SELECT f3.update_id, f3.session_id, f3.name AS source, s.relation, s.other AS node FROM f3 JOIN sym s ON s.session_id = f3.session_id AND s.node = f3.name),
  r AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY update_id, session_id, node ORDER BY source, relation) AS n FROM fo) WHERE n = 1),
  sc AS (SELECT *, {_points('20')} AS relevance FROM r)
  SELECT * FROM (SELECT update_id, session_id, source, relation, node, relevance, CAST(row_number() OVER (PARTITION BY update_id, session_id ORDER BY relevance DESC, node) AS INTEGER) AS nth FROM sc) WHERE nth <= 10"""))
def _(spark, d):
    from sparkloom.operators import retrieval

    ent, e = _tables(spark, d)
    return retrieval.enriched(_rich(spark, d), _query_entities(e), ent, e, "update_id").select("update_id", "session_id", "source", "relation", "node", "relevance", "nth")


@query("gr15_connections")
def _(spark, d):
    from sparkloom.operators import retrieval

    named = T.mentions(spark, d).select("update_id", "session_id", "name")
    return retrieval.connections(named, T.edges(spark, d), "update_id").select("session_id", "left", "right", "origin", "target", F.size("path").alias("n"))


@query("gr16_expanded_search")
def _(spark, d):
    from sparkloom.operators import retrieval

    ent, e = _tables(spark, d)
    return retrieval.expanded_search(_rich(spark, d), "cache index parser", ent, e, "update_id")[1].select("update_id", "session_id", "name", F.array_join("related", "|").alias("related"))


@query("emb2_hashed_vectors", with_tables("upd", "SELECT update_id, 384 AS width FROM upd"))
def _(spark, d):
    from sparkloom.operators import retrieval

    v = retrieval.hashed_vectors(T.updates(spark, d), "update_id", "title")
    return v.select("update_id", F.size("vector").alias("width"))


_PAGE = "pg AS (SELECT * FROM (SELECT session_id, name, score, CAST(row_number() OVER (PARTITION BY session_id ORDER BY score DESC NULLS LAST, name) AS INTEGER) AS nth FROM imp) WHERE nth <= 50)"


@query("gr17_importance_page", with_tables("upd mention edge", f", {SYM}, {ENT}, {DEG}, {IMP}, {_PAGE} SELECT session_id, name, score, nth FROM pg"))
def _(spark, d):
    return G.network_page(_scored(spark, d), T.edges(spark, d))[0].select("session_id", "name", "score", "nth")


@query("tk9_network_page", with_tables("upd mention edge", f""", {SYM}, {ENT}, {DEG}, {IMP}, {_PAGE} SELECT * FROM (SELECT e.session_id, src, dst, relation, CAST(row_number() OVER (PARTITION BY e.session_id ORDER BY a.nth, b.nth, relation) AS INTEGER) AS nth
  FROM edge e JOIN pg a ON a.session_id = e.session_id AND a.name = e.src JOIN pg b ON b.session_id = e.session_id AND b.name = e.dst) WHERE nth <= 100"""))
def _(spark, d):
    return G.network_page(_scored(spark, d), T.edges(spark, d))[1]


@query("flt7_entity_search", with_tables("upd mention", f", {ENT} SELECT session_id, name FROM ent WHERE contains(lower(name), 'cache')"))
def _(spark, d):
    return G.entity_search(G.entities(T.mentions(spark, d)), "Cache").select("session_id", "name")


_TYPED = """, f AS (SELECT session_id, name, update_type, row_number() OVER (PARTITION BY session_id, name ORDER BY ts NULLS FIRST, update_id) AS n FROM mention),
  ty AS (SELECT session_id, name, CASE update_type WHEN 'CodeChanged' THEN 'CodeComponent' WHEN 'ProblemSolved' THEN 'Solution' WHEN 'DecisionMade' THEN 'Decision' WHEN 'ConceptDefined' THEN 'Concept' ELSE
    CASE WHEN regexp_matches(lower(name), 'rust|cargo|postgresql|postgres|jwt|json|api|http|sql|database|redis|docker|kubernetes|git|server|client|\\.rs$|\\.toml$') THEN 'Technology'
         WHEN regexp_matches(lower(name), 'bug|issue|problem|error|fail|crash|exception|panic') THEN 'Problem'
         WHEN regexp_matches(lower(name), 'function|method|struct|enum|trait|impl|module|lib|crate|package|/|::') THEN 'CodeComponent'
         WHEN regexp_matches(lower(name), 'fix|solution|resolve|implement|patch|update') THEN 'Solution' ELSE 'Concept' END END AS entity_type FROM f WHERE n = 1)"""


@query("flt8_entities_by_type", with_tables("upd mention", _TYPED + " SELECT session_id, name FROM ty WHERE entity_type = 'CodeComponent'"))
def _(spark, d):
    return G.of_type(G.typed_entities(T.mentions(spark, d)), "code_component").select("session_id", "name")


@query("ex11_typed_entities", with_tables("upd mention", _TYPED + " SELECT entity_type, count(*) AS n FROM ty GROUP BY 1"))
def _(spark, d):
    return G.typed_entities(T.mentions(spark, d)).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("sr20_entity_descriptions", with_tables("upd mention edge", f""", {SYM}, {ENT} {_TYPED}, o AS (SELECT session_id, node AS name, other, row_number() OVER (PARTITION BY session_id, node ORDER BY other) AS n FROM (SELECT DISTINCT session_id, node, other FROM sym)),
  g AS (SELECT session_id, name, string_agg(other, ', ' ORDER BY other) AS others FROM o WHERE n <= 5 GROUP BY 1, 2)
  SELECT session_id, name, name || '. Type: ' || entity_type || coalesce('. Related to: ' || others, '') || '. Mentioned ' || mention_count || ' times' AS text FROM ty JOIN ent USING (session_id, name) LEFT JOIN g USING (session_id, name)"""))
def _(spark, d):
    return G.entity_description(G.typed_entities(T.mentions(spark, d)), T.edges(spark, d))
