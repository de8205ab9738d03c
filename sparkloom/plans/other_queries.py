"""Queries of extraction, indexes, stores, streams and the relational surface."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from sparkloom.operators import ann, extract, relational
from sparkloom.operators import search as S
from sparkloom.operators.lineage import shared_dir
from sparkloom.sources import export
from sparkloom.sources import tables as T
from sparkloom.sources.store import Store
from sparkloom.sources.tables import with_tables
from sparkloom.streaming import streams

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _texts(spark, d):
    u = T.updates(spark, d)
    return u.select("update_id", "update_type", F.concat_ws(" ", "title", "description").alias("text"))


_TEXT = "t AS (SELECT update_id, concat_ws(' ', title, description) AS text FROM upd)"


@query("ex2_proper_nouns", with_tables("upd", f""", {_TEXT}, w AS (SELECT DISTINCT update_id, word FROM (SELECT update_id, unnest(regexp_extract_all(regexp_replace(text, '[\\pL\\pN_-]*[^\\x00-\\x7F\\pP\\pS\\pZ][\\pL\\pN_-]*', '~', 'g'), '\\b[A-Z][a-zA-Z-]{{2,}}\\b')) AS word FROM t)
  WHERE length(word) <= 20 AND word NOT IN ({", ".join(f"'{w}'" for w in extract.COMMON)})) SELECT update_id, count(DISTINCT lower(word)) AS n FROM w GROUP BY 1"""))
def _(spark, d):
    t = _texts(spark, d)
    return t.select("update_id", F.size(extract.proper_nouns(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query("ex5_compounds")
def _(spark, d):
    return _texts(spark, d).select("update_id", F.explode(extract.compounds(F.col("text"))).alias("name"))


@query("ex1_entities")
def _(spark, d):
    return extract.extract(_texts(spark, d), "update_id")


@query("ex11_entity_types")
def _(spark, d):
    t = _texts(spark, d)
    e = extract.extract(t, "update_id", n=5).join(t.select("update_id", "update_type"), "update_id")
    return e.select("update_id", "name", extract.entity_type(F.col("update_type"), F.col("name")).alias("entity_type"))


@query("ex12_relationships")
def _(spark, d):
    t = _texts(spark, d)
    return extract.relationships(t, extract.extract(t, "update_id", n=10), "update_id")


@query("sr19_key_points")
def _(spark, d):
    e = T.embeddings(spark, d)
    return e.select("content_id", extract.key_points(F.col("text"), 300).alias("text"))


def _probes(e):
    """One content of 256, by its id, as queries."""
    return e.where("content_id LIKE '%00'").select(F.col("content_id").alias("query_id"), "vector")


@query("vec6_cell_search")
def _(spark, d):
    e = T.embeddings(spark, d).select("content_id", "vector")
    return ann.CellIndex(e).search(_probes(e), 10, "balanced")


@query("vec6_exact_search", with_tables("emb", """, q AS (SELECT content_id AS query_id, vector AS qv FROM emb WHERE content_id LIKE '%00'),
  s AS (SELECT query_id, content_id, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) AS similarity FROM emb, q)
  SELECT query_id, content_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, content_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""").replace(") , q", "), q"))
def _(spark, d):
    e = T.embeddings(spark, d).select("content_id", "vector")
    return ann.CellIndex(e).search(_probes(e), 10, "exact")


@query("vec7_index_maintenance", with_tables("emb", "SELECT content_id FROM emb WHERE content_id NOT LIKE '%1'"))
def _(spark, d):
    """Half of the store indexed, the other half inserted, a sixteenth deleted, then rebuilt."""
    e = T.embeddings(spark, d).select("content_id", "vector")
    index = ann.CellIndex(e.where("content_id < '8'"))
    index.insert(e.where("content_id >= '8'"))
    index.delete(e.where("content_id LIKE '%1'"))
    index.rebuild()
    return index.table.select("content_id")


@query("vec6_hyperplane_buckets")
def _(spark, d):
    c = ann.hyperplane_codes(T.embeddings(spark, d))
    return c.groupBy("table", "code").agg(F.count("*").alias("n"))


@query("vec14_product_codes")
def _(spark, d):
    e = T.embeddings(spark, d)
    return ann.ProductCodes(e).table(e).select("content_id", F.round("error", 6).alias("error"))


@query("src3_store_roundtrip", with_tables("session", "SELECT session_id, CASE WHEN session_id = (SELECT min(session_id) FROM session) THEN 'renamed' ELSE name END AS name FROM session WHERE session_id <> (SELECT max(session_id) FROM session)"))
def _(spark, d):
    s = T.sessions(spark, d).select("session_id", "name")
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.write("session", s)
    low, high = s.agg(F.min("session_id"), F.max("session_id")).head()
    store.write("session", s.where(F.col("session_id") == low).withColumn("name", F.lit("renamed")))
    store.delete("session", s.where(F.col("session_id") == high))
    store.compact("session")
    return store.read("session").select("session_id", "name")


@query("src16_export_roundtrip", with_tables("session upd", "SELECT s.session_id, coalesce(name, 'Unnamed') AS name, coalesce(n, 0) AS updates FROM session s LEFT JOIN (SELECT session_id, count(*) AS n FROM upd GROUP BY 1) USING (session_id)"))
def _(spark, d):
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}.gz"
    export.write_export(T.sessions(spark, d), T.updates(spark, d), path, exported_at=datetime(2026, 1, 1))
    out = export.list_sessions(export.read_export(spark, path))
    return out.select("session_id", "name", F.col("updates").cast("long").alias("updates"))


@query("src17_export_embeddings", with_tables("emb", "SELECT content_id, session_id, text, content_type, ts, round(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM emb"))
def _(spark, d):
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}.gz"
    export.write_export(T.sessions(spark, d), T.updates(spark, d), path, exported_at=datetime(2026, 1, 1), parts={"embeddings": T.embeddings(spark, d)})
    e = export.read_part(spark, path, "embeddings")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return e.select("content_id", "session_id", "text", "content_type", "ts", F.round(total, 4).alias("total"))


@query("src16_export_updates", with_tables("session upd", "SELECT update_id, u.session_id, u.ts, u.title, u.description, u.details, u.update_type, u.important FROM upd u JOIN session s ON s.session_id = u.session_id"))
def _(spark, d):
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}.gz"
    export.write_export(T.sessions(spark, d), T.updates(spark, d), path, exported_at=datetime(2026, 1, 1))
    u = export.read_export(spark, path).select("session_id", F.explode("updates").alias("u"))
    return u.select(F.col("u.id").alias("update_id"), "session_id", "u.ts", "u.content.title", "u.content.description", "u.content.details", "u.update_type", F.col("u.user_marked_important").alias("important"))


@query("src20_import_merge", with_tables("session", "SELECT session_id, CASE WHEN session_id < '8' THEN 'skipped' ELSE 'new' END AS action FROM session"))
def _(spark, d):
    s = T.sessions(spark, d).select("session_id")
    return export.merge(s, s.where("session_id < '8'")).select("session_id", "action")


def _events(spark, d):
    schema = T.raw(spark, d, "events").schema
    e = streams.read(spark, d, "events", schema)
    return e.select(F.col("event_id").cast("string").alias("update_id"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.array("event_type").alias("names"))


@query("st1_mention_counts", "SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS name, count(*) AS n, min(ts) AS first_mentioned, max(ts) AS last_mentioned FROM events GROUP BY 1, 2")
def _(spark, d):
    return streams.run_to_table(streams.mention_counts(_events(spark, d)), "mentions", "complete")


@query("st2_active_sessions", """SELECT CAST(user_id AS VARCHAR) AS session_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, run""")
def _(spark, d):
    return streams.run_to_table(streams.active_sessions(_events(spark, d)), "sessions", "complete")


@query("st3_rings", "SELECT CAST(user_id AS VARCHAR) AS session_id, seq, CAST(event_id AS VARCHAR) AS update_id, CAST(least(seq, 50) AS INTEGER) AS ring_size, seq % 100 = 0 AS snapshot FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS seq FROM events)")
def _(spark, d):
    return streams.run_to_table(streams.rings(_events(spark, d)), "rings", "append")


@query("st5_without_duplicates", "SELECT CAST(event_id AS VARCHAR) AS update_id FROM events GROUP BY 1")
def _(spark, d):
    return streams.run_to_table(streams.without_duplicates(_events(spark, d)), "unique", "append").select("update_id")


@query("st6_activity", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return streams.run_to_table(streams.activity(_events(spark, d)), "activity", "complete")


@query("rel_as_of_join", """SELECT l.event_id, (SELECT r.event_id FROM events r WHERE r.user_id = l.user_id AND r.event_type = 'signup' AND r.ts <= l.ts ORDER BY r.ts DESC, r.event_id DESC LIMIT 1) AS signup
  FROM events l WHERE l.event_type = 'purchase'""")
def _(spark, d):
    e = T.raw(spark, d, "events")
    # of sign-ups at the same time the greatest number counts
    s = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("signup"))
    return relational.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), s, ["user_id"], columns=["signup"]).select("event_id", "signup")


@query("rel_range_join", "SELECT p_partkey, l_orderkey, l_linenumber FROM (SELECT * FROM part WHERE p_size = 1) JOIN lineitem ON l_extendedprice BETWEEN p_retailprice AND p_retailprice + 5")
def _(spark, d):
    p = T.raw(spark, d, "part").where("p_size = 1").select("p_partkey", F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 5).alias("high"))
    points = T.raw(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return relational.range_join(points, p, "l_extendedprice", "low", "high", 50.0).select("p_partkey", "l_orderkey", "l_linenumber")


@query("rel_range_join_all")
def _(spark, d):
    p = T.raw(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 5).alias("high"))
    points = T.raw(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return relational.range_join(points, p, "l_extendedprice", "low", "high", 50.0).select("p_partkey", "l_orderkey", "l_linenumber")


@query("rel_salted_sum", "SELECT l_returnflag, round(sum(l_quantity), 4) AS total, count(l_quantity) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    s = relational.salted_sum(T.raw(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")
    return s.select("l_returnflag", F.round("total", 4).alias("total"), "n")


@query("rel_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def _(spark, d):
    li = T.raw(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit(datetime(1998, 9, 2)))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("rel_cube", "SELECT n_name, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, o_orderstatus)")
def _(spark, d):
    o = T.raw(spark, d, "orders").join(T.raw(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(T.raw(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).cube("n_name", "o_orderstatus").agg(F.count("*").alias("n"))


@query("rel_set_operations", "(SELECT p_brand AS x FROM part UNION SELECT o_orderpriority FROM orders) EXCEPT SELECT p_brand FROM part WHERE p_size > 40")
def _(spark, d):
    p = T.raw(spark, d, "part")
    both = p.select(F.col("p_brand").alias("x")).union(T.raw(spark, d, "orders").select("o_orderpriority"))
    return both.distinct().exceptAll(p.where("p_size > 40").select("p_brand").distinct())


@query("jn6_text_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'cookie')")
def _(spark, d):
    from sparkloom.functions.text import contains

    return T.raw(spark, d, "documents").where(contains(F.col("text"), "Cookie")).select("doc_id")


@query("vec5_small_vectors", """WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
  SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) AS similarity FROM embeddings, q""")
def _(spark, d):
    from sparkloom.functions.vectors import cosine

    e = T.raw(spark, d, "embeddings")
    probe = e.orderBy("vec_id").select("embedding").head()[0]
    return e.select("vec_id", F.round(cosine("embedding", S.vector_literal(probe)), 6).alias("similarity"))
