"""Queries on vectors and search results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sparkloom.functions import scoring
from sparkloom.functions import vectors as V
from sparkloom.operators import search as S
from sparkloom.sources import tables as T
from sparkloom.sources.tables import with_tables

NOW = datetime(2026, 1, 1)
QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def probe(store):
    """The vector of the first content by id; the id is found first, and its rows only are compared."""
    first = store.agg(F.min("content_id")).head()[0]
    return store.where(F.col("content_id") == first).select("vector").head()[0]


Q = "q AS (SELECT vector AS qv FROM emb ORDER BY content_id LIMIT 1)"
KIND = "CASE WHEN content_type IN ('DecisionPoint','ProblemSolution','UserMessage','UpdateContent','CodeSnippet','EntityDescription','SessionMetadata') THEN content_type ELSE 'UpdateContent' END"
WEIGHT = f"CASE {KIND} WHEN 'DecisionPoint' THEN 1.0 WHEN 'ProblemSolution' THEN 0.9 WHEN 'UserMessage' THEN 0.8 WHEN 'UpdateContent' THEN 0.7 WHEN 'CodeSnippet' THEN 0.6 WHEN 'EntityDescription' THEN 0.5 ELSE 0.3 END"
SIM = "round(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6)"
QUALITY = "CASE WHEN similarity >= 0.85 THEN 'Excellent' WHEN similarity >= 0.7 THEN 'Very Good' WHEN similarity >= 0.55 THEN 'Good' WHEN similarity >= 0.4 THEN 'Moderate' WHEN similarity >= 0.3 THEN 'Fair' ELSE 'Weak' END"


def search_sql(where: str = "true", limit: int = 10, decay: str = "1.0", having: str = "true", extra: str = "") -> str:
    body = f""", {Q}, s AS (SELECT content_id, session_id, content_type, ts, {SIM} AS similarity, CAST({WEIGHT} AS DOUBLE) AS importance FROM emb, q WHERE {where}),
    r AS (SELECT content_id, similarity, importance, (similarity * 0.7 + importance * 0.3) * ({decay}) AS raw, {QUALITY} AS quality FROM s WHERE {having})
    SELECT content_id, similarity, importance, round(raw, 7) AS score, quality FROM r ORDER BY raw DESC, content_id LIMIT {limit}"""
    return with_tables(f"emb {extra}".strip(), "").rstrip() + body


DECAY = "exp(-0.5 * greatest(date_sub('day', ts, TIMESTAMP '2026-01-01'), 0) / 365.0)"


def shown(hits):
    return hits.select("content_id", "similarity", "importance", F.round("score", 7).alias("score"), "quality")


@query("sr1_global_search", search_sql())
def _(spark, d):
    e = T.embeddings(spark, d)
    return shown(S.semantic_search(e, probe(e)))


@query("sr1_session_search", search_sql("session_id = (SELECT session_id FROM emb WHERE session_id IS NOT NULL ORDER BY content_id LIMIT 1)"))
def _(spark, d):
    e = T.embeddings(spark, d)
    session = e.where("session_id IS NOT NULL").orderBy("content_id").select("session_id").head()[0]
    return shown(S.semantic_search(S.scoped(e, "session", session), probe(e)))


@query(
    "sr2_workspace_recency",
    search_sql("session_id IN (SELECT session_id FROM ws WHERE workspace_id = (SELECT min(workspace_id) FROM ws)) AND ts BETWEEN TIMESTAMP '2025-01-01' AND TIMESTAMP '2025-12-31'", decay=DECAY, extra="ws"),
)
def workspace_recency(spark, d):
    e, w = T.embeddings(spark, d), T.workspace_sessions(spark, d)
    workspace = w.agg(F.min("workspace_id")).head()[0]
    own = S.scoped(e, "workspace", workspace=w, workspace_id=workspace)
    return shown(S.semantic_search(own, probe(e), date_range=(datetime(2025, 1, 1), datetime(2025, 12, 31)), now=NOW, bias=0.5))


@query("flt12_type_filter", search_sql(f"{KIND} IN ('DecisionPoint', 'CodeSnippet')"))
def _(spark, d):
    e = T.embeddings(spark, d)
    return shown(S.semantic_search(e, probe(e), content_types=["DecisionPoint", "CodeSnippet"]))


@query("flt13_threshold", search_sql(having="similarity >= 0.3", limit=50))
def _(spark, d):
    e = T.embeddings(spark, d)
    return shown(S.semantic_search(e, probe(e), 50, least=0.3))


@query("flt14_quality", search_sql(having="similarity >= 0.4", limit=50))
def _(spark, d):
    e = T.embeddings(spark, d)
    return shown(S.semantic_search(e, probe(e), 50, quality="moderate"))


@query("sr9_related_content", search_sql("coalesce(session_id <> (SELECT session_id FROM emb WHERE session_id IS NOT NULL ORDER BY content_id LIMIT 1), true)", limit=5))
def _(spark, d):
    e = T.embeddings(spark, d)
    session = e.where("session_id IS NOT NULL").orderBy("content_id").select("session_id").head()[0]
    return shown(S.related_content(e, probe(e), session))


@query("sr6_adjusters", search_sql(decay=f"{DECAY} * 2.0", limit=20))
def _(spark, d):
    e = T.embeddings(spark, d)
    return shown(S.semantic_search(e, probe(e), 20, now=NOW, bias=0.5, adjusters=[scoring.scale(2.0)]))


@query("vec1_batch_search", with_tables("emb", """, q AS (SELECT content_id AS query_id, vector AS qv FROM emb ORDER BY content_id LIMIT 20),
  s AS (SELECT query_id, content_id, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) AS similarity FROM emb, q)
  SELECT query_id, content_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, content_id) AS rank FROM s) WHERE rank <= 10""").replace(") , q", "), q"))
def _(spark, d):
    e = T.embeddings(spark, d)
    q = e.orderBy("content_id").limit(20).select(F.col("content_id").alias("query_id"), "vector")
    return S.batch_search(e, q)


@query("vec2_euclidean", with_tables("emb", f", {Q} SELECT content_id, round(list_distance(CAST(vector AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) AS distance FROM emb, q"))
def _(spark, d):
    e = T.embeddings(spark, d)
    return e.select("content_id", F.round(V.euclidean("vector", S.vector_literal(probe(e))), 6).alias("distance"))


@query("vec3_normalise", with_tables("emb", "SELECT content_id, round(sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, CAST(1.0 AS DOUBLE) AS unit_norm FROM emb"))
def _(spark, d):
    e = T.embeddings(spark, d)
    return e.select("content_id", F.round(V.norm("vector"), 6).alias("norm"), F.round(V.norm(V.normalise("vector")), 6).alias("unit_norm"))


@query("vec13_quantise", with_tables("emb", "SELECT content_id, list_sum(list_transform(vector, lambda x: greatest(0, least(255, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT)))))::BIGINT AS total FROM emb"))
def _(spark, d):
    return T.embeddings(spark, d).select("content_id", F.aggregate(V.quantise("vector"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("vec16_dimension", "SELECT count(*) AS n, count(CASE WHEN len(vector) = 128 THEN 1 END) AS ok FROM stored_embedding")
def _(spark, d):
    e = T.raw(spark, d, "stored_embedding")
    return e.agg(F.count("*").alias("n"), F.count(F.when(V.has_dimension("vector", 128), 1)).alias("ok"))


@query("ag7_similar_sessions", with_tables("res", """SELECT session_id, round(avg(CAST(similarity_score AS DOUBLE)), 6) AS similarity, count(*) AS n FROM res
  WHERE session_id IS NOT NULL AND similarity_score IS NOT NULL AND NOT isnan(similarity_score) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def _(spark, d):
    return S.similar_sessions(T.results(spark, d))


@query("ag9_best_per_content", with_tables("res", """SELECT content_id, result_id FROM (SELECT content_id, result_id, row_number() OVER
  (PARTITION BY content_id ORDER BY CAST(combined_score AS DOUBLE) DESC NULLS LAST, ts DESC NULLS LAST, result_id) AS n FROM res
  WHERE content_id IS NOT NULL AND combined_score IS NOT NULL AND NOT isnan(combined_score)) WHERE n = 1"""))
def _(spark, d):
    r = T.results(spark, d).where("content_id IS NOT NULL AND combined_score IS NOT NULL AND NOT isnan(combined_score)")
    best = F.max_by("result_id", F.struct(F.col("combined_score").cast("double"), F.coalesce(F.col("ts"), F.lit(datetime(1, 1, 1))), -F.col("result_id")))
    return r.groupBy("content_id").agg(best.alias("result_id"))


@query("sr12_patterns", with_tables("res", f"""SELECT content_type, n, CASE WHEN n > 3 THEN 'strong' WHEN n > 2 THEN 'clear' ELSE 'weak' END AS strength FROM (
  SELECT {KIND} AS content_type, count(*) AS n FROM res GROUP BY 1) WHERE n > 1"""))
def _(spark, d):
    return S.patterns(T.results(spark, d))


@query("sr7_quality_counts", with_tables("res", """SELECT CASE WHEN s >= 0.85 THEN 'Excellent' WHEN s >= 0.7 THEN 'Very Good' WHEN s >= 0.55 THEN 'Good' WHEN s >= 0.4 THEN 'Moderate' WHEN s >= 0.3 THEN 'Fair' ELSE 'Weak' END AS quality,
  count(*) AS n FROM (SELECT CAST(similarity_score AS DOUBLE) AS s FROM res WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score)) GROUP BY 1"""))
def _(spark, d):
    s = F.col("similarity_score").cast("double")
    return T.results(spark, d).where(s.isNotNull() & ~F.isnan(s)).groupBy(scoring.quality(s).alias("quality")).agg(F.count("*").alias("n"))


@query("sr5_decay", with_tables("res", """SELECT result_id, round(s * exp(-1.0 * greatest(date_sub('day', ts, TIMESTAMP '2026-01-01'), 0) / 365.0), 6) AS decayed
  FROM (SELECT result_id, ts, CAST(similarity_score AS DOUBLE) AS s FROM res WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) AND ts IS NOT NULL)"""))
def _(spark, d):
    s = F.col("similarity_score").cast("double")
    r = T.results(spark, d).where(s.isNotNull() & ~F.isnan(s) & F.col("ts").isNotNull())
    return r.select("result_id", F.round(scoring.recency(F.col("ts"), F.lit(NOW), 1.0)(s), 6).alias("decayed"))


@query("ag16_vector_counts", with_tables("emb", "SELECT session_id, count(CASE WHEN coalesce(content_type, '') <> 'EntityDescription' THEN 1 END) AS n, count(CASE WHEN coalesce(content_type, '') <> 'EntityDescription' THEN 1 END) > 0 AS has_vectors FROM emb GROUP BY 1"))
def _(spark, d):
    from sparkloom.operators.summary import vector_counts

    return vector_counts(T.embeddings(spark, d))


_SESSION = "(SELECT session_id FROM emb WHERE session_id IS NOT NULL ORDER BY content_id LIMIT 1)"


@query("sr11_restore_confidence", with_tables("emb", f""", {Q}, s AS (SELECT content_id, session_id, {SIM} AS similarity, CAST({WEIGHT} AS DOUBLE) AS importance FROM emb, q),
  own AS (SELECT avg(similarity) AS m FROM (SELECT similarity FROM s WHERE session_id = {_SESSION} ORDER BY similarity * 0.7 + importance * 0.3 DESC, content_id LIMIT 10)),
  rel AS (SELECT avg(similarity) AS m FROM (SELECT similarity FROM s WHERE coalesce(session_id <> {_SESSION}, true) AND similarity >= 0.7 ORDER BY similarity * 0.7 + importance * 0.3 DESC, content_id LIMIT 10))
  SELECT round(least(1.0, coalesce(own.m, 0.0) * 0.7 + coalesce(rel.m, 0.0) * 0.3), 6) AS confidence FROM own, rel"""))
def _(spark, d):
    e = T.embeddings(spark, d)
    session = e.where("session_id IS NOT NULL").orderBy("content_id").select("session_id").head()[0]
    return S.restore_context(e, probe(e), session)["confidence"]


@query("prj7_formatted", search_sql().replace("content_id, similarity, importance, round(raw, 7) AS score, quality FROM r ORDER BY raw DESC, content_id LIMIT 10", f"""e.text AS content, round(raw, 7) AS score, e.session_id, {KIND.replace("content_type", "e.content_type")} AS type, e.ts AS timestamp,
  CAST(row_number() OVER (ORDER BY raw DESC, content_id) AS INTEGER) AS rank FROM r JOIN emb e USING (content_id) ORDER BY raw DESC, content_id LIMIT 10"""))
def _(spark, d):
    e = T.embeddings(spark, d)
    return S.formatted(S.semantic_search(e, probe(e)))


@query("sr10_related_experiences", search_sql("coalesce(session_id <> (SELECT session_id FROM emb WHERE session_id IS NOT NULL ORDER BY content_id LIMIT 1), true)", having="similarity >= 0.2", limit=10))
def _(spark, d):
    e = T.embeddings(spark, d)
    session = e.where("session_id IS NOT NULL").orderBy("content_id").select("session_id").head()[0]
    return shown(S.related_experiences(e, probe(e), session, least=0.2))


@query("sr8_explanations", """SELECT result_id, printf('Combined Score: %.4f = (Similarity: %.4f × 0.7) + (Importance: %.2f × 0.3) | Quality: %s', c, s, i,
  CASE WHEN s >= 0.85 THEN 'Excellent' WHEN s >= 0.7 THEN 'Very Good' WHEN s >= 0.55 THEN 'Good' WHEN s >= 0.4 THEN 'Moderate' WHEN s >= 0.3 THEN 'Fair' ELSE 'Weak' END) AS explanation
  FROM (SELECT result_id, CAST(combined_score AS DOUBLE) AS c, CAST(similarity_score AS DOUBLE) AS s, CAST(importance_score AS DOUBLE) AS i FROM semantic_search_result
    WHERE combined_score IS NOT NULL AND similarity_score IS NOT NULL AND importance_score IS NOT NULL AND NOT isnan(combined_score) AND NOT isnan(similarity_score) AND NOT isnan(importance_score))""")
def _(spark, d):
    r = T.results(spark, d)
    for c in ("combined_score", "similarity_score", "importance_score"):
        r = r.where(F.col(c).isNotNull() & ~F.isnan(c))
    return S.explained(r)


@query("sr18_worth_indexing", "SELECT count(*) AS n FROM semantic_search_result WHERE strlen(trim(text_content, ' ')) >= 10")
def _(spark, d):
    from sparkloom.functions.text import worth_indexing

    return T.results(spark, d).where(worth_indexing(F.col("text_content"))).agg(F.count("*").alias("n"))


@query("jn2_workspace_members", with_tables("emb ws", "SELECT workspace_id, count(*) AS n FROM emb JOIN ws USING (session_id) GROUP BY 1"))
def _(spark, d):
    return T.embeddings(spark, d).join(T.workspace_sessions(spark, d), "session_id").groupBy("workspace_id").agg(F.count("*").alias("n"))


@query("vec12_nearest_clamped", with_tables("emb", """, q AS (SELECT content_id AS query_id, vector AS qv FROM emb ORDER BY content_id LIMIT 20),
  s AS (SELECT query_id, content_id, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) AS similarity FROM emb, q)
  SELECT query_id, content_id, greatest(similarity, 0.0) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, content_id) AS rank FROM s) WHERE rank <= 10""").replace(") , q", "), q"))
def _(spark, d):
    e = T.embeddings(spark, d)
    return S.nearest_clamped(e, e.orderBy("content_id").limit(20).select(F.col("content_id").alias("query_id"), "vector"))


@query("sr13_sessions_like", with_tables("emb", """, q AS (SELECT content_id AS query_id, vector AS qv FROM emb ORDER BY content_id LIMIT 4),
  s AS (SELECT query_id, content_id, session_id, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) AS similarity FROM emb, q),
  h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, content_id) AS rank FROM s) WHERE rank <= 10)
  SELECT session_id, round(avg(similarity), 6) AS similarity, count(*) AS n FROM h WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""").replace(") , q", "), q"))
def _(spark, d):
    e = T.embeddings(spark, d)
    return S.sessions_like(e, e.orderBy("content_id").limit(4).select(F.col("content_id").alias("query_id"), "vector"))


@query("sr15_text_similarity", with_tables("emb", f", {Q} SELECT content_id, {SIM} AS similarity FROM emb, q"))
def _(spark, d):
    e = T.embeddings(spark, d)
    return e.select("content_id", F.round(S.text_similarity("vector", S.vector_literal(probe(e))), 6).alias("similarity"))


@query("page_of_results", with_tables("res", "SELECT result_id FROM res WHERE combined_score IS NOT NULL AND NOT isnan(combined_score) ORDER BY combined_score DESC, result_id LIMIT 50 OFFSET 50"))
def _(spark, d):
    r = T.results(spark, d).where("combined_score IS NOT NULL AND NOT isnan(combined_score)")
    return S.page(r, [F.col("combined_score").desc(), F.col("result_id")], 50, 50).select("result_id")
