"""Queries for summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.operators import summary as Y
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


_PER = """, per AS (SELECT session_id, count(*) AS updates, count(CASE WHEN update_type = 'DecisionMade' THEN 1 END) AS decisions,
  count(CASE WHEN update_type = 'QuestionAnswered' THEN 1 END) AS questions, least(count(CASE WHEN update_type = 'ConceptDefined' THEN 1 END), 50) AS concepts,
  count(related_code) AS code_references FROM upd GROUP BY 1),
 nam AS (SELECT session_id, count(DISTINCT name) AS entities FROM mention GROUP BY 1),
 al AS (SELECT s.session_id, s.created_at, s.last_updated, coalesce(updates, 0) AS updates, coalesce(decisions, 0) AS decisions, coalesce(questions, 0) AS questions,
  coalesce(concepts, 0) AS concepts, coalesce(code_references, 0) AS code_references, coalesce(entities, 0) AS entities,
  date_sub('hour', created_at, last_updated) AS hours FROM session s LEFT JOIN per USING (session_id) LEFT JOIN nam USING (session_id))
 SELECT session_id, least(updates, 50) AS hot, updates, decisions, questions, concepts, code_references, entities,
  CASE WHEN hours BETWEEN 0 AND 1 THEN 'Short' WHEN hours BETWEEN 2 AND 4 THEN 'Medium' WHEN hours BETWEEN 5 AND 8 THEN 'Long' ELSE 'Extended' END AS duration,
  CASE WHEN rate > 10 THEN 'VeryHigh' WHEN rate > 5 THEN 'High' WHEN rate > 2 THEN 'Medium' WHEN rate > 0 THEN 'Low' ELSE 'Minimal' END AS activity,
  500 + 150 * decisions + 80 * entities + 100 * questions + 120 * concepts AS summary_tokens,
  500 + 150 * decisions + 80 * entities + 100 * questions + 120 * concepts > 50000 AS compact
 FROM (SELECT *, updates // greatest(hours, 1) AS rate FROM al)"""


@query("ag6_session_stats", with_tables("session upd mention", _PER))
def _(spark, d):
    return Y.session_stats(T.sessions(spark, d), T.updates(spark, d), T.mentions(spark, d))


@query("ag15_listing", with_tables("session upd mention", """SELECT s.session_id, coalesce(s.name, 'Unnamed') AS name, coalesce(u.n, 0) AS updates, coalesce(m.n, 0) AS entities FROM session s
  LEFT JOIN (SELECT session_id, count(*) AS n FROM upd GROUP BY 1) u USING (session_id) LEFT JOIN (SELECT session_id, count(DISTINCT name) AS n FROM mention GROUP BY 1) m USING (session_id)"""))
def _(spark, d):
    return Y.listing(T.sessions(spark, d), T.updates(spark, d), T.mentions(spark, d))


@query("tk6_key_decisions", with_tables("upd", """SELECT session_id, update_id, nth, level FROM (SELECT session_id, update_id, CASE WHEN coalesce(important, false) THEN 'High' ELSE 'Medium' END AS level,
  row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN coalesce(important, false) THEN 0.9 ELSE 0.7 END DESC, ts DESC NULLS LAST, update_id) AS nth
  FROM upd WHERE update_type = 'DecisionMade') WHERE nth <= 5"""))
def _(spark, d):
    return Y.key_decisions(T.updates(spark, d), limit=5).select("session_id", "update_id", "nth", "level")


@query("tk8_timeline", with_tables("upd", """SELECT session_id, update_id, row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, update_id) AS nth FROM upd WHERE update_type = 'DecisionMade'"""))
def _(spark, d):
    return Y.timeline(T.updates(spark, d)).select("session_id", "update_id", "nth")


@query("levels_questions", with_tables("upd", """SELECT session_id, update_id, status, days_open, CASE WHEN status = 'Open' AND days_open > 7 THEN 'High' WHEN status = 'Open' AND days_open > 3 THEN 'Medium' ELSE 'Low' END AS urgency FROM (
  SELECT session_id, update_id, CASE WHEN coalesce(trim(description), '') = '' THEN 'Open' ELSE 'Answered' END AS status, date_sub('day', ts, TIMESTAMP '2026-01-01') AS days_open FROM upd WHERE update_type = 'QuestionAnswered')"""))
def _(spark, d):
    return Y.question_levels(T.updates(spark, d), F.lit(NOW))


@query("levels_concepts", with_tables("upd", """SELECT session_id, update_id, name, CASE WHEN e > 3 AND r > 5 THEN 'High' WHEN e > 1 AND r > 2 THEN 'Medium' ELSE 'Low' END AS complexity FROM (
  SELECT session_id, update_id, title AS name, len(coalesce(examples, [])) AS e, len(coalesce(references_entities, [])) AS r,
   row_number() OVER (PARTITION BY session_id ORDER BY ts DESC NULLS LAST, update_id) AS n FROM upd WHERE update_type = 'ConceptDefined') WHERE n <= 50"""))
def _(spark, d):
    return Y.concept_levels(T.updates(spark, d))


@query("ag19_insights", with_tables("upd mention", """, sure AS (SELECT session_id, 1 AS part, ts, update_id, 'High-confidence decision: ' || coalesce(title, '') AS insight FROM upd WHERE update_type = 'DecisionMade' AND coalesce(important, false)),
  top AS (SELECT session_id, 2 AS part, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS update_id, 'Primary focus areas: ' || string_agg(name, ', ' ORDER BY name) AS insight FROM (
    SELECT session_id, name, row_number() OVER (PARTITION BY session_id ORDER BY name) AS n FROM (SELECT DISTINCT session_id, name FROM mention)) WHERE n <= 3 GROUP BY 1),
  many AS (SELECT session_id, 3, CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), 'Comprehensive discussion with ' || count(*) || ' updates' FROM upd GROUP BY 1 HAVING count(*) > 10),
  files AS (SELECT session_id, 4, CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), 'Multi-file code analysis covering ' || count(DISTINCT related_code.file_path) || ' files' FROM upd GROUP BY 1 HAVING count(DISTINCT related_code.file_path) > 1)
  SELECT session_id, nth, insight FROM (SELECT session_id, insight, row_number() OVER (PARTITION BY session_id ORDER BY part, ts NULLS FIRST, update_id) AS nth
    FROM (SELECT * FROM sure UNION ALL SELECT * FROM top UNION ALL SELECT * FROM many UNION ALL SELECT * FROM files)) WHERE nth <= 10"""))
def _(spark, d):
    scored = G.importance(G.entities(T.mentions(spark, d)), T.edges(spark, d))
    return Y.insights(T.updates(spark, d), scored)


@query("ag17_operation_metrics", """SELECT event_type AS operation, count(*) AS n, min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 6) AS avg_ms,
  round(avg(CASE WHEN event_id % 7 <> 0 THEN 0.0 ELSE 1.0 END), 6) AS error_rate,
  round(avg(CASE WHEN event_id % 7 <> 0 THEN 0.0 ELSE 1.0 END), 6) > 0.1 OR avg(value) > 2000 OR max(value) > 30000 AS problem FROM events GROUP BY 1""")
def _(spark, d):
    log = T.raw(spark, d, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("ms"), (F.col("event_id") % 7 != 0).alias("ok"))
    return Y.operation_metrics(log)


@query("ag18_cache_metrics", """SELECT event_type AS cache, count(*) AS n, round(avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(value), 6) AS avg_ms,
  (count(*) >= 100 AND avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END) < 0.3) OR avg(value) > 1 AS issue FROM events GROUP BY 1""")
def _(spark, d):
    log = T.raw(spark, d, "events").select(F.col("event_type").alias("cache"), F.col("value").alias("ms"), (F.col("event_id") % 4 == 0).alias("hit"))
    return Y.cache_metrics(log)
