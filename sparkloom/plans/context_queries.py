"""Queries on updates: lookups, projections, windows, derived state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import context as C
from sparkloom.sources import tables as T
from sparkloom.sources.tables import with_tables

FROM, TO = datetime(2025, 6, 1), datetime(2025, 9, 1)
QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("src1_list_sessions", with_tables("session", "SELECT session_id FROM session"))
def _(spark, d):
    return T.sessions(spark, d).select("session_id")


@query("src5_session_updates", with_tables("upd", "SELECT session_id, update_id, ts, update_type FROM upd"))
def _(spark, d):
    return T.updates(spark, d).select("session_id", "update_id", "ts", "update_type")


@query("src9_workspaces", with_tables("ws", "SELECT workspace_id, count(*) AS sessions, min(role) AS first_role FROM ws GROUP BY 1"))
def _(spark, d):
    return T.workspace_sessions(spark, d).groupBy("workspace_id").agg(F.count("*").alias("sessions"), F.min("role").alias("first_role"))


@query("flt1_recent_changes", with_tables("upd", "SELECT session_id, update_id, ts FROM upd WHERE ts >= TIMESTAMP '2025-06-01'"))
def _(spark, d):
    return C.recent_changes(T.updates(spark, d), F.lit(FROM)).select("session_id", "update_id", "ts")


@query("flt11_date_range", with_tables("upd", "SELECT update_id, ts FROM upd WHERE ts BETWEEN TIMESTAMP '2025-06-01' AND TIMESTAMP '2025-09-01'"))
def _(spark, d):
    return C.between(T.updates(spark, d), FROM, TO).select("update_id", "ts")


@query("flt2_code_references", with_tables("upd", "SELECT session_id, update_id, related_code.file_path AS file_path, related_code.start_line AS start_line, related_code.end_line AS end_line FROM upd WHERE related_code IS NOT NULL"))
def _(spark, d):
    return C.code_references(T.updates(spark, d)).select("session_id", "update_id", "file_path", "start_line", "end_line")


@query("flt3_decisions", with_tables("upd", """SELECT session_id, update_id, title AS description,
  CAST(CASE WHEN coalesce(important, false) THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence FROM upd WHERE update_type = 'DecisionMade'"""))
def _(spark, d):
    return C.decisions(T.updates(spark, d)).select("session_id", "update_id", "description", "confidence")


@query("flt4_change_history", with_tables("upd", "SELECT session_id, update_id, title FROM upd WHERE update_type = 'CodeChanged'"))
def _(spark, d):
    return C.of_type(T.updates(spark, d), "CodeChanged").select("session_id", "update_id", "title")


@query("flt5_keyword_search", with_tables("upd", """SELECT session_id, update_id FROM upd
  WHERE contains(lower(coalesce(title, '')), 'broken') OR contains(lower(coalesce(description, '')), 'broken')"""))
def _(spark, d):
    return C.keyword_search(T.updates(spark, d), "Broken").select("session_id", "update_id")


@query("flt6_session_search", with_tables("session", """SELECT session_id, name FROM session
  WHERE contains(lower(coalesce(name, '')), 'notes') OR contains(lower(coalesce(description, '')), 'notes')"""))
def _(spark, d):
    return C.session_search(T.sessions(spark, d), "Notes").select("session_id", "name")


@query("flt10_open_questions", with_tables("upd", """SELECT session_id, update_id, title AS question FROM upd
  WHERE update_type = 'QuestionAnswered' AND coalesce(trim(description), '') = ''"""))
def _(spark, d):
    return C.open_questions(T.updates(spark, d)).select("session_id", "update_id", "question")


@query("flt16_pending_vectors", with_tables("upd emb", "SELECT update_id FROM upd WHERE update_id NOT IN (SELECT content_id FROM emb)"))
def _(spark, d):
    return C.pending(T.updates(spark, d), T.embeddings(spark, d)).select("update_id")


@query("flt16_stale_vectors", with_tables("upd emb", "SELECT content_id FROM emb WHERE content_id NOT IN (SELECT update_id FROM upd)"))
def _(spark, d):
    return C.stale(T.embeddings(spark, d), T.updates(spark, d)).select("content_id")


@query("flt17_mark_important", with_tables("upd", """SELECT update_id, CASE WHEN update_id = (SELECT min(update_id) FROM upd) THEN true ELSE important END AS important FROM upd"""))
def _(spark, d):
    u = T.updates(spark, d)
    return C.mark_important(u, u.agg(F.min("update_id")).head()[0]).select("update_id", "important")


_HOT = """SELECT session_id, update_id, nth FROM (SELECT session_id, update_id, row_number() OVER
  (PARTITION BY session_id ORDER BY ts DESC NULLS LAST, update_id) AS nth FROM upd) WHERE nth <= {0}"""


@query("wn1_hot_context", with_tables("upd", _HOT.format(50)))
def _(spark, d):
    return C.hot_context(T.updates(spark, d)).select("session_id", "update_id", "nth")


@query("wn2_newest", with_tables("upd", _HOT.format(3)))
def _(spark, d):
    return C.hot_context(T.updates(spark, d), 3).select("session_id", "update_id", "nth")


@query("wn5_flow", with_tables("upd", """SELECT session_id, update_id, step, nth FROM (SELECT session_id, update_id,
  CASE update_type WHEN 'QuestionAnswered' THEN 'Q&A: ' WHEN 'ProblemSolved' THEN 'Problem solved: ' WHEN 'CodeChanged' THEN 'Code changed: '
    WHEN 'DecisionMade' THEN 'Decision: ' WHEN 'ConceptDefined' THEN 'Concept: ' WHEN 'RequirementAdded' THEN 'Requirement: ' ELSE '' END || coalesce(title, '') AS step,
  row_number() OVER (PARTITION BY session_id ORDER BY ts DESC NULLS LAST, update_id) AS nth FROM upd) WHERE nth <= 500"""))
def _(spark, d):
    return C.flow(T.updates(spark, d)).select("session_id", "update_id", "step", "nth")


@query("wn6_concepts", with_tables("upd", """SELECT session_id, update_id, name FROM (SELECT session_id, update_id, title AS name,
  row_number() OVER (PARTITION BY session_id ORDER BY ts DESC NULLS LAST, update_id) AS n FROM upd WHERE update_type = 'ConceptDefined') WHERE n <= 50"""))
def _(spark, d):
    return C.concepts(T.updates(spark, d)).select("session_id", "update_id", "name")


@query("wn7_snapshots", with_tables("upd", """SELECT session_id, update_id, seq FROM (SELECT session_id, update_id,
  row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, update_id) AS seq FROM upd) WHERE seq % 20 = 0"""))
def _(spark, d):
    return C.snapshots(T.updates(spark, d), 20).select("session_id", "update_id", "seq")


@query("wn8_latest_update", with_tables("upd", """SELECT session_id, update_id, ts FROM (SELECT session_id, update_id, ts,
  row_number() OVER (PARTITION BY session_id ORDER BY ts DESC NULLS LAST, update_id DESC) AS n FROM upd) WHERE n = 1"""))
def _(spark, d):
    return C.latest_update(T.updates(spark, d))


@query("specifications", with_tables("upd", "SELECT session_id, update_id, title, CAST(len(coalesce(details, [])) AS BIGINT) AS n FROM upd WHERE update_type = 'RequirementAdded'"))
def _(spark, d):
    return C.specifications(T.updates(spark, d)).select("session_id", "update_id", "title", F.size("requirements").cast("long").alias("n"))


@query("prj4_indexed_types", with_tables("upd", """SELECT CASE update_type WHEN 'QuestionAnswered' THEN 'UserMessage' WHEN 'ProblemSolved' THEN 'ProblemSolution'
  WHEN 'CodeChanged' THEN 'CodeSnippet' WHEN 'DecisionMade' THEN 'DecisionPoint' ELSE 'UpdateContent' END AS content_type, count(*) AS n FROM upd GROUP BY 1"""))
def _(spark, d):
    return T.updates(spark, d).groupBy(C.indexed_type(F.col("update_type")).alias("content_type")).agg(F.count("*").alias("n"))


@query("prj6_change_records", with_tables("upd", """SELECT update_id,
  CASE WHEN length(title) > 200 THEN left(title, 190) || '...' ELSE title END AS title,
  CASE WHEN length(description) > 2000 THEN left(description, 1800) || '... (truncated)' ELSE description END AS description FROM upd"""))
def _(spark, d):
    return C.change_records(T.updates(spark, d)).select("update_id", "title", "description")


@query("sr17_search_texts", with_tables("upd", """SELECT update_id, text FROM (SELECT update_id, array_to_string(list_filter(
  [title, description] || coalesce(details, []) || coalesce(examples, []) || coalesce(implications, []) || [related_code.code_snippet, related_code.file_path],
  lambda x: x IS NOT NULL), ' ') AS text FROM upd) WHERE strlen(trim(text, ' ')) >= 10"""))
def _(spark, d):
    return C.search_texts(T.updates(spark, d)).select("update_id", "text")


@query("sr14_themes", with_tables("upd", """SELECT update_id, array_to_string(list_slice(list_filter(string_split_regex(coalesce(description, ''), '\\s+'), lambda x: strlen(x) > 3), 1, 3), ' ') AS theme FROM upd"""))
def _(spark, d):
    return T.updates(spark, d).select("update_id", text.theme(F.coalesce("description", F.lit(""))).alias("theme"))


@query("prj2_entities", with_tables("upd", """SELECT update_id, array_to_string(list_filter(list_transform(string_split_regex(coalesce(title, ''), '[, ]'), lambda x: trim(x)), lambda x: strlen(x) > 2), '|') AS names FROM upd"""))
def _(spark, d):
    return T.updates(spark, d).select("update_id", F.array_join(C.explicit_entities(F.coalesce("title", F.lit(""))), "|").alias("names"))


@query("prj1_interactions")
def _(spark, d):
    u = T.updates(spark, d)
    kind = F.element_at(F.create_map(*(F.lit(x) for k, v in C.MAPPING.items() for x in (v[0], k))), F.col("update_type"))
    content = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.coalesce(v, F.lit(""))) for k, v in (
        ("question", F.col("title")), ("answer", F.col("description")), ("decision", F.col("title")), ("entities", F.col("title")), ("relationships", F.lit("a DEPENDS_ON b, c uses d e"))))))
    out = C.from_interactions(u.select("update_id", kind.alias("interaction_type"), content.alias("content")))
    return out.select("update_id", "update_type", "title", F.size("details").alias("n_details"), F.size("creates_relationships").alias("n_edges"), "error")


@query("ag13_code_by_file", with_tables("upd", """SELECT related_code.file_path AS file_path, count(*) AS n, min(related_code.start_line) AS first_line,
  max(related_code.end_line) AS last_line, max(ts) AS newest, count(DISTINCT session_id) AS sessions FROM upd WHERE related_code IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    from sparkloom.operators.summary import by_file

    return by_file(T.updates(spark, d))


@query("ag10_term_frequency", with_tables("upd", """SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(description), '[a-z][a-z0-9_]{2,14}')) AS term FROM upd) GROUP BY 1"""))
def _(spark, d):
    terms = F.explode(F.regexp_extract_all(F.lower("description"), F.lit("[a-z][a-z0-9_]{2,14}"), 0)).alias("term")
    return T.updates(spark, d).select(terms).groupBy("term").agg(F.count("*").alias("n"))
