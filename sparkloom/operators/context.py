"""Updates of sessions: projections, typed lookups, ring windows and derived state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text, validate
from sparkloom.functions.scoring import lookup
from sparkloom.sources.model import INDEXED_AS


def newest_first() -> list[Column]:
    return [F.col("ts").desc_nulls_last(), F.col("update_id").asc()]


def hot_context(updates: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` updates of each session; pruned per partition before the shuffle."""
    w = Window.partitionBy("session_id").orderBy(*newest_first())
    return updates.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def latest_update(updates: DataFrame) -> DataFrame:
    return updates.groupBy("session_id").agg(F.max_by("update_id", F.struct("ts", "update_id")).alias("update_id"), F.max("ts").alias("ts"))


def snapshots(updates: DataFrame, every: int = 100) -> DataFrame:
    """The updates at which a periodic snapshot falls due."""
    w = Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_first(), F.col("update_id"))
    return updates.withColumn("seq", F.row_number().over(w)).where(F.col("seq") % every == 0)


def recent_changes(updates: DataFrame, since: datetime | Column, until: Column | None = None) -> DataFrame:
    out = updates.where(F.col("ts") >= since)
    return out if until is None else out.where(F.col("ts") <= until)


def between(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Both ends included."""
    validate.date_range(start, end)
    return df.where(F.col("ts").between(F.lit(start), F.lit(end)))


def of_type(updates: DataFrame, *kinds: str) -> DataFrame:
    for k in kinds:
        validate.choice(k, validate.UPDATE_TYPES, "update_type")
    return updates.where(F.col("update_type").isin(*kinds))


def code_references(updates: DataFrame, path: str | None = None) -> DataFrame:
    c = updates.where("related_code IS NOT NULL").select("session_id", "update_id", "ts", "related_code.*")
    return c if path is None else c.where(F.col("file_path") == path)


def keyword_search(updates: DataFrame, query: str) -> DataFrame:
    q = validate.query_arg(query)
    return updates.where(text.contains(F.col("title"), q) | text.contains(F.col("description"), q))


def session_search(sessions: DataFrame, query: str) -> DataFrame:
    q = validate.query_arg(query)
    return sessions.where(text.contains(F.col("name"), q) | text.contains(F.col("description"), q))


def mark_important(updates: DataFrame, update_id: str) -> DataFrame:
    hit = F.col("update_id") == validate.uuid_arg(update_id, "update_id")
    return updates.withColumn("important", F.when(hit, True).otherwise(F.col("important")))


def indexed_type(update_type: Column) -> Column:
    return lookup(INDEXED_AS, update_type, "UpdateContent")


def search_texts(updates: DataFrame) -> DataFrame:
    """update_id, session_id, ts, content_type, text of all updates worth indexing."""
    body = text.search_text(*(F.col(c) for c in ("title", "description", "details", "examples", "implications")), F.col("related_code.code_snippet"), F.col("related_code.file_path"))
    out = updates.select("update_id", "session_id", "ts", indexed_type(F.col("update_type")).alias("content_type"), body.alias("text"))
    return out.where(text.worth_indexing(F.col("text")))


def pending(updates: DataFrame, stored: DataFrame) -> DataFrame:
    """Updates whose id is not in the vector store yet."""
    return updates.join(stored.select(F.col("content_id").alias("update_id")), "update_id", "left_anti")


def stale(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Stored ids of which there is no update any more."""
    return stored.join(updates.select(F.col("update_id").alias("content_id")), "content_id", "left_anti")


# -- derived state ---------------------------------------------------------------------------------


def decisions(updates: DataFrame, live: bool = False) -> DataFrame:
    """One row per decision; confidence 0.9 if marked important, else 0.7 (``live``: always 1.0)."""
    confidence = F.lit(1.0) if live else F.when(F.coalesce("important", F.lit(False)), 0.9).otherwise(0.7)
    d = updates.where("update_type = 'DecisionMade'")
    return d.select("session_id", "update_id", "ts", F.col("title").alias("description"), F.col("description").alias("context"), F.coalesce("implications", F.array().cast("array<string>")).alias("alternatives"), confidence.alias("confidence"))


def questions(updates: DataFrame) -> DataFrame:
    q = updates.where("update_type = 'QuestionAnswered'")
    status = F.when(F.coalesce(F.trim("description"), F.lit("")) == "", "Open").otherwise("Answered")
    return q.select("session_id", "update_id", "ts", F.col("title").alias("question"), F.col("description").alias("context"), status.alias("status"))


def open_questions(updates: DataFrame) -> DataFrame:
    return questions(updates).where("status <> 'Answered'")


def concepts(updates: DataFrame, n: int = 50) -> DataFrame:
    """Defined concepts, the newest ``n`` of each session."""
    c = updates.where("update_type = 'ConceptDefined'")
    c = c.select("session_id", "update_id", "ts", F.col("title").alias("name"), F.col("description").alias("definition"), "examples", F.coalesce("references_entities", F.array().cast("array<string>")).alias("related"))
    w = Window.partitionBy("session_id").orderBy(*newest_first())
    return c.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def specifications(updates: DataFrame) -> DataFrame:
    s = updates.where("update_type = 'RequirementAdded'")
    return s.select("session_id", "update_id", "ts", "title", "description", F.coalesce("details", F.array().cast("array<string>")).alias("requirements"))


#: How a step of each type is introduced in the flow.
STEP = {
    "QuestionAnswered": "Q&A: ",
    "ProblemSolved": "Problem solved: ",
    "CodeChanged": "Code changed: ",
    "DecisionMade": "Decision: ",
    "ConceptDefined": "Concept: ",
    "RequirementAdded": "Requirement: ",
}


def flow(updates: DataFrame, n: int = 500) -> DataFrame:
    """The conversation flow of each session, the newest ``n`` steps."""
    step = F.concat(lookup(STEP, F.col("update_type"), ""), F.coalesce("title", F.lit("")))
    return hot_context(updates, n).select("session_id", "update_id", "ts", step.alias("step"), F.col("description").alias("outcome"), "nth")


def change_records(updates: DataFrame) -> DataFrame:
    return updates.select("update_id", "session_id", "ts", "update_type", text.short_title(F.col("title")).alias("title"), text.short_description(F.col("description")).alias("description"))


# -- interactions ----------------------------------------------------------------------------------

#: Per interaction the update type and the keys of title and description, first found first.
MAPPING = {
    "qa": ("QuestionAnswered", ["question"], ["answer"]),
    "code_change": ("CodeChanged", ["file_path", "file", "description"], ["changes", "diff", "change_type"]),
    "problem_solved": ("ProblemSolved", ["problem"], ["solution"]),
    "decision_made": ("DecisionMade", ["decision"], ["rationale"]),
    "requirement_added": ("RequirementAdded", ["requirement"], ["priority"]),
    "concept_defined": ("ConceptDefined", ["concept"], ["definition"]),
}
#: Verbs of explicit relationships; all others are RelatedTo.
VERBS = {
    "DEPENDS_ON": "DependsOn",
    "IMPLEMENTS": "Implements",
    "CAUSES": "CausedBy",
    "CAUSED_BY": "CausedBy",
    "SOLVES": "Solves",
    "LEADS_TO": "LeadsTo",
    "REQUIRED_BY": "RequiredBy",
    "CONFLICTS_WITH": "ConflictsWith",
}


def explicit_entities(c: Column) -> Column:
    """Names separated by commas or blanks, longer than two bytes."""
    return F.filter(F.transform(F.split(c, "[, ]"), lambda x: F.trim(x)), lambda x: F.octet_length(x) > 2)


def explicit_relationships(c: Column, context: Column) -> Column:
    """``A VERB B, C VERB D`` as an array of structs; parts with fewer than three words are dropped."""
    parts = F.filter(F.transform(F.split(c, ","), text.words), lambda w: F.size(w) >= 3)

    def edge(w: Column) -> Column:
        return F.struct(
            w[0].alias("from_entity"),
            F.array_join(F.slice(w, 3, 1_000_000), " ").alias("to_entity"),
            lookup(VERBS, F.upper(w[1]), "RelatedTo").alias("relation_type"),
            context.alias("context"),
        )

    return F.transform(parts, edge)


def from_interactions(df: DataFrame, kind: str = "interaction_type", content: str = "content") -> DataFrame:
    """Interactions (a kind and a map of strings) as updates; bad ones carry an ``error`` instead.

    Adds update_type, title, description, details (``key: value`` of all other keys, by key),
    creates_entities, creates_relationships and error. A requirement without priority has ``medium``.
    """
    k, m = F.col(kind), F.col(content)

    def first(keys: list[str]) -> Column:
        return F.coalesce(*(F.try_element_at(m, F.lit(x)) for x in keys), F.lit(""))

    def by_kind(f) -> Column:
        out = None
        for name, rule in MAPPING.items():
            out = F.when(k == name, f(rule)) if out is None else out.when(k == name, f(rule))
        return out

    def extras(rule) -> Column:
        rest = F.map_filter(m, lambda x, _: ~x.isin(*rule[1], *rule[2]))
        return F.array_sort(F.transform(F.map_entries(rest), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))

    description = F.when(k == "requirement_added", F.coalesce(F.try_element_at(m, F.lit("priority")), F.lit("medium"))).otherwise(by_kind(lambda r: first(r[2])))
    out = df.withColumns({
        "update_type": by_kind(lambda r: F.lit(r[0])),
        "title": by_kind(lambda r: first(r[1])),
        "description": description,
        "details": by_kind(extras),
        "creates_entities": explicit_entities(F.try_element_at(m, F.lit("entities"))),
    })
    out = out.withColumn("creates_relationships", explicit_relationships(F.try_element_at(m, F.lit("relationships")), F.col("title")))
    return out.withColumn("error", F.when(F.col("update_type").isNull(), F.concat(F.lit("Unknown interaction type: "), F.coalesce(k, F.lit("null")))))


def bulk_update(df: DataFrame, store, dry_run: bool = False) -> DataFrame:
    """Write interactions (update_id, session_id, interaction_type, content) to a store as updates;
    update_id, session_id, error of every row, null for those that are (or would be) written.

    A row of an unknown kind, without an id or of a session the store doesn't have is refused alone,
    the others are written. ``dry_run`` judges and writes nothing."""
    rows = from_interactions(df)
    if store.exists("session"):
        known = store.read("session").select("session_id", F.lit(True).alias("__known"))
    else:
        known = df.select("session_id", F.lit(True).alias("__known")).where("false")
    no_id = F.when(F.col("update_id").isNull(), "No update id")
    unknown = F.when(F.col("__known").isNull(), F.concat(F.lit("Session not found: "), F.coalesce("session_id", F.lit("null"))))
    rows = rows.join(known, "session_id", "left").withColumn("error", F.coalesce("error", no_id, unknown)).drop("__known")
    if not dry_run:
        columns = ["session_id", "update_id", "update_type", "title", "description", "details", "creates_entities", "creates_relationships"]
        store.write("update", rows.where("error IS NULL").select(*columns))
    return rows.select("update_id", "session_id", "error")
