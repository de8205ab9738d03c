"""Schemas of the model's tables; explicit everywhere, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
STRINGS = T.ArrayType(S)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CONTENT = struct(title=S, description=S, details=STRINGS, examples=STRINGS, implications=STRINGS)
CODE_REFERENCE = struct(file_path=S, start_line=I, end_line=I, code_snippet=S, commit_hash=S, branch=S, change_description=S)
RELATIONSHIP = struct(from_entity=S, to_entity=S, relation_type=S, context=S)
UPDATE = struct(
    id=S,
    ts=TS,
    update_type=S,
    content=CONTENT,
    related_code=CODE_REFERENCE,
    parent_update=S,
    user_marked_important=B,
    creates_entities=STRINGS,
    creates_relationships=T.ArrayType(RELATIONSHIP),
    references_entities=STRINGS,
)
SESSION = struct(session_id=S, name=S, description=S, created_at=TS, last_updated=TS)
ENTITY = struct(session_id=S, name=S, entity_type=S, first_mentioned=TS, last_mentioned=TS, mention_count=L, importance=D, description=S)
EDGE = struct(session_id=S, src=S, dst=S, relation=S, context=S)
EMBEDDING = struct(content_id=S, session_id=S, vector=T.ArrayType(T.FloatType()), text=S, content_type=S, ts=TS, metadata=T.MapType(S, S))
WORKSPACE = struct(id=S, name=S, description=S, sessions=T.ArrayType(struct(session_id=S, role=S)), created_at=L)

#: Relation types in their fixed order.
RELATIONS = ["RequiredBy", "LeadsTo", "RelatedTo", "ConflictsWith", "DependsOn", "Implements", "CausedBy", "Solves"]
#: Order in which relations are preferred when few can be shown; unlisted ones come last.
PRIORITY = ["CausedBy", "DependsOn", "Implements", "LeadsTo", "Solves", "RelatedTo"]
#: Content type under which the text of each update type is indexed.
INDEXED_AS = {"QuestionAnswered": "UserMessage", "ProblemSolved": "ProblemSolution", "CodeChanged": "CodeSnippet", "DecisionMade": "DecisionPoint"}
FORMAT_VERSION = "1.2.0"
EXPORT_SESSION = T.StructType([*SESSION.fields, T.StructField("updates", T.ArrayType(UPDATE))])
EXPORT = struct(
    format_version=S,
    metadata=struct(export_type=S, exported_at=S, session_count=L, update_count=L),
    sessions=T.ArrayType(EXPORT_SESSION),
    workspaces=T.ArrayType(WORKSPACE),
    embeddings=T.ArrayType(EMBEDDING),
)
