"""Cutting oversized texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import table

BLANKS = " \t\r\n"
#: Boundaries from coarse to fine; a cut falls right behind a match.
LEVELS = [
    re.compile(r"\n(?=#{1,6} )|(?:\r?\n[ \t]*){3,}"),  # section: heading or two empty lines
    re.compile(r"(?:\r?\n[ \t]*){2,}"),  # paragraph
    re.compile(r"\r?\n|[.!?…。！？]+[\"'”’)\]]*(?:\s+|(?<=[。！？]))"),  # sentence or line
    re.compile(r"\s+|[、，]"),  # word
]


def _atoms(text: str, start: int, end: int, room: int, level: int, out: list[int]) -> None:
    """Append the ends of pieces of text[start:end], each at most ``room`` long, coarse cuts first."""
    if end - start <= room:
        out.append(end)
        return
    if level == len(LEVELS):
        out.extend(range(start + room, end, room))
        out.append(end)
        return
    at = start
    for m in LEVELS[level].finditer(text, start, end):
        if m.end() > at:
            _atoms(text, at, m.end(), room, level + 1, out)
            at = m.end()
    if at < end:
        _atoms(text, at, end, room, level + 1, out)


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece: start..end <= limit; each but the first starts ``overlap`` before
    the end of the one before. Atoms of the separator hierarchy are packed greedily."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("need limit >= 1 and 0 <= overlap < limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    room = limit - overlap
    ends: list[int] = []
    _atoms(text, 0, len(text), room, 0, ends)
    pieces, start, last = [], 0, 0
    for end in ends:
        if end - start > limit:
            pieces.append((start, last))
            start = max(0, last - overlap)
        last = end
    pieces.append((start, last))
    return pieces


def split_oversized(
    df: DataFrame,
    limits: DataFrame,
    key: str,
    text: str = "text",
    kind: str = "content_type",
) -> DataFrame:
    """One row per piece: key, piece_no (from 0), start (of the stripped text), n_pieces, piece.

    ``limits`` has one row per kind (content_type, max_text_length, overlap_chars) with a row
    ``default`` for null and unlisted kinds. It is configuration of a few rows: more than 1,000
    is refused, below that it becomes a map literal in the plan. Texts are stripped of blanks, tabs, CR and LF at both
    ends; null and empty texts give no pieces. Only texts over their limit leave the JVM; the rest
    become their single piece in a projection. Lengths are code points. An overlap not below the
    limit is an error. Extra columns are ignored, clashing names included.
    """
    config = limits.select("content_type", "max_text_length", "overlap_chars").limit(1001).collect()
    if len(config) > 1000:
        raise ValueError("limits is configuration and must stay under 1,000 rows")
    by_kind = {r[0]: F.struct(F.lit(r[1]).alias("n"), F.lit(r[2]).alias("o")) for r in config if r[0] is not None}
    if "default" not in by_kind:
        raise ValueError("limits needs a row for content_type 'default'")
    lookup = F.create_map(*(x for k, v in by_kind.items() for x in (F.lit(k), v)))
    rows = df.select(
        F.col(key).alias("__key"),
        F.expr(f"trim(BOTH ' \t\r\n' FROM `{text}`)").alias("__text"),
        F.coalesce(F.try_element_at(lookup, F.coalesce(F.col(kind), F.lit("default"))), by_kind["default"]).alias("__max"),
    ).where("__text <> ''")
    rows = rows.select("__key", "__text", F.col("__max.n").alias("__limit"), F.col("__max.o").alias("__overlap"))
    key_type = df.schema[key].dataType
    out = T.StructType([
        T.StructField(key, key_type), T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()), T.StructField("piece", T.StringType()),
    ])
    small = rows.where(F.char_length("__text") <= F.col("__limit")).select(
        F.col("__key").alias(key), F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.lit(1).alias("n_pieces"), F.col("__text").alias("piece")
    )
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, no, at, of, piece = [], [], [], [], []
            for i, (t, limit, overlap) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))):
                spans = cut(t, limit, overlap)
                for k, (s, e) in enumerate(spans):
                    take.append(i)
                    no.append(k)
                    at.append(s)
                    of.append(len(spans))
                    piece.append(t[s:e])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(take, pa.int64())), *(pa.array(x, pa.int32()) for x in (no, at, of)), pa.array(piece, pa.string())], names=names
            )

    big = rows.where(F.char_length("__text") > F.col("__limit")).mapInArrow(run, out)
    return small.unionByName(big)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "exported_embedding"), table(spark, sf_dir, "content_vectorizer_config"), "row_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 0 AND n_pieces > 1").select("row_id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


P4_SQL = """
SELECT e.row_id
FROM exported_embedding e
LEFT JOIN content_vectorizer_config c ON c.content_type = e.content_type
CROSS JOIN (SELECT max_text_length FROM content_vectorizer_config WHERE content_type = 'default') d
WHERE length(trim(e.text, ' ' || chr(9) || chr(13) || chr(10))) > coalesce(c.max_text_length, d.max_text_length)
"""

QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
ORACLE = {"p4_found": P4_SQL}
