"""Texts: cutting, building and testing them. Lengths are in characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shorten(c: Column, most: int, keep: int, tail: str) -> Column:
    """Texts longer than ``most`` become their first ``keep`` characters and ``tail``."""
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(keep)), F.lit(tail))).otherwise(c)


def short_description(c: Column) -> Column:
    return shorten(c, 2000, 1800, "... (truncated)")


def short_title(c: Column) -> Column:
    return shorten(c, 200, 190, "...")


def snippet(c: Column, n: int = 200) -> Column:
    return shorten(c, n, n, "...")


def contains(c: Column, needle: str) -> Column:
    """Substring test without case; null is no match."""
    return F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def search_text(title: Column, description: Column, details: Column, examples: Column, implications: Column, code: Column, path: Column) -> Column:
    """All parts joined by a blank; nulls are skipped."""
    return F.concat_ws(" ", title, description, details, examples, implications, code, path)


def worth_indexing(c: Column) -> Column:
    return F.coalesce(F.octet_length(F.trim(c)) >= 10, F.lit(False))


def theme(c: Column) -> Column:
    """The first three words longer than three bytes."""
    return F.array_join(F.slice(F.filter(words(c), lambda w: F.octet_length(w) > 3), 1, 3), " ")


def trim_marks(c: Column) -> Column:
    """Without punctuation at both ends."""
    return F.regexp_replace(c, r"^\p{Punct}+|\p{Punct}+$", "")


def normal_name(c: Column) -> Column:
    """Known spellings of names, without a trailing ``()``."""
    bare = F.regexp_replace(c, r"\(\)$", "")
    return F.when(F.lower(bare) == "mutex", "Mutex").otherwise(bare)


def valid_name(c: Column) -> Column:
    return F.char_length(c).between(2, 30)


def parse_since(c: Column, now: Column) -> Column:
    """RFC 3339, ``Y-m-d H:M:S`` or ``Y-m-d``; empty or null is 30 days before now."""
    parsed = F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", now - F.expr("INTERVAL 30 DAYS")).otherwise(parsed)
