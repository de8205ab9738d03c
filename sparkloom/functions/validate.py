"""Arguments of the API: checked when a plan is built, before any job runs."""

from __future__ import annotations

import json
import math
import re
from datetime import datetime
from typing import Any

SCOPES = ("session", "workspace", "global")
ROLES = ("primary", "related", "dependency", "shared")
UPDATE_TYPES = ("QuestionAnswered", "ProblemSolved", "CodeChanged", "DecisionMade", "ConceptDefined", "RequirementAdded")
ENTITY_TYPES = ("Technology", "Concept", "Problem", "Solution", "Decision", "CodeComponent")
INTERACTIONS = ("qa", "code_change", "problem_solved", "decision_made", "requirement_added", "concept_defined")


def uuid_arg(value: str, name: str = "session_id") -> str:
    """The canonical form of an id; ValueError if it has not 32 hexadecimal digits."""
    bare = re.sub(r"^\s*urn:uuid:", "", str(value).lower())
    digits = re.sub("[^0-9a-f]", "", bare)
    if len(digits) != 32 or re.sub(r"[0-9a-f{}\s-]", "", bare):
        raise ValueError(f"{name}: {value!r} is not a UUID")
    return digits


def choice(value: str, allowed: tuple[str, ...], name: str) -> str:
    if value not in allowed:
        raise ValueError(f"{name}: {value!r} is none of {', '.join(allowed)}")
    return value


def limit_arg(value: int | None, default: int = 10, most: int = 1000) -> int:
    value = default if value is None else value
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise ValueError(f"limit must be an integer from 1 to {most}")
    return value


def recency_arg(value: float | None) -> float:
    value = 0.0 if value is None else float(value)
    if not math.isfinite(value) or not 0 <= value <= 10:
        raise ValueError("recency bias must be a finite number from 0 to 10")
    return value


def date_range(start: datetime | None, end: datetime | None) -> tuple[datetime, datetime] | None:
    """Both ends or none, in order."""
    if (start is None) != (end is None):
        raise ValueError("a date range needs both ends")
    if start is not None and start > end:
        raise ValueError("the date range ends before it starts")
    return None if start is None else (start, end)


def query_arg(value: str | None) -> str:
    if value is None or not value.strip():
        raise ValueError("the query is empty")
    return value


def entity_type(value: str | None) -> str:
    """Name of an entity type in any case; unknown ones are Concept."""
    by_name = {re.sub("[^a-z]", "", t.lower()): t for t in ENTITY_TYPES}
    return by_name.get(re.sub("[^a-z]", "", (value or "").lower()), "Concept")


def coerce(value: Any) -> str | None:
    """Numbers, booleans, lists and objects as text."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return str(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def coerce_map(values: dict[str, Any]) -> dict[str, str]:
    return {str(k): coerce(v) for k, v in values.items() if v is not None}
