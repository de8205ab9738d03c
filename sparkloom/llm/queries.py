"""All pN_ queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["alike", "history", "topn", "split", "vectors", "bpe", "mixture", "residue"]

QUERIES: dict = {}
ORACLE: dict = {}
for _m in MODULES:
    _mod = importlib.import_module(f"sparkloom.llm.{_m}")
    QUERIES |= _mod.QUERIES
    ORACLE |= _mod.ORACLE
