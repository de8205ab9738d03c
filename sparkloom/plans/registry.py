"""Collects the queries of the core modules."""

from __future__ import annotations

import importlib

MODULES = ["context_queries", "search_queries", "summary_queries", "graph_queries", "other_queries"]


def _all():
    return [importlib.import_module(f"sparkloom.plans.{m}") for m in MODULES]


def flagship(spark, sf_dir):
    return importlib.import_module("sparkloom.plans.search_queries").workspace_recency(spark, sf_dir)


def queries() -> dict:
    return {k: v for m in _all() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _all() for k, v in m.ORACLE.items()}
