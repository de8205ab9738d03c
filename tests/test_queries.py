import pytest

import __spark_entry__ as entry
from sparkloom.plans import registry
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, data, name):
    same(spark, con, data, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, data, name):
    registry.queries()[name](spark, data).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_product_codes_use_the_whole_codebook(spark, data, monkeypatch):
    from sparkloom.operators import ann

    sizes, fitted = [], ann.kmeans
    monkeypatch.setattr(ann, "kmeans", lambda x, k, *a, **kw: sizes.append(k) or fitted(x, k, *a, **kw))
    registry.queries()["vec14_product_codes"](spark, data)
    assert sizes == [256] * 8


def test_range_join_of_all_parts_against_brute_force(spark, data):
    parts = [(r["p_partkey"], r["p_retailprice"]) for r in spark.read.parquet(f"{data}/part.parquet").collect()]
    lines = [(r["l_orderkey"], r["l_linenumber"], r["l_extendedprice"]) for r in spark.read.parquet(f"{data}/lineitem.parquet").collect()]
    got = sorted(tuple(r) for r in registry.queries()["rel_range_join_all"](spark, data).collect())
    assert got and got == sorted((k, o, n) for k, low in parts for o, n, x in lines if low <= x <= low + 5)
