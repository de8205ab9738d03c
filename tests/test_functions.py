import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import levels, scoring, text, validate
from sparkloom.functions import vectors as V
from sparkloom.functions.ids import canonical_id

NOW = datetime(2025, 1, 1)


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, v)
    return row.select(column.alias("x")).head()[0]


def decayed(spark, ts, bias):
    return one(spark, scoring.recency(F.lit(ts), F.lit(NOW), bias)(F.lit(0.8)))


def test_recency(spark):
    year = datetime(2024, 1, 2)  # 365 days before
    assert decayed(spark, year, 0.0) == 0.8
    assert decayed(spark, NOW, 1.0) == 0.8
    assert decayed(spark, year, 1.0) == pytest.approx(0.8 * math.exp(-1))
    assert decayed(spark, year, 0.5) == pytest.approx(0.4852, abs=1e-4)
    assert decayed(spark, datetime(2026, 1, 1), 1.0) == 0.8  # a future date has age 0
    twice = scoring.compose([scoring.recency(F.lit(year), F.lit(NOW), 0.1433), scoring.scale(2.0)])
    assert one(spark, twice(F.lit(0.4616))) == pytest.approx(0.8, abs=0.01)


def test_quality(spark):
    for value, name in ((0.85, "Excellent"), (0.7, "Very Good"), (0.55, "Good"), (0.4, "Moderate"), (0.3, "Fair"), (0.29, "Weak")):
        assert one(spark, scoring.quality(F.lit(value))) == name
    assert one(spark, scoring.explanation(F.lit(0.79), F.lit(0.7), F.lit(1.0))).startswith("Combined Score: 0.7900 = (Similarity: 0.7000")


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, V.cosine(a, b)) == pytest.approx(0.8)
    assert one(spark, V.cosine(a, F.array(F.lit(1.0)))) == 0.0
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, V.euclidean(a, b)) == pytest.approx(math.sqrt(13))
    assert one(spark, V.normalise(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, V.quantise(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(9.0)))) == [0, 127, 255, 255]


def test_levels(spark):
    assert [one(spark, levels.recency(F.lit(d))) for d in (0, 1, 4, 8, 31)] == ["Today", "Recent", "ThisWeek", "ThisMonth", "Old"]
    assert [one(spark, levels.duration(F.lit(h))) for h in (-1, 0, 2, 5, 9)] == ["Extended", "Short", "Medium", "Long", "Extended"]
    assert one(spark, levels.urgency(F.lit("Open"), F.lit(8))) == "High"
    assert one(spark, levels.urgency(F.lit("InProgress"), F.lit(3))) == "Medium"
    assert one(spark, levels.activity(F.lit(12), F.lit(0))) == "VeryHigh"


def test_text(spark):
    assert one(spark, text.short_title(F.lit("x" * 201))) == "x" * 190 + "..."
    assert one(spark, text.words(F.lit("  a  b "))) == ["a", "b"]
    assert one(spark, text.theme(F.lit("the quick brown fox jumped over"))) == "quick brown jumped"
    assert one(spark, text.worth_indexing(F.lit("short"))) is False
    assert one(spark, text.parse_since(F.lit(""), F.lit(NOW))) == datetime(2024, 12, 2)
    assert one(spark, text.parse_since(F.lit("2024-05-06"), F.lit(NOW))) == datetime(2024, 5, 6)


def test_ids(spark):
    want = "0123456789abcdef0123456789abcdef"
    for x in ("01234567-89AB-cdef-0123-456789abcdef", " urn:uuid:0123456789abcdef0123456789ABCDEF ", "{01234567-89ab-cdef-0123-456789abcdef}"):
        assert one(spark, canonical_id(F.lit(x))) == want
        assert validate.uuid_arg(x) == want
    assert one(spark, canonical_id(F.lit(None).cast("string"))) is None


def test_validation():
    for call in (lambda: validate.uuid_arg("nope"), lambda: validate.limit_arg(0), lambda: validate.limit_arg(1001), lambda: validate.recency_arg(float("nan")),
                 lambda: validate.recency_arg(11), lambda: validate.date_range(NOW, None), lambda: validate.query_arg("  "), lambda: validate.choice("x", ("a",), "scope")):
        with pytest.raises(ValueError):
            call()
    assert validate.entity_type("code_component") == "CodeComponent"
    assert validate.entity_type("unheard") == "Concept"
    assert validate.coerce_map({"a": 1, "b": True, "c": [1, "x"], "d": None}) == {"a": "1", "b": "true", "c": '[1,"x"]'}
