"""Vector arithmetic on ARRAY<FLOAT> columns, computed in double."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    """L2 norm; stored beside a vector so that a similarity needs one pass only."""
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 if the lengths differ or a norm is 0."""
    na, nb = norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)
    ok = (F.size(_col(a)) == F.size(_col(b))) & (na > 0) & (nb > 0)
    return F.when(ok, dot(a, b) / (na * nb)).otherwise(0.0)


def cosine_to(a: Column | str, query: Sequence[float]) -> Column:
    """``cosine`` with one vector that is known when the plan is built: a matrix product per Arrow batch."""
    q = np.asarray(query, np.float64)
    size = float(np.linalg.norm(q))
    unit = q / size if size > 0 else q * 0

    def similarity(v: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(v), len(unit)), False).to_numpy(zero_copy_only=False)
        out = np.zeros(len(v))
        if fits.any():
            x = v.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(unit)).astype(np.float64)
            n = np.linalg.norm(x, axis=1)
            out[fits] = np.divide(x @ unit, n, out=np.zeros(len(x)), where=n != 0)
        return pa.array(out, pa.float64())

    return F.arrow_udf(similarity, "double")(_col(a))


def euclidean(a: Column | str, b: Column | str) -> Column:
    gaps = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))


def normalise(a: Column | str) -> Column:
    """Unit length; norms below 1e-12 count as 1e-12."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(_col(a), lambda x: x.cast("double") / n)


def quantise(a: Column | str) -> Column:
    """One byte per component: (x + 1) * 127.5, clamped to 0..255."""
    return F.transform(_col(a), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5).cast("int"))))


def quantise_range(a: Column | str, low: Column, high: Column) -> Column:
    """One byte per component by the range of its dimension (two array columns)."""
    triples = F.arrays_zip(_col(a).alias("x"), low.alias("lo"), high.alias("hi"))

    def level(t: Column) -> Column:
        span = t["hi"].cast("double") - t["lo"].cast("double")
        part = (t["x"].cast("double") - t["lo"].cast("double")) / F.when(span > 0, span)
        return F.greatest(F.lit(0), F.least(F.lit(255), F.coalesce(F.floor(part * 255).cast("int"), F.lit(0))))

    return F.transform(triples, level)


def has_dimension(a: Column | str, n: int) -> Column:
    return F.coalesce(F.size(_col(a)) == n, F.lit(False))
