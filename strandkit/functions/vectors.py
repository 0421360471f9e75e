"""Vector expressions over array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandkit.constants import EPSILON


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vec: Column, eps: float = EPSILON) -> Column:
    # The one-element array binds the norm once instead of once per element.
    length = F.array(F.greatest(norm(vec), F.lit(eps)))
    return F.get(F.transform(length, lambda n: F.transform(doubles(vec), lambda x: x / n)), F.lit(0))


def cosine(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def distance(a: Column, b: Column) -> Column:
    return norm(difference(a, b))


def largest_dimensions(delta: Column, n: int = 10) -> Column:
    """The ``n`` entries of largest magnitude as (dim, delta), ties by dimension."""
    entries = F.transform(
        delta, lambda x, i: F.struct((-F.abs(x)).alias("order"), i.alias("dim"), x.alias("delta"))
    )
    return F.transform(
        F.slice(F.array_sort(entries), 1, n),
        lambda e: F.struct(e["dim"].alias("dim"), F.round(e["delta"], 5).alias("delta")),
    )
