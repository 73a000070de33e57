"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def l2_normalised(v: Column, floor: float = 1e-12) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x / n)


def maxsim(query: Column, doc: Column) -> Column:
    """Sum over query vectors of the best inner product with any document vector; both are arrays of vectors."""
    return F.aggregate(query, F.lit(0.0), lambda total, q: total + F.array_max(F.transform(doc, lambda d: dot(q, d))))


def mean_pool(tokens: DataFrame, key: str, vector: str, mask: str | None = None) -> DataFrame:
    """Mean of the vectors of each key, weighted by ``mask``, the divisor at least 1e-9; one row for each key and dimension."""
    weight = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    long = tokens.select(key, weight.alias("w"), F.posexplode(doubles(F.col(vector))).alias("dim", "x"))
    return long.groupBy(key, "dim").agg((F.sum(F.col("x") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("value"))


def cls_pool(tokens: DataFrame, key: str, pos: str, vector: str) -> DataFrame:
    """The first token's vector of each key."""
    return tokens.groupBy(key).agg(F.min_by(vector, pos).alias(vector))
