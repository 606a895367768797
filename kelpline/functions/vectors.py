"""Vector functions as Column expressions, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a vector is null."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.coalesce(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v over its norm; unchanged if that is 0 or not finite."""
    n = norm(v)
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Similarity that normalises by itself; 0 for a zero vector."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def blend(original: Column, translated: Column, weight: float = 0.65) -> Column:
    """Weighted sum, normalised again; where one is missing, the other."""
    both = unit(F.zip_with(original, translated, lambda x, y: x.cast("double") * weight + y.cast("double") * (1 - weight)))
    return F.when(original.isNull(), translated).when(translated.isNull(), original).otherwise(both)
