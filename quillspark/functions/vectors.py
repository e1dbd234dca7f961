"""Vector expressions, accumulated in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, size: Column | None = None) -> Column:
    """0 where either vector is zero, null where one is null; never above 1. ``size``: the product of the norms, if known."""
    size = norm(a) * norm(b) if size is None else size
    return F.when(size == 0, F.lit(0.0)).when(size.isNotNull(), F.least(F.lit(1.0), dot(a, b) / size))


def unit(v: Column) -> Column:
    return let(norm(v), lambda size: F.transform(v, lambda x: x.cast("double") / size))


def relevance(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)
