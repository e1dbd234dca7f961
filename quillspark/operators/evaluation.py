"""Retrieval quality: hits, reciprocal ranks, accuracy by group, latencies, centroids."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(results: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10), *more: Column) -> DataFrame:
    """One row per query of (query_id, rank, relevant): hit at each cut-off and the reciprocal rank, 0 for a miss, and ``more`` aggregates."""
    best = F.min(F.when(F.col("relevant"), F.col("rank")))
    return results.groupBy("query_id").agg(*[F.coalesce(best <= k, F.lit(False)).alias(f"hit_{k}") for k in cutoffs], F.coalesce(1.0 / best, F.lit(0.0)).alias("reciprocal_rank"), *more)


#: Buckets into which each round cuts the interval of a value that is looked for.
BUCKETS = 1024


def kth_smallest(rows: DataFrame, value: str, places: list[int]) -> dict[int, float]:
    """The values at some places (from 0) of the order of a column of doubles without nulls, exactly.

    A round counts the rows of equal buckets of the intervals in which the values must lie, with the least and the greatest
    value of each, and goes on inside the buckets that hold the places. No task sorts the column; the driver sees a few
    thousand counts a round, and rounds are few, as each cuts an interval by BUCKETS.
    """
    x = F.col(value).cast("double")
    low, high, n = rows.agg(F.min(x), F.max(x), F.count(x)).first()
    found, open_ = {}, {}
    for k in places:
        if not 0 <= k < n:
            raise ValueError(f"no place {k} among {n} values")
        open_[k] = (low, high, 0)  # the place lies in [low, high], before which there are so many values
    while open_:
        for k, (a, b, _) in list(open_.items()):
            if a == b:
                found[k] = a
                del open_[k]
        spans = sorted({(a, b) for a, b, _ in open_.values()})
        if not spans:
            break
        at = reduce(lambda c, s: c.when(x.between(F.lit(s[0]), F.lit(s[1])), s_index(s, spans)), spans, F.when(F.lit(False), F.lit(0)))
        width = reduce(lambda c, s: c.when(at == s_index(s, spans), F.least(F.lit(BUCKETS - 1), F.floor((x / 2 - F.lit(s[0] / 2)) / F.lit(s[1] / 2 - s[0] / 2) * BUCKETS))), spans, F.when(F.lit(False), F.lit(0)))
        counted = rows.select(x.alias("x"), at.alias("at"), width.cast("int").alias("bucket")).where("at is not null")
        counts: dict = {}
        for r in counted.groupBy("at", "bucket").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
            counts.setdefault(spans[r["at"]], []).append((r["bucket"], r["n"], r["low"], r["high"]))
        for k, (a, b, before) in list(open_.items()):
            for _, size, first, last in sorted(counts[a, b]):
                if k < before + size:
                    open_[k] = (first, last, before)
                    break
                before += size
    return found


def s_index(span: tuple, spans: list[tuple]) -> Column:
    return F.lit(spans.index(span))


def percentiles(rows: DataFrame, value: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact percentiles, interpolated between neighbours; None for each if there are no values. Null and NaN take no part."""
    sound = rows.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = sound.count()
    if not n:
        return [None] * len(shares)
    spots = [(n - 1) * q for q in shares]
    at = kth_smallest(sound, "v", sorted({f(s) for s in spots for f in (math.floor, math.ceil)}))
    return [at[math.floor(s)] + (at[math.ceil(s)] - at[math.floor(s)]) * (s - math.floor(s)) for s in spots]


def latencies(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, std, p50, p95 and p99 of a column."""
    p = [F.round(F.lit(v).cast("double"), 6).alias(n) for n, v in zip(("p50", "p95", "p99"), percentiles(rows, value, (0.5, 0.95, 0.99)), strict=True)]
    return rows.agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std")).select("*", *p)


def centroids(vectors: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """(group, dim, value): means of the coordinates, scaled to unit length."""
    parts = vectors.select(group, F.posexplode(vec).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    size = parts.groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("size"))
    return parts.join(size, group).select(group, F.col("dim").cast("long").alias("dim"), F.round(F.when(F.col("size") > 0, F.col("m") / F.col("size")).otherwise(0.0), 6).alias("value"))
