"""Connected components of an edge table by alternating large-star and small-star rounds; what fits into a task ends there."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Settled


#: Parts into which a node's neighbours are dealt when they learn its smallest one, so that a hub isn't one task.
PARTS = 8
#: Edges that one task joins; while there are more, rounds go on. It doesn't grow with the input.
SMALL = 8_192


def _told(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with m, the smallest node around u."""
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    return dealt.join(least.select("u", "m", part), ["u", "part"]).drop("part")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges (u > v). Neighbourhoods are only ever reduced to their minimum."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = _told(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = _told(large, least).where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the edges (u, v) of all batches, by union-find."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            low, high = sorted((top(u), top(v)))
            up[high] = low
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in up], kind)], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(node, component): each node that has an edge to another, with the smallest node it reaches.

    Rows with a null end and loops are left out; repeated edges count once. Every round is written to the shared
    folder, so the lineage stays short and the number of rounds grows with the logarithm of the path lengths. ``small``
    edges at most are joined in one task instead: a round costs the driver seven shuffles however few they are.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull().alias("n1"), F.col(b).isNull().alias("n2"))
    now = Settled(start.where("not n1 and not n2 and u != v").select("u", "v").distinct(), "edges")
    sign = None
    while True:
        mark = now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 20))).first()
        if mark == sign or not mark[0]:
            break
        if mark[0] <= small:
            kind = now.df.schema["u"].dataType.simpleString()
            return now.df.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}")
        sign, after = mark, Settled(_round(now.df), "edges")
        now.drop()
        now = after
    nodes = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
