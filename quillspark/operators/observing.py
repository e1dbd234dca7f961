"""Counters that come with a write, instead of a pass of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(rows: DataFrame, seen: Observation, *aggregates: Column) -> DataFrame:
    """``rows``, whose aggregates ``seen`` has once they have been written.

    Spark plans an empty table away together with what observes it; a row of nulls, which goes again after it is
    observed, keeps it there. Aggregates leave rows of nulls out. What is done with the rows afterwards must not shuffle them:
    a shuffle of nothing would be planned away while the query runs.
    """
    blank = rows.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields], F.lit(True).alias("_blank"))
    every = rows.withColumn("_blank", F.lit(False)).unionByName(blank)
    return every.observe(seen, *aggregates).where("not _blank").drop("_blank")
