"""A join in which a key with very many rows on one side is dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one part takes at least; most keys that are dealt out, so that their list may be sent to every task.
PART_ROWS, MOST_HOT = 2_000, 10_000


def spread_join(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, which has a row or a few rows for each ``key``, however the keys of ``rows`` are spread.

    With T rows, keys of more than max(PART_ROWS, T / MOST_HOT) rows are dealt to parts of that size by a hash of the whole
    row, and what ``few`` has for them is copied to each part. There are MOST_HOT such keys at most.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    most = max(PART_ROWS, (counts.agg(F.sum("_n")).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(counts.where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("_parts")
    copied = few.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")
