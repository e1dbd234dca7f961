"""Snapshot writes without MERGE: upserts, deletes, capped histories and the diff of two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` and the rows of ``old`` whose key it doesn't have; the snapshot goes to a folder of its own.

    Of rows of ``new`` that repeat a key the one of the smallest hash of all columns is written, so a rerun writes it too.
    """
    first = W.partitionBy(key).orderBy(F.xxhash64(*new.columns))
    once = new.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    return old.join(new.select(key), key, "left_anti").unionByName(once)


def delete_ids(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return old.join(ids.select(key), key, "left_anti")


def delete_where(old: DataFrame, field: str, value) -> DataFrame:
    """Rows whose field differs or is null stay."""
    return old.where(~F.col(field).eqNullSafe(F.lit(value)))


def newest(history: DataFrame, order: list[Column], keep: int) -> DataFrame:
    return history.orderBy(*order).limit(keep)


def last_write(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(key).orderBy(*order)
    return events.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def diff(old: DataFrame, new: DataFrame, key: str, digest: str, keep: bool = False) -> DataFrame:
    """(key, action): created, updated, unchanged or deleted, by hash, where null equals null; a fetch that failed must not be in ``old`` either.

    ``keep`` adds the digest of ``new``.
    """
    a = old.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    changed = ~F.col("_old").eqNullSafe(F.col("_new"))
    action = F.when(F.col("_was").isNull(), "created").when(F.col("_is").isNull(), "deleted").when(changed, "updated").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, action.alias("action"), *([F.col("_new").alias(digest)] if keep else []))
