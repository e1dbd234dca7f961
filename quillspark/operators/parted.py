"""A table in folders by the hash of its key, of which a change rewrites only those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.collections import drop, exists
from .observing import observed

#: Folders of a table; a bit of a long stands for each.
PARTS = 64


def part_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")


def parts_in(mask: int | None) -> list[int]:
    return [p for p in range(PARTS) if (mask or 0) >> p & 1]


def mask_of(part: Column) -> Column:
    """An aggregate: the parts that there are, as bits."""
    return F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), part)), F.lit(0).cast("long"))


class PartedTable:
    """Rows of a schema in folders ``part=0`` to ``part=63``; nulls of the key are of a part as well.

    A write goes to a staging folder and replaces the folders of its parts when it is done, so that a write that breaks
    off leaves the table as it was. One writer at a time; who reads while folders are replaced may have to read again.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self._spark, self.path, self.key, self.schema = spark, path, key, schema

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The rows, of some parts if these are given: other folders are not listed among the files to read."""
        if not exists(self._spark, self.path):
            return self._spark.createDataFrame([], f"{self.schema}, part int")
        rows = self._spark.read.schema(f"{self.schema}, part int").parquet(self.path)
        return rows if parts is None else rows.where(F.col("part").isin(parts))

    def merge(self, gone: DataFrame, new: DataFrame, parts: list[int], *counters: Column) -> dict:
        """Takes the keys of ``gone`` out, puts ``new`` in, and rewrites ``parts``, to which all of both belong.

        ``counters`` are aggregates over the rows written, with ``_new`` telling the new ones; their values come with
        the write. A part in which nothing is left goes.
        """
        if not parts:
            return {}
        names = [c for c in self.read([]).columns if c != "part"]
        old = self.read(parts).join(gone.select(self.key), self.key, "left_anti").select(*names, "part", F.lit(False).alias("_new"))
        rows = old.unionByName(new.select(*names, part_of(self.key), F.lit(True).alias("_new")))
        seen = Observation()
        written = observed(rows.hint("rebalance", "part"), seen, mask_of(F.col("part")).alias("mask"), *counters).drop("_new")
        written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        left = parts_in(seen.get["mask"])
        for p in set(parts) - set(left):
            drop(self._spark, f"{self.path}/part={p}")
        return {k: v for k, v in seen.get.items() if k != "mask"}
