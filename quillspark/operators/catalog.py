"""Sources and their documents: unique names, changes, deletion with all that hangs on a source, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def add_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """``sources`` and the new ones (source_id, name, source_type) whose name isn't taken; of new ones of one name the smallest id."""
    first = W.partitionBy("name").orderBy("source_id")
    once = new.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    return sources.unionByName(once.join(sources.select("name"), "name", "left_anti"))


def update_sources(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Fields that aren't null in ``changes`` (source_id once each) replace those of the source; ids that aren't there are passed over."""
    fields = [c for c in changes.columns if c != "source_id"]
    joined = sources.join(changes.select("source_id", *[F.col(c).alias(f"_{c}") for c in fields]), "source_id", "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in sources.columns])


def refused_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that ``add_sources`` leaves out, with ``reason``: their name is taken, by a source or by another new one."""
    known = sources.select("name", F.lit("taken").alias("_was")).distinct()
    first = W.partitionBy("name").orderBy("source_id")
    judged = new.withColumn("_nth", F.row_number().over(first)).join(known, "name", "left")
    reason = F.when(F.col("_was").isNotNull(), F.concat(F.lit("Source with name '"), "name", F.lit("' already exists"))).when(F.col("_nth") > 1, F.concat(F.lit("Name '"), "name", F.lit("' is given twice")))
    return judged.where("_was is not null or _nth > 1").select(*new.columns, reason.alias("reason"))


def unknown_sources(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of ``changes`` that ``update_sources`` leaves out, with ``reason``: there is no source of their id."""
    gone = changes.join(sources.select("source_id"), "source_id", "left_anti")
    return gone.withColumn("reason", F.concat(F.lit("Source with ID '"), "source_id", F.lit("' not found")))


def by_id(sources: DataFrame, source_id: int) -> DataFrame:
    """The source of an id, which is unique; the equality reaches the scan."""
    return sources.where(F.col("source_id") == source_id).limit(1)


def delete_sources(sources: DataFrame, documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of sources and of their documents (source_id) without the sources ``ids``."""
    gone = ids.select("source_id")
    return sources.join(gone, "source_id", "left_anti"), documents.join(gone, "source_id", "left_anti")


def by_type(sources: DataFrame, source_type: str) -> DataFrame:
    return sources.where(F.col("source_type") == source_type)


def by_name(sources: DataFrame, name: str) -> DataFrame:
    """The source of a name, which is unique."""
    return sources.where(F.col("name") == name).limit(1)


def documents_of(documents: DataFrame, source_id: int | None = None, external_id: str | None = None) -> DataFrame:
    """Documents of a source, of an external id, or of both."""
    found = documents if source_id is None else documents.where(F.col("source_id") == source_id)
    return found if external_id is None else found.where(F.col("external_id") == external_id)


def reached_once(*ways: DataFrame) -> DataFrame:
    """Pages reached in one way or another, each external id once: what the first way gives."""
    every = None
    for i, rows in enumerate(ways):
        part = rows.withColumn("_way", F.lit(i))
        every = part if every is None else every.unionByName(part)
    first = W.partitionBy("external_id").orderBy("_way")
    return every.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth", "_way")
