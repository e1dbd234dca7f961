"""Rows under a key of their own, where ids may be null or repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The name of the key's column.
ROW = "__qs_row"


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns, maps aside, that tells nulls apart; only rows that are alike throughout share it."""
    names = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*names, *[F.col(c).isNull() for c in names])


def keep_least(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, nulls last, and of the smallest key among them.

    ``grouped`` has (doc_id, ROW, component) of every row.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    stay = grouped.groupBy("component").agg(F.min(order).alias("least")).select(F.col("least")[ROW].alias(ROW))
    return docs.withColumn(ROW, row_key(docs)).join(stay, ROW, "left_semi").dropDuplicates([ROW]).select(*docs.columns)
