"""Read-only scans of a relational database: whole tables in parallel, and guarded statements with named parameters."""

from __future__ import annotations

import datetime
import decimal
import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.statements import problem


def scan(spark: SparkSession, url: str, table: str, column: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table, read by ``partitions`` connections at once along a column of numbers or times; filters and columns are pushed down.

    The bounds of the column come from one statement that the database answers; rows with null there are in the first
    part. An empty table is read by one connection, as is one without a column to go by.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        low, high = spark.read.format("jdbc").options(url=url, **options).option("query", f"SELECT min({column}) AS lowest, max({column}) AS highest FROM {table}").load().first()
        if low is not None:
            along = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
            reader = reader.options(**along)
    return reader.load()


def literal(value) -> str:
    """A value as an SQL literal; strings and times are quoted, so that none can end the statement."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, decimal.Decimal)):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return f"{'TIMESTAMP' if isinstance(value, datetime.datetime) else 'DATE'} '{value}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(f"no literal for {type(value).__name__}")


#: A string, a quoted name, a comment or a parameter: only the last one is replaced.
TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|--[^\n]*|/\*.*?\*/|(?<!:):([A-Za-z_]\w*)""", re.S)


def bound(sql: str, args: dict) -> str:
    """The statement with its named parameters (:name) filled in, but not inside strings, quoted names and comments."""

    def fill(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        if m[1] not in args:
            raise ValueError(f"no value for the parameter {m[1]}")
        return literal(args[m[1]])

    return TOKEN.sub(fill, sql)


def ask(spark: SparkSession, url: str, sql: str, args: dict | None = None, **options: str) -> DataFrame:
    """The rows of a statement that the database runs. Anything but a query is refused before a connection is made."""
    if why := problem(spark, sql):
        raise ValueError(why)
    return spark.read.format("jdbc").options(url=url, query=bound(sql, args or {}).strip().rstrip(";"), **options).load()
