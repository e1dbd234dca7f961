"""Collections as Parquet folders, document loaders, guarded SELECTs and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.statements import problem

POINTS = "id string, embedding array<float>, payload map<string,string>"


def _found(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _found(spark, path)
    return system.exists(target)


def ensure(spark: SparkSession, path: str, schema: str = POINTS) -> bool:
    """Makes an empty collection where there is none; whether it did."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def append(points: DataFrame, path: str, dimension: int | None = None) -> None:
    """Adds points; a null id gets a new one, a vector of another dimension fails the write."""
    given = points.withColumn("id", F.coalesce("id", F.uuid()))
    if dimension:
        wrong = F.raise_error(F.concat(F.lit(f"expected {dimension} dimensions, found "), F.size("embedding").cast("string"))).cast("array<float>")
        given = given.withColumn("embedding", F.when(F.coalesce(F.size("embedding"), F.lit(0)) == dimension, F.col("embedding")).otherwise(wrong))
    given.write.mode("append").parquet(path)


def drop(spark: SparkSession, path: str) -> bool:
    """Deletes a collection; whether there was one."""
    system, target = _found(spark, path)
    return system.delete(target, True)


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row: points, and how many have a vector."""
    return spark.read.parquet(path).agg(F.count("*").alias("points"), F.count("embedding").alias("indexed"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema, malformed fields null; an empty table where there is no file."""
    try:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(text, metadata) of a JSON list of documents."""
    return spark.read.schema("text string, metadata map<string,string>").option("multiLine", True).option("mode", "FAILFAST").json(path)


def csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """(text, metadata) of CSV files with a text column; the other columns that aren't null are the metadata."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "text" not in rows.columns:
        raise ValueError("a CSV file of documents needs a column text")
    rest = [F.lit(x) if i == 0 else F.col(f"`{x}`") for c in rows.columns if c != "text" for i, x in enumerate((c, c))]
    every = F.create_map(*rest) if rest else F.create_map().cast("map<string,string>")
    return rows.select("text", F.map_filter(every, lambda k, v: v.isNotNull()).alias("metadata"))


def select_only(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """Runs a query with named parameters; any other statement is refused before it is planned."""
    if why := problem(spark, sql):
        raise ValueError(why)
    return spark.sql(sql, args or {})


def export_feedback(feedback: DataFrame, path: str, newest: int = 10_000) -> None:
    """Writes the newest rows (ts, id) as JSON lines."""
    feedback.orderBy(F.desc("ts"), F.desc("id")).limit(newest).write.mode("overwrite").json(path)
