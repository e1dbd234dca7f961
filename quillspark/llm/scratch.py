"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where that is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    own = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Settled:
    """A DataFrame written to the shared folder and read back: its lineage is cut, and lost executors cost nothing.

    ``drop()`` deletes the files once no later step reads them.
    """

    def __init__(self, df: DataFrame, name: str):
        self._spark = df.sparkSession
        self._path = fresh_path(self._spark, name)
        df.write.parquet(self._path)
        self.df = self._spark.read.schema(df.schema).parquet(self._path)

    def drop(self) -> None:
        remove_path(self._spark, self._path)


def settle(df: DataFrame, name: str) -> DataFrame:
    return Settled(df, name).df
