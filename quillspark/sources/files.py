"""Files as rows: images for a model, specifications, and a table described as a document."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Image types that a model takes, by the end of a file's name.
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}


def usable_images(files: Column, max_bytes: int, most: int) -> Column:
    """Of array<struct<name, mimetype, size>> the first ``most`` whose type is supported and that aren't too large; nulls are left out."""
    fits = lambda f: F.coalesce(f["mimetype"].isin(sorted(set(IMAGE_TYPES.values()))) & (f["size"] <= max_bytes), F.lit(False))
    return F.slice(F.filter(F.coalesce(files, F.array().cast("array<struct<name:string,mimetype:string,size:bigint>>")), fits), 1, most)


def images(spark: SparkSession, folder: str, max_bytes: int) -> DataFrame:
    """(path, mimetype, size, data): image files of a folder in base64; the size is checked before a file is read."""
    kind = F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair])[F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))]
    found = spark.read.format("binaryFile").load(folder).where(F.col("length") <= max_bytes)
    return found.select("path", kind.alias("mimetype"), F.col("length").alias("size"), F.base64("content").alias("data")).where("mimetype is not null")


def specifications(spark: SparkSession, path: str) -> DataFrame:
    """(value): whole specifications as JSON, of files in JSON or, if PyYAML is there, YAML. Files of another kind fail the query, so that none is passed over."""
    rows = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())
    name = F.lower(F.regexp_replace("_file", r"[?#].*", ""))
    refused = F.raise_error(F.concat(F.lit("neither JSON nor YAML: "), F.col("_file")))
    return rows.select(F.when(name.endswith(".json"), F.col("value")).when(name.rlike(r"\.ya?ml$"), yaml_to_json(F.col("value"))).otherwise(refused).alias("value"))


@F.pandas_udf(T.StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    """YAML documents as JSON; dates become strings, keys too. Needs PyYAML on the executors."""
    import yaml

    def keyed(x):
        if isinstance(x, dict):
            return {k if isinstance(k, str) else json.dumps(k): keyed(v) for k, v in x.items()}
        return [keyed(v) for v in x] if isinstance(x, list) else x

    return texts.map(lambda t: None if t is None else json.dumps(keyed(yaml.safe_load(t)), ensure_ascii=False, default=str))


def table_document(df: DataFrame, name: str, order: list[str], samples: int = 3) -> DataFrame:
    """(name, content): the columns of a table with their types and its first rows in ``order``, as one text."""
    columns = "\n".join(f"- {c} ({t})" for c, t in df.dtypes)
    rows = df.orderBy(*order).limit(samples).select(F.struct(*order).alias("o"), F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in df.columns]).alias("line"))
    lines = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda r: r["line"]), "\n").alias("lines"))
    return lines.select(F.lit(name).alias("name"), F.concat(F.lit(f"Table: {name}\n{columns}\nSamples:\n"), "lines").alias("content"))
