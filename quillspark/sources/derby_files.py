"""A relational database as read-only files: tasks build its parts with Derby, and each process of a cluster can read them."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.csv as csv
from pyspark.sql import DataFrame

from . import jdbc

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
TYPES = {"tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "REAL", "double": "DOUBLE"}
#: Rows of a part, each a database that one task builds.
PART = 1_000_000


def local_path(folder: str) -> str:
    """The folder as a path of the file system; Derby reads no other."""
    scheme, _, rest = folder.partition(":") if ":/" in folder else ("file", "", folder)
    if scheme != "file":
        raise ValueError(f"Derby reads files of a shared file system only, not {folder}")
    return "/" + rest.lstrip("/")


def _java(*args: str, cwd: str) -> str:
    from pyspark.find_spark_home import _find_spark_home

    home = os.environ.get("JAVA_HOME")
    run = subprocess.run([f"{home}/bin/java" if home else "java", "-Xmx256m", "-cp", f"{_find_spark_home()}/jars/*", *args], cwd=cwd, capture_output=True, text=True, check=True)
    return run.stdout


def _build(batches: Iterator[pa.RecordBatch], table: str, columns: str, folder: str) -> str | None:
    """One part: the rows go to a file, Derby imports it, the database is stored in an archive without compression."""
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return None
    with tempfile.TemporaryDirectory() as own:
        with csv.CSVWriter(f"{own}/rows.csv", first.schema, write_options=csv.WriteOptions(include_header=False)) as out:
            out.write_batch(first)
            for batch in batches:
                out.write_batch(batch)
        script = ["connect 'jdbc:derby:db;create=true'", f"CREATE TABLE {table} ({columns})", f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table.upper()}', 'rows.csv', NULL, NULL, NULL, 0)", "connect 'jdbc:derby:db;shutdown=true'"]
        with open(f"{own}/build.sql", "w") as f:
            f.write(";\n".join([*script, ""]))
        said = _java("org.apache.derby.tools.ij", "build.sql", cwd=own)
        if bad := [line for line in said.splitlines() if line.startswith("ERROR") and "08006" not in line]:
            raise RuntimeError("\n".join(bad))
        os.remove(f"{own}/rows.csv")
        name = f"{uuid.uuid4().hex}.jar"
        with zipfile.ZipFile(f"{own}/{name}", "w", zipfile.ZIP_STORED) as archive:  # stored, so that a page is found without reading those before it
            for at, _, files in os.walk(f"{own}/db"):
                for file in files:
                    if not file.endswith(".lck"):
                        archive.write(f"{at}/{file}", os.path.relpath(f"{at}/{file}", own))
        os.makedirs(folder, exist_ok=True)
        shutil.copyfile(f"{own}/{name}", f"{folder}/{name}")
    return name


def store(rows: DataFrame, table: str, key: str, folder: str, part: int | None = None) -> list[str]:
    """The addresses of databases that hold ``rows`` (columns of numbers) in ranges of the key, about ``part`` (PART) in each; none for no rows."""
    spark, path = rows.sparkSession, local_path(folder)
    columns = ", ".join(f'"{c}" {TYPES[t]}' for c, t in rows.dtypes)
    count = max(1, -(-rows.count() // (part or PART)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = _build(batches, table, columns, path)
        yield pa.RecordBatch.from_pydict({"name": pa.array([name] if name else [], pa.string())})

    names = sorted(r["name"] for r in rows.repartitionByRange(count, key).mapInArrow(work, "name string").collect())  # one name a part
    return [f"jdbc:derby:jar:({path}/{name})db" for name in names]


def scan(rows: DataFrame, table: str, key: str, folder: str, partitions: int = 4, part: int | None = None) -> DataFrame:
    """``rows`` put into databases and read from them by Spark, each along its keys; filters are pushed down to all."""
    spark = rows.sparkSession
    parts = [jdbc.scan(spark, url, table, f'"{key}"', partitions, **DRIVER) for url in store(rows, table, key, folder, part)]
    return reduce(DataFrame.unionAll, parts) if parts else rows.limit(0)
