"""A database in files, read by processes other than the driver."""

import os
import subprocess
import sys

from quillspark.sources import derby_files as D

#: Executors are other processes than the driver; what they read must not live in its memory.
CLUSTER = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.config(map={{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.checkpoint.dir": {shared!r}, "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}}).getOrCreate()
from quillspark.queries import QUERIES
print(sorted(tuple(r) for r in QUERIES["jdbc_orders"](spark, "/root/testdata/sf0.001").collect()))
spark.stop()
"""


def test_jdbc_orders_in_a_cluster(tmp_path):
    import duckdb

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": repo}
    code = CLUSTER.format(repo=repo, shared=f"file://{tmp_path}/shared")
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    want = duckdb.sql("SELECT o_orderkey, round(o_totalprice, 2) FROM '/root/testdata/sf0.001/orders.parquet' WHERE o_totalprice > 150000 AND o_orderkey % 2 = 0 ORDER BY 1").fetchall()
    assert said.stdout.strip().splitlines()[-1] == str(want) and want


def test_parts_hold_every_row_and_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i / 3, None if i % 5 == 0 else i) for i in range(100)] + [(None, 1e-300, -1), (3, -1.5e300, 2)], "k long, x double, n int")
    found = D.scan(rows, "things", "k", f"file://{tmp_path}/parts", 2, part=30)
    assert len(list((tmp_path / "parts").iterdir())) == 4
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert found.where("x > 32").count() == rows.where("x > 32").count()
    assert D.scan(rows.limit(0), "things", "k", f"file://{tmp_path}/none").count() == 0
