"""Queries of a relational database, of statements that a model has written, and of chunkers called from SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunk_function, statements
from ..registry import query, shared_folder, table
from ..sources import derby_files
from .documents import WINDOWS


@query("SELECT o_orderkey AS orderkey, round(o_totalprice, 2) AS price FROM orders WHERE o_totalprice > 150000 AND o_orderkey % 2 = 0")
def jdbc_orders(spark, sf_dir):
    """The orders, put into databases of a million rows at most in the shared folder and read from them along their keys; the price is compared there."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    found = derby_files.scan(orders, "orders", "o_orderkey", shared_folder(spark, "orders")).where("o_totalprice > 150000")
    return found.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("orderkey"), F.round("o_totalprice", 2).alias("price"))


#: What is said about each order priority: a query behind a fence, one with WITH, comments and words of writes in strings, and writes.
SAID = """CASE n WHEN 0 THEN concat('Here:\n```sql\nSELECT count(*) AS n FROM {orders} WHERE o_orderpriority = ''', p, '''\n```\nDone')
 WHEN 1 THEN concat('```sql\nWITH x AS (SELECT o_orderkey FROM {orders} WHERE o_orderpriority = ''', p, ''' AND ''DROP TABLE t'' <> ''''), y AS (SELECT max(o_orderkey) AS m FROM x) SELECT m AS n FROM y -- DELETE\n```')
 WHEN 2 THEN concat('```sql\n/* why */ DELETE FROM orders WHERE o_orderpriority = ''', p, '''\n```')
 WHEN 3 THEN concat('```sql\nWITH x AS (SELECT 1 AS a) INSERT INTO orders SELECT a FROM x\n```')
 WHEN 4 THEN concat('```sql\nSELECT 1; DROP TABLE orders\n```') ELSE '' END"""


@query("""SELECT p || '/' || n AS answer_id, CASE n WHEN 0 THEN '{"n":' || c || '}' WHEN 1 THEN '{"n":' || m || '}' END AS answer,
 CASE n WHEN 2 THEN 'Only SELECT statements are allowed' WHEN 3 THEN 'Only SELECT statements are allowed' WHEN 4 THEN 'Not a statement' WHEN 5 THEN 'SQL query is empty' END AS problem
 FROM (SELECT o_orderpriority AS p, count(*) AS c, max(o_orderkey) AS m FROM orders GROUP BY 1), (SELECT unnest(range(6)) AS n)""")
def sql_answers(spark, sf_dir):
    """What a model says is taken apart, judged by the parser, and run if it only reads."""
    orders = table(spark, sf_dir, "orders")
    name = f"orders_{uuid.uuid4().hex}"
    orders.createOrReplaceTempView(name)
    asked = orders.select(F.col("o_orderpriority").alias("p")).distinct().select("p", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n"))
    said = asked.select(F.concat("p", F.lit("/"), "n").alias("answer_id"), F.expr(SAID.replace("{orders}", name)).alias("said"))
    return statements.answers(spark, said, "answer_id", "said").select("answer_id", "answer", F.substring_index("problem", ":", 1).alias("problem"))


@query(f"SELECT doc_id, chunk_index, text, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM {WINDOWS}")
def chunk_from_sql(spark, sf_dir):
    """Word windows by the table function."""
    chunk_function.register(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, chunk_index, total_chunks, text FROM chunk(TABLE({docs}), kind => 'words', size => 500, overlap => 50)", docs=docs)
