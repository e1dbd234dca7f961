"""The parse guard, database scans and the chunk table function."""

import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunk_function, chunking
from quillspark.operators.statements import answers, problem
from quillspark.sources import jdbc
from quillspark.sources.collections import select_only

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.mark.parametrize("sql", [
    "SELECT 1", "select id from range(3);", "WITH x AS (SELECT 1 AS a) SELECT * FROM x", "/* drop table t */ SELECT 'DELETE FROM t; DROP TABLE t' AS `update` -- insert",
    "SELECT * FROM range(9) r WHERE id IN (SELECT max(id) FROM range(4) WHERE EXISTS (SELECT 1)) ORDER BY 1 LIMIT 3 OFFSET 0", "VALUES (1), (2)", "(SELECT 1) UNION ALL (SELECT 2) EXCEPT SELECT 3",
    "SELECT sum(id) OVER (ORDER BY id) FROM (SELECT * FROM range(3)) TABLESAMPLE (50 PERCENT)", "SELECT a FROM (SELECT array(1) AS b) LATERAL VIEW explode(b) t AS a", "FROM range(3) |> WHERE id > 1", "SELECT count(*) FROM range(3) HAVING count(*) > 1",
])
def test_queries_pass(spark, sql):
    assert problem(spark, sql) is None
    select_only(spark, sql.rstrip(";")).collect()


@pytest.mark.parametrize("sql", [
    None, "", "  \n", "DROP TABLE t", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SELECT 1; DROP TABLE t", "EXECUTE IMMEDIATE 'DROP TABLE t'", "CALL p()", "SELECT TRANSFORM(id) USING 'rm' FROM range(3)",
    "BEGIN SELECT 1; END", "FROM t INSERT INTO u SELECT * INSERT INTO v SELECT *", "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1", "SET a = 1", "CACHE TABLE t", "EXPLAIN SELECT 1", "ADD JAR 'x'", "SELEC 1", "SELECT 'open",
    "MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN DELETE", "TRUNCATE TABLE t", "USE x", "CREATE TEMPORARY VIEW x AS SELECT 1",
])
def test_what_is_no_query_is_refused(spark, sql):
    assert problem(spark, sql)
    with pytest.raises(ValueError):
        select_only(spark, sql)


def test_more_statements_than_allowed_fail(spark):
    said = spark.range(5).select("id", F.lit("SELECT 1 AS a").alias("said"))
    assert {r.answer for r in answers(spark, said, "id", "said").collect()} == {'{"a":1}'}
    with pytest.raises(ValueError, match="more than 4"):
        answers(spark, said, "id", "said", most=4)


def test_parameters_are_bound_outside_of_strings():
    sql = """SELECT ':a', ":a", x::int /* :a */ FROM t WHERE b = :a AND c = :n -- :a"""
    assert jdbc.bound(sql, {"a": "o'clock", "n": None}) == """SELECT ':a', ":a", x::int /* :a */ FROM t WHERE b = 'o''clock' AND c = NULL -- :a"""
    with pytest.raises(ValueError, match="parameter b"):
        jdbc.bound("SELECT :b", {"a": 1})


def test_a_database_is_read_in_parts_with_filters_pushed(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    rows = spark.range(100).select(F.col("id").alias("ID"), (F.col("id") % 7).cast("string").alias("KIND"))
    rows.write.format("jdbc").options(url=url, dbtable="things", createTableColumnTypes="KIND VARCHAR(10)", **DERBY).save()
    found = jdbc.scan(spark, url, "things", "ID", 4, **DERBY)
    assert found.rdd.getNumPartitions() == 4 and sorted(r.ID for r in found.collect()) == list(range(100))
    some = found.where("ID >= 90 AND KIND = '6'").select("ID")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ID,90)" in plan and "EqualTo(KIND,6)" in plan and "PushedFilters" in plan
    assert sorted(r.ID for r in some.collect()) == [90, 97]
    assert jdbc.ask(spark, url, "SELECT ID FROM things WHERE KIND = :k AND ID > :low;", {"k": "6", "low": 80}, **DERBY).count() == 3
    with pytest.raises(ValueError, match="Only SELECT"):
        jdbc.ask(spark, url, "DELETE FROM things", **DERBY)
    rows.limit(0).write.format("jdbc").options(url=url, dbtable="nothing", **DERBY).save()
    assert jdbc.scan(spark, url, "nothing", "ID", 4, **DERBY).count() == 0


def test_chunks_from_sql_equal_the_column_form(spark):
    chunk_function.register(spark)
    docs = spark.createDataFrame([(1, "One. Two!  Three? " * 40, "x"), (2, None, "y"), (3, " ", "z"), (4, "a|b|" * 100, None)], "doc_id long, body string, chunk_index string")
    mine = spark.sql("SELECT doc_id, chunk_index, body FROM chunk(TABLE({docs}), text => 'body', size => 100, overlap => 20)", docs=docs)
    column = chunking.chunk_documents(docs.withColumnRenamed("body", "text"), chunking.recursive_chunks(100, 20)(F.col("text"))).select("doc_id", "chunk_index", "text")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, column.collect())) and mine.count() > 10
    cut = spark.sql("SELECT body FROM chunk(TABLE({docs}), 'body', size => 40, overlap => 0, separators => array('|', '')) WHERE doc_id = 4", docs=docs).collect()
    assert all(len(r.body) <= 40 for r in cut) and "".join(r.body for r in cut) == "a|b|" * 100
    assert spark.sql("SELECT * FROM chunk(TABLE({docs}), text => 'body')", docs=docs).columns == ["doc_id", "chunk_index", "total_chunks", "body"]
    dealt = spark.sql("SELECT doc_id, count(*) AS n FROM chunk(TABLE({docs}) PARTITION BY doc_id, text => 'body', size => 50, overlap => 0) GROUP BY 1", docs=docs)
    assert {r.doc_id for r in dealt.collect()} == {1, 4}


@pytest.mark.parametrize("call", ["chunk(1)", "chunk(TABLE({docs}), text => 'none')", "chunk(TABLE({docs}), kind => 'odd')", "chunk(TABLE({docs}), size => 10, overlap => 10)"])
def test_wrong_arguments_are_named(spark, call):
    chunk_function.register(spark)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="of chunk|chunk finds"):
        spark.sql(f"SELECT * FROM {call}", docs=docs).collect()
