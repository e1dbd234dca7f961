"""Queries of answers, block trees, guarded SQL, job roll-ups and clusters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import messages as M
from ..registry import query, table
from ..sources import blocks as B

WIDTH = 3900 - len(M.CONTINUED)
SPLIT = f"(SELECT doc_id, text, greatest(0, ceil((length(text) - 3900) / {WIDTH}.0))::INT AS k FROM documents)"


@query(f"SELECT doc_id, k + 1 AS parts, sha256(array_to_string(list_transform(range(0, k + 1), lambda i: CASE WHEN i < k THEN substr(text, (i * {WIDTH} + 1)::BIGINT, {WIDTH}) || chr(10) || chr(10) || '_(계속...)_' ELSE substr(text, (k * {WIDTH} + 1)::BIGINT) END), '|')) AS parts_sha256 FROM {SPLIT}")
def response_split(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", M.response_parts(F.col("text"), F.lit("")).alias("p"))
    return parts.select("doc_id", F.size("p").alias("parts"), F.sha2(F.array_join("p", "|"), 256).alias("parts_sha256"))


@query()
def message_split(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", M.message_parts()(F.col("text")).alias("p"))
    return parts.select("doc_id", F.posexplode(M.numbered(F.col("p"))).alias("part", "text"))


#: Each document is a page of eight blocks, some inside others: (name, parent, position, type).
BLOCKS = [("a", None, 0, "heading_2"), ("b", None, 1, "toggle"), ("c", "b", 1, "to_do"), ("d", "b", 0, "code"), ("e", None, 2, "column_list"), ("f", "e", 0, "table_row"), ("g", None, 3, "bookmark"), ("h", "f", 0, "paragraph")]


@query("""SELECT 'p' || doc_id AS page_id, concat_ws(chr(10) || chr(10), '## ' || coalesce(source, ''), 'T' || doc_id, '```sql' || chr(10) || 'SELECT ' || doc_id || chr(10) || '```', CASE WHEN doc_id % 2 = 0 THEN '[x] ' ELSE '[ ] ' END || coalesce(lang, ''),
 coalesce(lang, '') || ' | ' || doc_id, CASE WHEN doc_id % 3 > 0 THEN 'D' || n_chars END, CASE WHEN doc_id % 5 = 0 THEN 'https://d.example/' || doc_id ELSE '[Site ' || doc_id || '](https://d.example/' || doc_id || ')' END) AS content FROM documents""")
def block_texts(spark, sf_dir):
    """Block trees made of all documents, as text in reading order; blank blocks leave no line."""
    doc, name = F.col("doc_id").cast("string"), F.col("b.block_id")
    listed = F.array(*[F.struct(F.lit(n).alias("block_id"), F.lit(up).cast("string").alias("parent_id"), F.lit(at).alias("position"), F.lit(kind).alias("type")) for n, up, at, kind in BLOCKS])
    each = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.explode(listed).alias("b"))
    text = F.when(name == "a", F.coalesce("source", F.lit(""))).when(name == "b", F.concat(F.lit("T"), doc)).when(name == "c", F.coalesce("lang", F.lit(""))).when(name == "d", F.concat(F.lit("SELECT "), doc)).when(name == "h", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("D"), "n_chars")).otherwise("  "))
    none = F.lit(None).cast("string")
    rows = each.select(
        F.concat(F.lit("p"), doc).alias("page_id"), "b.*", text.alias("text"), F.when((name == "g") & (F.col("doc_id") % 5 != 0), F.concat(F.lit("Site "), doc)).alias("caption"),
        F.when(name == "g", F.concat(F.lit("https://d.example/"), doc)).alias("url"), F.when(name == "d", "sql").alias("language"), none.alias("icon"), none.alias("name"),
        (F.col("doc_id") % 2 == 0).alias("checked"), F.when(name == "f", F.array(F.coalesce("lang", F.lit("")), doc)).alias("cells"),
    )
    return B.page_texts(rows)


#: What a model says about each order: fenced, in prose, a write, a write in a fence, two statements, nothing, a harmless word.
SAID = """CASE o_orderkey % 7 WHEN 0 THEN concat('Here:\n```sql\nSELECT a FROM t', o_orderkey, ';\n```\ndone') WHEN 1 THEN concat('Try select b from t', o_orderkey) WHEN 2 THEN concat('DROP TABLE t', o_orderkey)
 WHEN 3 THEN concat('```sql\nDELETE FROM t', o_orderkey, '\n```') WHEN 4 THEN concat('SELECT ', o_orderkey, '; DROP TABLE t;') WHEN 5 THEN '' ELSE concat('SELECT updated FROM t', o_orderkey, ';') END"""


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'SELECT a FROM t' || o_orderkey || ';' WHEN 1 THEN 'select b from t' || o_orderkey || ';' WHEN 2 THEN 'DROP TABLE t' || o_orderkey WHEN 3 THEN 'DELETE FROM t' || o_orderkey WHEN 4 THEN 'SELECT ' || o_orderkey || '; DROP TABLE t;' WHEN 5 THEN '' ELSE 'SELECT updated FROM t' || o_orderkey || ';' END AS sql,
 CASE o_orderkey % 7 WHEN 2 THEN 'Only SELECT statements are allowed' WHEN 3 THEN 'Only SELECT statements are allowed' WHEN 4 THEN 'Dangerous operation detected: DROP' WHEN 5 THEN 'SQL query is empty' END AS problem FROM orders""")
def sql_guard(spark, sf_dir):
    """Statements in answers about all orders, and why they are refused, by their words alone."""
    sql = table(spark, sf_dir, "orders").select("o_orderkey", T.extract_sql(F.expr(SAID)).alias("sql"))
    return sql.withColumn("problem", T.sql_problem(F.col("sql")))


@query("SELECT user_id AS job_id, count(*) AS processed, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN bool_or(event_type = 'error') THEN 'partial' ELSE 'completed' END AS status, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS seconds FROM events GROUP BY 1")
def job_rollup(spark, sf_dir):
    """Events stand in for the sources that a job worked on."""
    failed = F.col("event_type") == "error"
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    status = F.when(F.bool_or(failed), "partial").otherwise("completed").alias("status")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.count("*").alias("processed"), F.count_if(failed).alias("errors"), status, (F.max(second) - F.min(second)).alias("seconds"))


@query("SELECT (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS indexed, (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_job")
def status_panel(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("done", F.lit(1))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(done, "doc_id", "left")
    counts = docs.agg(F.count_distinct("source").alias("sources"), F.count("*").alias("documents"), F.count("done").alias("indexed"))
    last = table(spark, sf_dir, "events").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return counts.join(last).select("sources", "documents", "indexed", F.col("last.event_id").alias("last_job"))  # one row each


@query()
def vector_clusters(spark, sf_dir):
    """Three samples of each of five k-means clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    found = KMeans(k=5, seed=1).fit(vectors).transform(vectors)
    nth = F.row_number().over(W.partitionBy("prediction").orderBy("vec_id"))
    return found.withColumn("sample", nth).where("sample <= 3").select(F.col("prediction").alias("cluster"), "sample", "vec_id")
