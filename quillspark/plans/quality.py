"""Queries of retrieval quality: vectors of the query's label are relevant, itself left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import retrieval as R
from ..registry import query, table
from .search import COS

RESULTS = f"(SELECT query_id, ql, rank, ql = label AS relevant FROM (SELECT q.vec_id AS query_id, q.label AS ql, e.vec_id AS id, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.vec_id <> q.vec_id) WHERE rank <= 10)"
BY_QUERY = f"(SELECT query_id, any_value(ql) AS label, coalesce(min(rank) FILTER (relevant) <= 1, false) AS hit_1, coalesce(min(rank) FILTER (relevant) <= 5, false) AS hit_5, coalesce(min(rank) FILTER (relevant) <= 10, false) AS hit_10, coalesce(1.0::DOUBLE / min(rank) FILTER (relevant), 0) AS reciprocal_rank FROM {RESULTS} GROUP BY query_id)"


def _by_query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0")
    top = R.nearest(asked, vectors, 10, itself=False)
    wanted = asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    judged = top.join(vectors.select(F.col("vec_id").alias("id"), "label"), "id").join(wanted, "query_id")
    hits = E.hits(judged.withColumn("relevant", F.col("label") == F.col("wanted")), (1, 5, 10), F.max("score").alias("top_score"))
    return hits.join(wanted.withColumnRenamed("wanted", "label"), "query_id")


def _rate(c):
    return F.round(F.avg(F.col(c).cast("int")), 6).alias(c)


@query(f"SELECT round(avg(hit_1::INT), 6) AS hit_1, round(avg(hit_5::INT), 6) AS hit_5, round(avg(hit_10::INT), 6) AS hit_10 FROM {BY_QUERY}")
def hit_at_k(spark, sf_dir):
    return _by_query(spark, sf_dir).agg(*map(_rate, ("hit_1", "hit_5", "hit_10")))


@query(f"SELECT round(avg(reciprocal_rank), 6) AS mrr FROM {BY_QUERY}")
def mrr(spark, sf_dir):
    return _by_query(spark, sf_dir).agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


@query(f"SELECT label, count(*) AS queries, round(avg(hit_5::INT), 6) AS hit_5 FROM {BY_QUERY} GROUP BY GROUPING SETS ((label), ())")
def accuracy_by_group(spark, sf_dir):
    return _by_query(spark, sf_dir).rollup("label").agg(F.count("*").alias("queries"), _rate("hit_5"))


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def latency_percentiles(spark, sf_dir):
    return E.latencies(table(spark, sf_dir, "events"), "value")


@query("WITH m AS (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding)))::BIGINT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2), s AS (SELECT label, sqrt(sum(m * m)) AS size FROM m GROUP BY 1) SELECT m.label, m.dim, round(m / size, 6) AS value FROM m JOIN s ON m.label = s.label")
def centroids(spark, sf_dir):
    return E.centroids(table(spark, sf_dir, "embeddings"), "label")


@query("SELECT column_name, CASE data_type WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS data_type FROM information_schema.columns WHERE table_name = 'documents'")
def schema_catalog(spark, sf_dir):
    columns = table(spark, sf_dir, "documents").dtypes
    return spark.createDataFrame(columns, "column_name string, data_type string")


BY_LANGUAGE = f"(SELECT b.*, d.lang, coalesce(s.n, 0) AS top_score, CASE WHEN a.n > 100 THEN 'many' ELSE 'few' END AS n_answers FROM {BY_QUERY} b LEFT JOIN documents d ON d.doc_id = b.query_id JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) a ON a.label = b.label LEFT JOIN (SELECT query_id, score AS n FROM (SELECT q.vec_id AS query_id, {COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.vec_id <> q.vec_id) WHERE rank = 1) s ON s.query_id = b.query_id)"


def _by_language(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "lang")
    counts = vectors.groupBy("label").agg(F.when(F.count("*") > 100, "many").otherwise("few").alias("n_answers"))
    return _by_query(spark, sf_dir).join(langs, "query_id", "left").join(counts, "label")


@query(f"SELECT lang, label, n_answers, count(*) AS queries, round(avg(hit_5::INT), 6) AS hit_5, count(*) FILTER (NOT hit_5) AS failures FROM {BY_LANGUAGE} GROUP BY GROUPING SETS ((lang), (label), (n_answers), ())")
def accuracy_by_groups(spark, sf_dir):
    """By language, category and number of answers, with failures, in one pass."""
    sets = _by_language(spark, sf_dir).groupingSets([["lang"], ["label"], ["n_answers"], []], "lang", "label", "n_answers")
    return sets.agg(F.count("*").alias("queries"), _rate("hit_5"), F.count_if(~F.col("hit_5")).alias("failures"))


@query(f"SELECT count(*) AS queries, round(avg(hit_5::INT), 6) AS accuracy, round(avg(top_score), 6) AS relevance, count(*) FILTER (top_score < 0.5) AS weak FROM {BY_LANGUAGE}")
def validation_summary(spark, sf_dir):
    found = _by_language(spark, sf_dir)
    return found.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hit_5").cast("int")), 6).alias("accuracy"), F.round(F.avg("top_score"), 6).alias("relevance"), F.count_if(F.col("top_score") < 0.5).alias("weak"))
