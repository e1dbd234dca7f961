"""Queries of payloads, result fields, row validation, completeness, routing and retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records as P
from ..registry import query, table


def _payloads(spark, sf_dir):
    """Documents as their own chunks: a field that collides, one that may be null, promoted ones and one that isn't."""
    text = lambda **fields: F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])
    base = text(chunk_id=F.col("doc_id"), language=F.col("lang"), text=F.sha2("text", 256), source_id=F.col("source"))
    chunk = text(language=F.lit("xx"), note=F.nullif(F.col("lang"), F.lit("en")), category=F.lit("chunk"))
    document = text(author=F.col("source"), category=F.lit("document"), internal=F.lit("no"))
    return table(spark, sf_dir, "documents").select("doc_id", P.payload(base, chunk, document).alias("payload"))


@query("SELECT doc_id, array_to_string(list_sort(list_filter(['author=' || source, 'category=document', 'chunk_id=' || doc_id, 'language=' || lang, 'note=' || nullif(lang, 'en'), 'source_id=' || source, 'text=' || sha256(text)], lambda x: x IS NOT NULL)), ',') AS payload FROM documents")
def chunk_payload(spark, sf_dir):
    return _payloads(spark, sf_dir).select("doc_id", P.entries(F.col("payload")).alias("payload"))


@query("SELECT doc_id, coalesce(sha256(text), '') AS content, 'notion' AS source_type, coalesce(source, '') AS source_id, 'Unknown' AS source_title, NULL::VARCHAR AS source_url, array_to_string(list_sort(list_filter(['author=' || source, 'category=document', 'chunk_id=' || doc_id, 'language=' || lang, 'note=' || nullif(lang, 'en')], lambda x: x IS NOT NULL)), ',') AS metadata FROM documents")
def result_fields(spark, sf_dir):
    found = _payloads(spark, sf_dir).select("doc_id", *P.result_fields(F.col("payload")))
    return found.withColumn("metadata", P.entries(F.col("metadata")))


@query(r"SELECT doc_id, concat_ws(',', CASE WHEN NOT coalesce(length(text) BETWEEN 1 AND 4000, false) THEN 'text' END, CASE WHEN NOT coalesce(regexp_matches(lang, '^(en|de)\z'), false) THEN 'lang' END, CASE WHEN NOT coalesce(n_chars = length(text), false) THEN 'n_chars' END) AS problems FROM documents WHERE problems <> ''")
def rejected_rows(spark, sf_dir):
    rules = {"text": F.length("text").between(1, 4000), "lang": F.col("lang").rlike(r"^(en|de)\z"), "n_chars": F.col("n_chars") == F.length("text")}
    rejected = P.split_valid(table(spark, sf_dir, "documents"), rules)[1]
    return rejected.select("doc_id", F.array_join("problems", ",").alias("problems"))


@query("SELECT count(*) AS n_rows, round(count(text) / count(*), 6) AS text, round(count(lang) / count(*), 6) AS lang, round(count(source) / count(*), 6) AS source FROM documents")
def column_completeness(spark, sf_dir):
    return P.completeness(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


ASKED = "CASE o_orderkey % 7 WHEN 0 THEN concat('주문 테이블 ', o_orderkey) WHEN 1 THEN concat(o_orderkey, ' 칼럼 문서') WHEN 2 THEN 'Wiki 어디' WHEN 3 THEN concat('설명해줘 SELECT ', o_orderkey) WHEN 4 THEN '설명해줘 selected' WHEN 5 THEN concat('매출 ', o_orderpriority) END"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 2 THEN 'data_discovery' WHEN o_orderkey % 7 = 2 THEN 'knowledge_discovery' WHEN o_orderkey % 7 = 3 THEN 'query_assistant' ELSE 'text_to_sql' END AS route FROM orders")
def keyword_route(spark, sf_dir):
    """The chain for a question about each order; some fit two, some none, some are null."""
    return table(spark, sf_dir, "orders").select("o_orderkey", P.keyword_route(F.expr(ASKED)).alias("route"))


CODES = ["rate_limited", "internal_server_error", "service_unavailable", "validation_error"]


@query("SELECT status, code, count(*) AS n, status = 429 OR status >= 500 OR coalesce(code IN ('rate_limited', 'internal_server_error', 'service_unavailable'), false) AS again FROM (SELECT CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 429 ELSE 404 END AS status, (['rate_limited', 'internal_server_error', 'service_unavailable', 'validation_error', NULL])[(event_id % 5 + 1)::INT] AS code FROM events) GROUP BY 1, 2")
def retry_policy(spark, sf_dir):
    """Event types stand in for the status of calls, ids for the codes in their answers."""
    kind = F.col("event_type")
    code = F.get(F.array(*map(F.lit, CODES)), (F.col("event_id") % 5).cast("int"))
    calls = table(spark, sf_dir, "events").select(F.when(kind == "error", 503).when(kind == "click", 429).otherwise(404).alias("status"), code.alias("code"))
    return calls.groupBy("status", "code").agg(F.count("*").alias("n")).withColumn("again", T.retryable(F.col("status"), F.col("code")))
