"""Queries of chunking, snapshots and synchronisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import tables as B
from ..registry import query, table
from .search import WORDS

WINDOWS = f"(SELECT doc_id, i::BIGINT AS chunk_index, array_to_string(w[i * 450 + 1 : i * 450 + 500], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 450 + 1)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0))"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _windows(spark, sf_dir):
    return C.chunk_documents(_docs(spark, sf_dir), C.word_windows(F.col("text")))


@query(f"SELECT doc_id, chunk_index, text, (length(text) // 3)::BIGINT AS token_count FROM {WINDOWS}")
def chunk_words(spark, sf_dir):
    return _windows(spark, sf_dir).select("doc_id", "chunk_index", "text", "token_count")


@query(f"SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, max(chunk_index)::BIGINT AS last_index, sum(length(text) // 3)::BIGINT AS tokens FROM {WINDOWS}")
def chunk_stats(spark, sf_dir):
    return _windows(spark, sf_dir).agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.max("chunk_index").alias("last_index"), F.sum("token_count").alias("tokens"))


@query()
def chunk_recursive(spark, sf_dir):
    return C.chunk_documents(_docs(spark, sf_dir), C.recursive_chunks()(F.col("text")))


@query()
def chunk_hierarchical(spark, sf_dir):
    return C.hierarchical(_docs(spark, sf_dir))


@query(f"SELECT c.doc_id, c.chunk_index, length(p.text)::BIGINT AS parent_chars FROM {WINDOWS} c LEFT JOIN {WINDOWS} p ON p.doc_id = c.doc_id AND p.chunk_index = 0 WHERE c.chunk_index > 0")
def child_parent_context(spark, sf_dir):
    """Later windows of a document as children of its first one."""
    from ..operators.retrieval import parent_context

    chunks = _windows(spark, sf_dir)
    children = chunks.where("chunk_index > 0").select("doc_id", "chunk_index", C.chunk_id(F.col("doc_id"), F.lit(0)).alias("parent_id"))
    found = parent_context(children, chunks.where("chunk_index = 0").select("chunk_id", "text"))
    return found.select("doc_id", "chunk_index", F.length("parent_text").cast("long").alias("parent_chars"))


OLD = "(SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)"
NEW = "(SELECT doc_id + 7 AS doc_id, sha256(coalesce(text, '')) AS h FROM documents)"
DIFF = f"(SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'updated' ELSE 'unchanged' END AS action FROM {OLD} o FULL JOIN {NEW} n ON o.doc_id = n.doc_id)"


def snapshots(spark, sf_dir):
    """Two states of one source: the whole table, and the whole table under ids moved by seven, so that rows came, went, changed and stayed."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", digest), docs.select((F.col("doc_id") + 7).alias("doc_id"), digest)


@query(f"SELECT doc_id, action FROM {DIFF}")
def doc_diff(spark, sf_dir):
    return B.diff(*snapshots(spark, sf_dir), "doc_id", "content_hash")


@query(f"SELECT action, count(*) AS n FROM {DIFF} GROUP BY action")
def sync_counters(spark, sf_dir):
    return doc_diff(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, h AS content_hash FROM {NEW} UNION ALL SELECT o.doc_id, o.h FROM {OLD} o ANTI JOIN {NEW} n ON o.doc_id = n.doc_id")
def snapshot_upsert(spark, sf_dir):
    return B.upsert(*snapshots(spark, sf_dir), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src3'")
def delete_by_filter(spark, sf_dir):
    return B.delete_where(_docs(spark, sf_dir), "source", "src3").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def delete_by_ids(spark, sf_dir):
    return B.delete_ids(_docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT o_orderkey AS job_id, o_orderdate AS started_at FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 100")
def job_history_cap(spark, sf_dir):
    """Orders stand in for jobs."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("started_at"))
    return B.newest(jobs, [F.col("started_at").desc_nulls_last(), F.desc("job_id")], 100)


@query("SELECT source, count(*) AS documents, count(text) AS with_text, round(count(text) / count(*), 6) AS completeness, max(doc_id) AS latest FROM documents GROUP BY source")
def source_discovery(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.count("text").alias("with_text"), F.round(F.count("text") / F.count("*"), 6).alias("completeness"), F.max("doc_id").alias("latest"))


@query(r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))::BIGINT AS text_chars FROM pages")
def html_pages_text(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.length(F.trim(F.regexp_replace(bare, r"\s+", " "))).cast("long").alias("text_chars"))
