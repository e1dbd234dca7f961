"""Queries of the index kept in step, of chunk invariants, injected models and whole answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import model_json as M
from ..operators import chunking as C
from ..operators import indexing as I
from ..operators import retrieval as R
from ..registry import query, table
from .documents import DIFF, WINDOWS, snapshots
from .search import ANSWER, HITS, _hits


def _refreshed(spark, sf_dir):
    """The index of one snapshot brought to the other, whose ids are moved."""
    docs = table(spark, sf_dir, "documents")
    parts = lambda text: C.word_windows(text)
    old = snapshots(spark, sf_dir)[0]
    return I.refresh(C.chunk_documents(docs, parts(F.col("text"))), old, docs.withColumn("doc_id", F.col("doc_id") + 7), parts)


@query(f"SELECT doc_id + 7 AS doc_id, chunk_index, sha256(text) AS sha, (length(text) // 3)::BIGINT AS token_count FROM {WINDOWS}")
def index_refreshed(spark, sf_dir):
    """Chunks after the synchronisation are those of the new snapshot cut afresh."""
    chunks, _ = _refreshed(spark, sf_dir)
    return chunks.select("doc_id", "chunk_index", F.sha2("text", 256).alias("sha"), "token_count")


@query(f"SELECT d.action, count(DISTINCT d.doc_id) AS documents, count(w.chunk_index) AS chunks FROM {DIFF} d LEFT JOIN {WINDOWS} w ON w.doc_id + 7 = d.doc_id AND d.action <> 'deleted' GROUP BY d.action")
def index_counters(spark, sf_dir):
    chunks, found = _refreshed(spark, sf_dir)
    per_document = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return found.join(per_document, "doc_id", "left").groupBy("action").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


BLANK = r"trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''"


@query(f"SELECT doc_id, true AS within_size, true AS numbered, true AS in_text, true AS from_start_to_end FROM documents WHERE text IS NOT NULL AND NOT {BLANK}")
def chunk_recursive_invariants(spark, sf_dir):
    """Chunks are no longer than the size, numbered without gaps, parts of the text, and reach from its start to its end."""
    docs = table(spark, sf_dir, "documents")
    rows = C.chunk_documents(docs, C.recursive_chunks()(F.col("text"))).groupBy("doc_id").agg(
        F.max(F.length("text")).alias("longest"), F.count("*").alias("n"), F.max("chunk_index").alias("last"), F.count_distinct("chunk_id").alias("ids"),
        F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("parts"),
    )
    joined = rows.join(docs.select("doc_id", F.regexp_replace("text", r"^\s+|\s+$", "").alias("whole")), "doc_id")
    ends = F.col("whole").startswith(F.element_at("parts", 1)["text"]) & F.col("whole").endswith(F.element_at("parts", -1)["text"])
    return joined.select("doc_id", (F.col("longest") <= 1000).alias("within_size"), ((F.col("n") == F.col("last") + 1) & (F.col("n") == F.col("ids"))).alias("numbered"), F.forall("parts", lambda p: F.col("whole").contains(p["text"])).alias("in_text"), ends.alias("from_start_to_end"))


@query(f"SELECT doc_id, true AS parents_exist, true AS in_parent, true AS numbered, true AS within_size FROM documents WHERE text IS NOT NULL AND NOT {BLANK}")
def chunk_hierarchical_invariants(spark, sf_dir):
    rows = C.hierarchical(table(spark, sf_dir, "documents"))
    children = rows.where("chunk_type = 'child'")
    parents = rows.where("chunk_type = 'parent'").select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent"))
    joined = children.join(parents, "parent_id", "left")
    return joined.groupBy("doc_id").agg(
        F.bool_and(F.col("parent").isNotNull()).alias("parents_exist"), F.bool_and(F.col("parent").contains(F.col("text"))).alias("in_parent"),
        ((F.count("*") == F.max("chunk_index") + 1) & (F.count("*") == F.count_distinct("chunk_index"))).alias("numbered"), F.bool_and(F.length("text") <= 800).alias("within_size"),
    )


def _letter_counts():
    """A stand-in for a model: how often the vowels stand in a text."""
    return lambda texts: [[float(t.count(v)) for v in "aeiou"] for t in texts]


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) <> '' THEN (length(text) - length(replace(text, 'a', '')))::DOUBLE END AS a, CASE WHEN trim(coalesce(text, '')) <> '' THEN (length(text) - length(replace(text, 'u', '')))::DOUBLE END AS u FROM documents")
def injected_embedding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return I.embedded(docs, _letter_counts).select("doc_id", F.col("embedding")[0].alias("a"), F.col("embedding")[4].alias("u"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS cache_key, 'about ' || length(text) AS summary FROM documents")
def extracted_once(spark, sf_dir):
    """The model is asked once for texts that are alike."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("cache_key"))
    say = lambda text: M.metadata(F.to_json(F.struct(F.concat(F.lit("about "), F.length(text)).alias("summary"))))["summary"]
    return I.once_per(docs, "cache_key", say, "text", "summary").select("doc_id", "cache_key", F.when(F.col("text").isNotNull(), F.col("summary")).alias("summary"))


@query(f"{ANSWER} SELECT q.query_id, coalesce(p.n, 0) AS n_documents, c.cited, CASE WHEN p.n IS NULL OR p.n % 2 = 0 THEN '관련 문서를 찾을 수 없습니다. 다른 키워드로 질문해 주세요.' ELSE p.n || ' documents of ' || p.chars END AS answer FROM (SELECT DISTINCT query_id FROM t) q LEFT JOIN p ON p.query_id = q.query_id LEFT JOIN c ON c.query_id = q.query_id")
def retrieved_answer(spark, sf_dir):
    """From the search to the answer in one plan; the stand-in for the model says nothing to an even number of documents."""
    hits = _hits(spark, sf_dir)
    questions = hits.select("query_id").distinct().withColumn("question", F.concat(F.lit("Question "), "query_id"))
    answer = lambda prompt, results: F.when(F.size(results) % 2 == 1, F.concat(F.size(results), F.lit(" documents of "), F.aggregate(results, F.lit(0), lambda s, r: s + F.length(r["content"]))))
    found = R.answers(questions, hits.where("rank <= 5"), answer, threshold=0.35)
    return found.select("query_id", "n_documents", F.array_join("cited", ",").alias("cited"), "answer")


@query(f"{HITS} SELECT query_id, sha256('## 이전 답변' || chr(10) || 'Before ' || query_id || chr(10) || chr(10) || '## 추가 참고 문서' || chr(10) || string_agg('### [' || rank || '] ' || title || ' (' || source || ')' || chr(10) || content || chr(10) || chr(10), '' ORDER BY rank) || '## 후속 질문' || chr(10) || 'Question ' || query_id || chr(10) || chr(10) || '이전 답변을 참고하여 후속 질문에 답변해주세요.') AS prompt_sha256 FROM t WHERE rank <= 3 GROUP BY query_id")
def followup_prompt(spark, sf_dir):
    results = _hits(spark, sf_dir).where("rank <= 3")
    questions = results.select("query_id").distinct().select("query_id", F.concat(F.lit("Question "), "query_id").alias("question"), F.concat(F.lit("Before "), "query_id").alias("previous"))
    return R.followup_prompts(questions, results).select("query_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("SELECT item_id, sha256('관련 문서를 찾을 수 없습니다.' || chr(10) || chr(10) || '## 질문' || chr(10) || text || chr(10) || chr(10) || '위 질문에 대해 관련 문서를 찾을 수 없다고 안내하고,' || chr(10) || '질문을 다시 구체화하거나 다른 키워드로 질문해달라고 요청하세요.') AS prompt_sha256 FROM benchmark")
def no_context_prompt(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(R.no_context_prompt(F.col("text")), 256).alias("prompt_sha256"))


@query("SELECT r_regionkey, 'Table: orders' || chr(10) || '  - o_orderkey' || chr(10) || '  - ' || r_name || chr(10) || chr(10) || 'Table: nation' || chr(10) || '  - n_name' || chr(10) AS prompt FROM region")
def schema_prompt(spark, sf_dir):
    columns = F.create_map(F.lit("orders"), F.array(F.lit("o_orderkey"), F.col("r_name")), F.lit("nation"), F.array(F.lit("n_name")))
    return table(spark, sf_dir, "region").select("r_regionkey", M.schema_prompt(["orders", "nation"], columns).alias("prompt"))
