"""Queries of the search over children with their parents' context, and of responses with a fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import retrieval as R
from ..registry import query, table
from .search import ANSWER, WORDS, _hits

UUID = "regexp_replace(substr(sha256(doc_id || ':{}:' || {}), 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
COUNTS = "list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: (length({0}) - length(replace({0}, v, '')))::DOUBLE)"
COSINE = "CASE WHEN list_sum(list_transform(c.v, lambda x: x * x)) * list_sum(list_transform(q.v, lambda x: x * x)) = 0 THEN 0 ELSE list_cosine_similarity(c.v, q.v) END"


def _letters(text):
    """A stand-in for an embedding: how often the vowels stand in a text."""
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(v), F.lit("")))).cast("double") for v in "aeiou"])


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
 p AS (SELECT doc_id, i AS pi, w[i * 100 + 1 : i * 100 + 120] AS pw FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 100 + 1)) AS i FROM w WHERE len(w) > 0)),
 k AS (SELECT doc_id, pi, pw, j, array_to_string(pw[j * 25 + 1 : j * 25 + 30], ' ') AS text FROM (SELECT doc_id, pi, pw, unnest(range(0, (len(pw) - 1) // 25 + 1)) AS j FROM p)),
 c AS (SELECT *, {UUID.format('child', 'n')} AS id, {UUID.format('parent', 'pi')} AS parent_id, {COUNTS.format('text')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pi, j) - 1 AS n FROM k)),
 q AS (SELECT item_id AS query_id, {COUNTS.format('text')} AS v FROM benchmark),
 s AS (SELECT q.query_id, c.id, c.parent_id, c.doc_id, c.pw, round({COSINE}, 6) AS score FROM c, q),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.5)
 SELECT query_id, rank, id, score, parent_id, CASE WHEN doc_id % 3 <> 0 THEN sha256(array_to_string(pw, ' ')) END AS parent_sha FROM t WHERE rank <= 4""")
def search_with_parents(spark, sf_dir):
    """Each benchmark item searches the children of all documents; the parents of every third document have been lost."""
    cut = lambda size, overlap: lambda text: C.word_windows(text, size, overlap)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = C.hierarchical(docs, parent_cut=cut(120, 20), child_cut=cut(30, 5)).where("chunk_type = 'child' OR doc_id % 3 != 0")
    stored = chunks.withColumn("embedding", _letters(F.col("text")))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), _letters(F.col("text")).alias("embedding"))
    found = R.search_with_parents(asked, stored, limit=4, threshold=0.5)
    return found.select("query_id", "rank", "id", "score", "parent_id", F.sha2("parent_context", 256).alias("parent_sha"))


@query(f"""{ANSWER} SELECT q.query_id, CASE WHEN p.n IS NULL THEN '죄송합니다. 검색 결과가 없습니다. 다른 질문을 시도해 주세요.' WHEN q.query_id % 300 = 0 THEN '죄송합니다. late 다른 질문을 시도해 주세요.' ELSE 'About ' || p.n END AS text,
 CASE WHEN p.n IS NULL OR q.query_id % 300 = 0 THEN '' ELSE c.cited END AS sources, p.n IS NULL OR q.query_id % 300 = 0 AS is_fallback FROM (SELECT DISTINCT query_id FROM t) q LEFT JOIN p ON p.query_id = q.query_id LEFT JOIN c ON c.query_id = q.query_id""")
def fallback_responses(spark, sf_dir):
    """Answers as responses: where nothing relevant was found, and where the call failed, with the reason."""
    hits = _hits(spark, sf_dir)
    questions = hits.select("query_id").distinct().withColumn("question", F.concat(F.lit("Question "), "query_id"))
    found = R.answers(questions, hits.where("rank <= 5"), lambda prompt, used: F.concat(F.lit("About "), F.size(used)), threshold=0.35)
    failed = F.when((F.col("query_id") % 300 == 0) & (F.col("n_documents") > 0), F.lit("late"))
    said = R.responses(found, failed)
    return said.select("query_id", F.col("response.text").alias("text"), F.array_join("response.sources", ",").alias("sources"), F.col("response.is_fallback").alias("is_fallback"))
