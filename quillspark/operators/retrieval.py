"""Filtered vector search, lexical search, rank fusion, context budget, citations and prompts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T
from ..functions import vectors as V
from . import best

#: Query vectors in a block; a row of the corpus meets one block at a time.
BLOCK = 256


def where_equal(df: DataFrame, conditions: dict | None) -> DataFrame:
    """AND of equalities; a falsy value is no condition, so a store's scan gets them as pushed filters."""
    used = [F.col(k) == F.lit(v) for k, v in (conditions or {}).items() if v]
    return df.where(reduce(lambda a, b: a & b, used)) if used else df


def similarities(queries: DataFrame, corpus: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, score rounded to 6): each row of the corpus with each row of ``queries``, which has the same columns.

    The stated queries are gathered into blocks of about BLOCK vectors. Spark sends the blocks to every task while it knows them to
    be small, and pairs partitions of both sides beyond that. Null vectors take no part; a zero vector scores 0.
    """
    blocks_needed = max(1, -(-queries.count() // BLOCK))
    vector = F.col(vec_col).cast("array<double>")
    asked = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), vector.alias("v"), V.norm(F.col(vec_col)).alias("size"))
    dealt = asked.withColumn("nth", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks_needed)))  # alike when a task runs again
    blocks = dealt.groupBy("nth").agg(F.collect_list(F.struct("query_id", "v", "size")).alias("block")).select("block")
    rows = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), vector.alias("vec"), V.norm(F.col(vec_col)).alias("size"))
    pairs = rows.crossJoin(blocks).select("id", "vec", "size", F.explode("block").alias("q"))
    score = V.cosine(F.col("vec"), F.col("q.v"), F.col("size") * F.col("q.size"))
    return pairs.select("q.query_id", "id", F.round(score, 6).alias("score"))


def top_k(scored: DataFrame, k: int = DEFAULTS.top_k, threshold: float | None = None) -> DataFrame:
    """The k best of each query, the threshold before the limit; ties to the smaller id. Spark limits before the shuffle."""
    kept = scored if threshold is None else scored.where(F.col("score") >= threshold)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = DEFAULTS.top_k, threshold: float | None = None, more: tuple[str, ...] = (), itself: bool = True) -> DataFrame:
    """``top_k`` of the ``similarities``, of which only the best of each task leave it; ``more`` columns of the corpus come along.

    Without ``itself`` a row isn't found by the query of its own id.
    """
    return top_k(best.nearest(queries, corpus, k, threshold, more=more, itself=itself), k)


def context_budget(results: DataFrame, max_tokens: int = DEFAULTS.context_tokens, chars_per_token: int = DEFAULTS.chars_per_token) -> DataFrame:
    """The best results (query_id, id, score, content, title) whose running cost stays in the budget.

    Costs are positive, so stopping at the first overflow is a bound on the running sum.
    """
    cost = F.length("content") + F.length("title") + 50
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id").rowsBetween(W.unboundedPreceding, 0)
    return results.withColumn("used", F.sum(cost).over(order)).where(F.col("used") <= max_tokens * chars_per_token)


def first_per_source(results: DataFrame, source: str = "source") -> DataFrame:
    """Citations: the best-ranked result of each source."""
    order = W.partitionBy("query_id", source).orderBy("rank", "id")
    return results.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


SOURCE_LABELS = {"notion": "Notion 문서", "swagger": "API 스펙"}


def source_label(source_type: Column) -> Column:
    return reduce(lambda c, kv: c.when(source_type == kv[0], kv[1]), SOURCE_LABELS.items(), F.when(F.lit(False), "")).otherwise(source_type)


def rag_prompts(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, prompt): numbered documents in rank order, then the question (query_id, question)."""
    part = F.concat(F.lit("### ["), F.col("rank"), F.lit("] "), F.col("title"), F.lit(" ("), source_label(F.col("source")), F.lit(")\n유사도: "), F.format_string("%.2f", "score"), F.lit("\n\n"), F.col("content"), F.lit("\n"))
    parts = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    documents = F.array_join(F.transform("parts", lambda x: x["part"]), "\n")
    joined = questions.join(parts, "query_id", "left")
    return joined.select("query_id", F.concat(F.lit("## 참고 문서\n"), F.coalesce(documents, F.lit("벡터DB에서 검색된 관련 문서가 없습니다.\n")), F.lit("\n## 질문\n"), F.col("question")).alias("prompt"))


def parent_context(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Child hits with the text of their parents, null where there is none: one join instead of a look-up per hit."""
    return hits.join(parents.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text")), "parent_id", "left")


# What stands around documents and question, and what is asked for.
DOCUMENT_PROMPT = ("<documents>\n", "\n</documents>\n\n<question>\n", "\n</question>\n\nBased on the documents provided above, answer the question. Include citations to specific documents.")


def document_prompts(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, prompt): documents with number and title in tags, in rank order, then the question (query_id, question); none where none was found."""
    one = lambda d, i: F.concat(F.lit('<document id="'), (i + 1).cast("string"), F.lit('" title="'), d["title"], F.lit('">\n'), d["content"], F.lit("\n</document>"))
    parts = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "content"))).alias("found"))
    documents = F.coalesce(F.array_join(F.transform("found", one), "\n\n"), F.lit(""))
    before, between, after = map(F.lit, DOCUMENT_PROMPT)
    return questions.join(parts, "query_id", "left").select("query_id", F.concat(before, documents, between, "question", after).alias("prompt"))


# Prompts with nothing found, and the end of one that follows an answer; the reply where no answer came.
NOTHING_FOUND = ("관련 문서를 찾을 수 없습니다.\n\n## 질문\n", "\n\n위 질문에 대해 관련 문서를 찾을 수 없다고 안내하고,\n질문을 다시 구체화하거나 다른 키워드로 질문해달라고 요청하세요.")
FOLLOWUP = "\n\n이전 답변을 참고하여 후속 질문에 답변해주세요."
NO_ANSWER = "관련 문서를 찾을 수 없습니다. 다른 키워드로 질문해 주세요."


def no_context_prompt(question: Column) -> Column:
    return F.concat(F.lit(NOTHING_FOUND[0]), question, F.lit(NOTHING_FOUND[1]))


def followup_prompts(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, prompt) of (query_id, question, previous): the answer before, new documents in rank order, the question."""
    part = F.concat(F.lit("### ["), F.col("rank"), F.lit("] "), F.col("title"), F.lit(" ("), source_label(F.col("source")), F.lit(")\n"), F.col("content"), F.lit("\n\n"))
    parts = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    documents = F.concat(F.lit("## 추가 참고 문서\n"), F.array_join(F.transform("parts", lambda x: x["part"]), ""))
    joined = questions.join(parts, "query_id", "left")
    return joined.select("query_id", F.concat(F.lit("## 이전 답변\n"), F.col("previous"), F.lit("\n\n"), F.coalesce(documents, F.lit("")), F.lit("## 후속 질문\n"), F.col("question"), F.lit(FOLLOWUP)).alias("prompt"))


def answers(questions: DataFrame, results: DataFrame, answer: Callable[[Column, Column], Column], threshold: float = DEFAULTS.relevant, max_tokens: int = DEFAULTS.context_tokens) -> DataFrame:
    """(query_id, n_documents, cited, answer): relevant results within the budget, the prompt, an answer, its sources.

    ``answer`` makes a Column from the prompt and the results that it is of, an injected model; a blank one becomes the
    fixed reply, as does a question for which nothing relevant was found. Results are a few rows per question.
    """
    kept = context_budget(results.where(F.col("score") >= threshold), max_tokens)
    told = rag_prompts(questions, kept).join(kept.groupBy("query_id").agg(F.collect_list(F.struct("rank", "title", "source", "content")).alias("used"), F.array_sort(F.collect_set("source")).alias("cited")), "query_id", "left")
    said = F.when(F.col("used").isNotNull(), F.nullif(F.trim(answer(F.col("prompt"), F.col("used"))), F.lit("")))
    return told.select("query_id", F.size(F.coalesce("used", F.array())).cast("long").alias("n_documents"), "cited", F.coalesce(said, F.lit(NO_ANSWER)).alias("answer"))


def search_terms(asked: DataFrame, docs: DataFrame, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> DataFrame:
    """(query_id, id, score): BM25 of every query (query_id, text) by its distinct words against all documents that hold one.

    The words of documents are counted once and meet the queries' words in one join; document frequencies come from the
    same counts. Spark broadcasts the queries' words only where they are few.
    """
    words = docs.select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    terms = asked.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    stats = words.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))  # one row
    counted = words.select("id", "dl", F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    weighed = counted.groupBy("term").agg(F.count("*").alias("df")).join(terms, "term")
    n, df, tf = F.col("n"), F.col("df"), F.col("tf")
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1.0)
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return counted.join(weighed, "term").join(F.broadcast(stats)).groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def fuse(lists: list[DataFrame], k: int, constant: int = DEFAULTS.rrf_constant) -> DataFrame:
    """(query_id, id, score, rank): ranked lists of every query fused by the sum of 1 / (constant + rank)."""
    every = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank") for x in lists])
    return top_k(every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 6).alias("score")), k)


@dataclass(frozen=True)
class SearchFilter:
    """Equalities that a search may ask for; an empty one is none."""

    source_id: str | None = None
    source_type: str | None = None
    language: str | None = None
    content_type: str | None = None
    http_method: str | None = None
    chunk_type: str | None = None


def search(queries: DataFrame, corpus: DataFrame, wanted: SearchFilter | None = None, limit: int = DEFAULTS.top_k, threshold: float = 0.0, more: tuple[str, ...] = ()) -> DataFrame:
    """The ``limit`` best of each query of at least ``threshold``, among the rows that fit the filter; ``more`` columns come along."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")
    return nearest(queries, where_equal(corpus, asdict(wanted or SearchFilter())), limit, threshold, more)


def search_with_parents(queries: DataFrame, chunks: DataFrame, wanted: SearchFilter | None = None, limit: int = DEFAULTS.top_k, threshold: float = 0.0) -> DataFrame:
    """(query_id, rank, id, score, parent_id, parent_context): the best children for each query, with the text of their parents.

    ``chunks`` are parents and children in one table (chunk_id, chunk_type, parent_id, text, embedding and what the
    filter asks for). Only children are searched, as small texts match more exactly; the parent gives the answer its context. A
    child whose parent isn't there has none, and stays. Texts are joined to the few rows that were found.
    """
    children = chunks.where("chunk_type = 'child'")
    found = search(queries, children.withColumnRenamed("chunk_id", "vec_id"), wanted, limit, threshold, ("parent_id",))
    parents = chunks.where("chunk_type = 'parent'").select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_context"))
    return found.join(parents, "parent_id", "left").select("query_id", "rank", "id", "score", "parent_id", "parent_context")


# What is said where nothing was found or something failed.
NOTHING = "검색 결과가 없습니다."


def fallback(reason: Column | None = None) -> Column:
    """struct<text, sources, is_fallback>: the answer that stands in for one, with the reason for it."""
    why = F.lit(NOTHING) if reason is None else F.coalesce(reason, F.lit(NOTHING))
    return F.struct(F.concat(F.lit("죄송합니다. "), why, F.lit(" 다른 질문을 시도해 주세요.")).alias("text"), F.array().cast("array<string>").alias("sources"), F.lit(True).alias("is_fallback"))


def responses(found: DataFrame, failed: Column | None = None) -> DataFrame:
    """``found`` (query_id, n_documents, cited, answer) as (query_id, response), a fallback where no document was relevant or ``failed`` says why."""
    said = F.struct(F.col("answer").alias("text"), F.coalesce("cited", F.array().cast("array<string>")).alias("sources"), F.lit(False).alias("is_fallback"))
    bad = F.col("n_documents") == 0 if failed is None else (F.col("n_documents") == 0) | failed.isNotNull()
    return found.select("query_id", F.when(bad, fallback(failed)).otherwise(said).alias("response"))
