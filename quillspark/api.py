"""An index in a folder, as one calls it: bring it in step with documents, ask for its state, search its chunks.

The folder has tables of chunks and of the documents' hashes, each in parts by the hash of doc_id; a synchronisation
rewrites the parts of what changed and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunking, indexing, retrieval
from .operators.parted import PartedTable, mask_of, part_of, parts_in
from .sources.collections import drop

CHUNKS = "chunk_id string, doc_id long, chunk_index long, total_chunks long, text string, token_count long"
HASHES = "doc_id long, content_hash string"


def _tables(spark: SparkSession, index: str, more: str = "") -> tuple[PartedTable, PartedTable]:
    return PartedTable(spark, f"{index}/chunks", "doc_id", CHUNKS + (f", {more}" if more else "")), PartedTable(spark, f"{index}/hashes", "doc_id", HASHES)


def sync(
    spark: SparkSession, index: str, documents: DataFrame, parts: Callable[[Column], Column] | None = None,
    finish: Callable[[DataFrame], DataFrame] | None = None, more: str = "", on_done: Callable[[dict], None] | None = None,
) -> DataFrame:
    """(action, n): brings the index to ``documents`` (doc_id, text; ids once each) and says what it did.

    Documents that aren't there any more go with their chunks; only new and changed ones are cut, and of the index only
    the parts are rewritten in which something changed. ``finish`` makes what a chunk has besides, such as vectors and what a model says
    of it, in the columns ``more`` (a schema); it sees new chunks only. ``on_done`` gets the counters when all is written:
    the actions, ``chunks`` cut and ``errors``, rows with a null id, which are left out.

    What changed is worked out and written once, with its counts. Chunks are replaced first and hashes last: a run that
    breaks off between leaves documents that count as changed, so they are cut again, never lost or doubled.
    """
    chunks, hashes = _tables(spark, index, more)
    known = documents.where("doc_id is not null")
    run = f"{index}/changes/{uuid.uuid4().hex}"
    errors = documents.where("doc_id is null").select("doc_id").count()
    touched = mask_of(F.when(F.col("action") != "unchanged", part_of("doc_id"))).alias("touched")
    changed, did = indexing.written_changes(hashes.read().drop("part"), known, run, touched)
    where = parts_in(did.pop("touched"))
    todo = changed.where("action in ('created', 'updated')")
    made = chunking.chunk_documents(known.join(todo.select("doc_id"), "doc_id", "left_semi"), (parts or chunking.word_windows)(F.col("text")))
    made = made if finish is None else finish(made)
    counted = chunks.merge(changed, made, where, F.count_if("_new").alias("chunks"))
    hashes.merge(changed, todo.select("doc_id", "content_hash"), where)
    drop(spark, run)
    counters = {a: did[a] for a in indexing.ACTIONS} | {"chunks": counted.get("chunks", 0), "errors": errors}
    if on_done is not None:
        on_done(counters)
    return spark.createDataFrame([(a, counters[a]) for a in indexing.ACTIONS if counters[a]], "action string, n long")


def status(spark: SparkSession, index: str) -> DataFrame:
    """One row: documents, documents with chunks, chunks, tokens."""
    parts, hashes = _tables(spark, index)
    chunks = parts.read().agg(F.count_distinct("doc_id").alias("with_chunks"), F.count("*").alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    return hashes.read().agg(F.count("*").alias("documents")).crossJoin(chunks)  # a row each


def search(spark: SparkSession, index: str, questions: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, rank, chunk_id, doc_id, score): the best chunks of each question (query_id, text) by BM25."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    chunks = _tables(spark, index)[0].read()
    best = retrieval.top_k(retrieval.search_terms(questions, chunks.select(F.col("chunk_id").alias("doc_id"), "text")), limit)
    return best.join(chunks.select(F.col("chunk_id").alias("id"), "doc_id"), "id").select("query_id", "rank", F.col("id").alias("chunk_id"), "doc_id", "score")
