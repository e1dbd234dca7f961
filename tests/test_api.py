"""An index in a folder over three states of its documents, against the documents cut afresh."""

import shutil

import pytest
from pyspark.sql import functions as F

from quillspark import api
from quillspark.operators import chunking, indexing
from quillspark.operators.parted import part_of

SF = "/root/testdata/sf0.001"


def test_index_follows_its_documents(spark, tmp_path):
    docs, index = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), f"file://{tmp_path}/index"
    assert api.status(spark, index).collect()[0].documents == 0
    fewer = docs.where("doc_id % 5 != 0")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    for state, want in ((fewer, {"created": fewer.count()}), (changed, None), (changed, {"unchanged": docs.count()}), (docs.limit(0), {"deleted": docs.count()})):
        did = {r.action: r.n for r in api.sync(spark, index, state).collect()}
        assert sum(did.values()) >= state.count() and (want is None or did == want)
        fresh = chunking.chunk_documents(state, chunking.word_windows(F.col("text")))
        now = api.status(spark, index).collect()[0]
        assert (now.documents, now.chunks, now.tokens) == (state.count(), fresh.count(), fresh.agg(F.coalesce(F.sum("token_count"), F.lit(0))).first()[0])


def files(folder):
    return {str(f.relative_to(folder)) for f in folder.glob("part=*/*.parquet")}


def test_a_run_that_was_cut_off_loses_and_doubles_nothing(spark, tmp_path):
    """Chunks were written, some hashes weren't."""
    docs, index = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), f"file://{tmp_path}/index"
    api.sync(spark, index, docs)
    chunks = api.status(spark, index).collect()[0].chunks
    gone = sorted((tmp_path / "index" / "hashes").glob("part=*"))[:5]
    for part in gone:
        shutil.rmtree(part)
    did = {r.action: r.n for r in api.sync(spark, index, docs).collect()}
    assert did["created"] and did["created"] + did["unchanged"] == docs.count()
    assert api.status(spark, index).collect()[0].chunks == chunks


def test_a_small_change_rewrites_its_parts_alone(spark, tmp_path):
    docs, index = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), f"file://{tmp_path}/index"
    api.sync(spark, index, docs)
    before = files(tmp_path / "index" / "chunks")
    ten = F.col("doc_id").between(20, 29)
    api.sync(spark, index, docs.withColumn("text", F.when(ten, F.lit("quite new")).otherwise(F.col("text"))))
    after = files(tmp_path / "index" / "chunks")
    parts = {f"part={r[0]}" for r in docs.where(ten).select(part_of("doc_id")).collect()}
    assert {f.split("/")[0] for f in before ^ after} == parts and len(parts) <= 10
    assert not list((tmp_path / "index" / "changes").glob("*"))
    again = files(tmp_path / "index" / "chunks")
    api.sync(spark, index, docs.withColumn("text", F.when(ten, F.lit("quite new")).otherwise(F.col("text"))))
    assert files(tmp_path / "index" / "chunks") == again


def test_new_chunks_are_finished_and_counted(spark, tmp_path):
    index, told, embedded = f"file://{tmp_path}/index", [], "vector array<double>, topic string"
    docs = spark.createDataFrame([(1, "one " * 600), (2, "two"), (None, "none"), (3, None)], "doc_id long, text string")
    load = lambda: lambda texts: [[float(len(t))] for t in texts]
    finish = lambda rows: indexing.embedded(rows, load, into="vector").withColumn("topic", F.substring("text", 1, 3))
    api.sync(spark, index, docs, finish=finish, more=embedded, on_done=told.append)
    assert told == [{"created": 3, "updated": 0, "unchanged": 0, "deleted": 0, "chunks": 3, "errors": 1}]
    # the chunks that stay are not finished again
    later = docs.where("doc_id is not null").withColumn("text", F.when(F.col("doc_id") == 2, F.lit("three four")).otherwise(F.col("text")))
    none = lambda rows: rows.withColumns({"vector": F.lit(None).cast("array<double>"), "topic": F.lit("again")})
    api.sync(spark, index, later, finish=none, more=embedded, on_done=told.append)
    assert told[1] == {"created": 0, "updated": 1, "unchanged": 2, "deleted": 0, "chunks": 1, "errors": 0}
    rows = api._tables(spark, index, embedded)[0].read().collect()
    assert sorted((r.doc_id, r.topic, r.vector is None) for r in rows) == [(1, "one", False), (1, "one", False), (2, "again", True)]


def test_search_finds_a_documents_own_chunk(spark, tmp_path):
    index = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(i, f"common words and number{i} " * 3) for i in range(20)], "doc_id long, text string")
    api.sync(spark, index, docs)
    asked = spark.createDataFrame([(q, f"where is number{q}") for q in (3, 11)], "query_id long, text string")
    assert {(r.query_id, r.doc_id) for r in api.search(spark, index, asked, limit=1).collect()} == {(3, 3), (11, 11)}
    with pytest.raises(ValueError, match="limit"):
        api.search(spark, index, asked, limit=0)
