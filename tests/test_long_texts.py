"""Texts that are long: what is worked out once, and how many are held at a time."""

from pyspark.sql import functions as F

from quillspark.functions import model_json as M
from quillspark.operators import chunking as C
from quillspark.plans import sessions


def test_an_answer_is_made_and_read_once(spark):
    plan = sessions.model_metadata(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_blocks_of_answers(spark):
    said = ['```json {"a":1} ``` x', 'x ```{"b":1}``` ```json\n{"a":2}\n```', '```json {"a":3}', "```\nx", '{"a":4} ', "", None, "``` ```", '```json```json {"a":5}```']
    rows = spark.createDataFrame(list(enumerate(said)), "n int, answer string").select("n", M.fenced_json(F.col("answer")).alias("j"))
    assert [r.j for r in rows.orderBy("n").collect()] == ['{"a":1}', '\n{"a":2}\n', '{"a":3}', "\nx", '{"a":4}', "", None, "", ""]
    for text, topics in (('{"topics":["a","b","c","d","e","f"],"summary":"' + "s" * 600 + '"}', 5), ("no", 0), (None, 0)):
        got = spark.createDataFrame([(text,)], "answer string").select(M.metadata(F.col("answer")).alias("m")).first().m
        assert got.content_type == "general" and len(got.topics) == topics and len(got.summary) == (500 if topics else 0)


def test_chunkers_take_few_texts_at_a_time(spark):
    docs = spark.createDataFrame([(1, "One. " * 700), (2, None), (3, " ")], "doc_id long, text string")
    for rows in (C.chunk_documents(docs, C.recursive_chunks()(F.col("text"))), C.hierarchical(docs)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
        assert {r.doc_id for r in rows.collect()} == {1}
