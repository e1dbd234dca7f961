"""The lexical index against the search that cuts all documents again."""

import random

from pyspark.sql import functions as F

from quillspark.operators.postings import Postings
from quillspark.operators.retrieval import search_terms


def test_index_and_scan_score_alike(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["a", "b", "C", "dd", "é", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(120)] + [(900, None), (901, " \t\n ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "A dd w3 w3"), (2, "nowhere"), (3, None), (4, "w1 w2 w3 w4 É c")], "query_id long, text string")
    index = Postings.build(frame, str(tmp_path / "index"))
    got, want = index.search(asked).collect(), search_terms(asked, frame.withColumn("text", F.coalesce("text", F.lit("")))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 100
    again = Postings(spark, str(tmp_path / "index")).search(asked.where("query_id = 2"))
    assert again.collect() == []


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert Postings.build(none, str(tmp_path / "none")).search(asked).collect() == []
    assert Postings.build(spark.createDataFrame([(1, None)], none.schema), str(tmp_path / "blank")).search(asked).collect() == []
