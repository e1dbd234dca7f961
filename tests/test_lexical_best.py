"""BM25 straight from the texts against the search that lists all scores, and against the SQL of the query."""

import random

from pyspark.sql import functions as F

from quillspark.operators import lexical as L
from quillspark.operators import retrieval as R
from quillspark.plans import search


def _texts(rng, n):
    return [" ".join(rng.choice(["a", "b", "C", "dd", "é", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(30))) for _ in range(n)]


SMALL = L.Sizes(documents=50, words=300, asked=12, block=2, dense=3, summed=20)  # all kinds of parts


def test_best_are_the_top_of_all_scores(spark):
    rng = random.Random(6)
    docs = list(enumerate(_texts(rng, 200)))
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(900, None), (901, " \t\n ")]  # a group of copies
    frame = spark.createDataFrame(docs, "id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "A dd w3 w3"), (2, "nowhere"), (3, None), (4, "w1 w2 w3 w4 É c"), (5, docs[3][1])], "query_id long, text string")
    got = R.top_k(L.best(frame, asked, 10, sizes=SMALL), 10).collect()
    want = R.top_k(R.search_terms(asked, frame.select(F.col("id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))), 10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 30
    assert L.best(frame, asked.where("query_id = 2"), 10).collect() == [] == L.best(frame, asked.limit(0), 10).collect() == L.best(frame.limit(0), asked, 10).collect()


def test_repeated_ids_score_as_in_sql(spark, tmp_path, monkeypatch):
    import duckdb

    monkeypatch.setattr(L.best, "__defaults__", (*L.best.__defaults__[:-1], SMALL))
    rng = random.Random(7)
    docs = list(enumerate(_texts(rng, 300)))
    docs += [(i, docs[i][1]) for i in range(0, 60, 3)] + [(i, "dd w1 w2 " + docs[i + 1][1]) for i in range(0, 300, 20)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"{search.BM25} SELECT query_id, id, score, rank FROM lr").fetchall()
    got = [tuple(r) for r in search.bm25_topk(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 30


def test_no_posting_is_shuffled_or_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(search, "shared_folder", lambda *_: written.append(_) or 1 / 0)
    for name in ("bm25_topk", "rrf_hybrid"):
        plan = getattr(search, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        lexical = [p for p in plan.split("MapInArrow")[1:] if "text#" in p]
        assert lexical and all("RepartitionByExpression" not in p and "Aggregate" not in p and "term#" not in p for p in lexical), plan
    assert not written
