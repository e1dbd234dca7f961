"""The best documents of each query, kept inside tasks, against all scores listed and ranked."""

import random

from quillspark.operators import postings as P
from quillspark.operators import retrieval as R


def test_best_are_the_top_of_all_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "DOCUMENTS", 50)  # several parts
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["a", "b", "C", "dd", "é", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(200)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(900, None), (901, " \t\n ")]  # a group of copies
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "A dd w3 w3"), (2, "nowhere"), (3, None), (4, "w1 w2 w3 w4 É c"), (5, docs[3][1])], "query_id long, text string")
    index = P.Postings.build(frame, str(tmp_path / "index"))
    got, want = R.top_k(index.best(asked, 10), 10).collect(), R.top_k(index.search(asked), 10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 30
    assert "nowhere" not in str(got) and index.best(asked.where("query_id = 2"), 10).collect() == []


def test_the_lexical_query_lists_no_pair_of_a_query_and_a_document(spark):
    from quillspark.plans import search

    plan = search.bm25_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [query_id" not in plan.split("MapInArrow")[0]
