"""The best of each query kept inside tasks, against all scores listed and ranked."""

import random

import pytest

from quillspark.operators import best as B
from quillspark.operators import retrieval as R
from quillspark.plans import quality, search

VECTORS = "vec_id long, embedding array<float>, tag string"


@pytest.mark.parametrize("threshold", [None, 0.2])
def test_nearest_is_the_top_of_all_similarities(spark, monkeypatch, threshold):
    monkeypatch.setattr(B, "BLOCK", 3)
    monkeypatch.setattr(B, "HELD", 10)
    rng = random.Random(4)
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(60)]
    rows = [(i, vectors[i % 40] if i % 5 else vectors[0], f"t{i}") for i in range(200)]  # large groups of copies
    rows += [(300, None, "null"), (301, [0.0] * 6, "zero"), (302, [1e-30] * 6, "small"), (303, [3e38] * 6, "large")]
    corpus = spark.createDataFrame(rows, VECTORS)
    asked = corpus.where("vec_id % 8 = 0 or vec_id >= 300")
    want = {tuple(r) for r in R.top_k(R.similarities(asked, corpus), 7, threshold).collect()}
    got = R.nearest(asked, corpus, 7, threshold, more=("tag",)).collect()
    assert {(r.query_id, r.id, r.score, r["rank"]) for r in got} == want and len(got) == len(want)
    assert all(r.tag == dict((i, t) for i, _, t in rows)[r.id] for r in got)
    others = R.top_k(R.similarities(asked, corpus).where("id <> query_id"), 7)
    assert {tuple(r) for r in R.nearest(asked, corpus, 7, itself=False).collect()} == {tuple(r) for r in others.collect()}


def test_null_components_come_last_and_nothing_gives_nothing(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [None, 1.0], "b"), (3, [0.0, 1.0], "c"), (4, [1.0, 0.0, 0.0], "d")], VECTORS)
    got = [(r.id, r.score) for r in R.nearest(corpus.where("vec_id = 1"), corpus, 4).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, 0.0), (2, None), (4, None)]
    assert R.nearest(corpus.where("vec_id = 0"), corpus, 4).count() == R.nearest(corpus, corpus.where("vec_id = 0"), 4).count() == 0


def test_no_query_of_the_search_joins_each_row_with_each_query(spark):
    for f in (search.vector_topk, search.relevant_results, quality.mrr):
        plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
