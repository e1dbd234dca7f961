"""Blocks of queries against all rows, and the diff of snapshots with null digests."""

import random

import pytest

from quillspark.operators import retrieval as R
from quillspark.operators import tables as B

VECTORS = "vec_id long, embedding array<float>"


def test_similarities_meet_every_query_of_every_block(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60, None), (61, [0.0] * 5)]
    corpus = spark.createDataFrame(rows, VECTORS)
    got = {(r.query_id, r.id): r.score for r in R.similarities(corpus.where("vec_id % 2 = 0"), corpus).collect()}
    plain = {i: v for i, v in rows if v}
    assert set(got) == {(q, i) for q in plain if q % 2 == 0 for i in plain}
    size = {i: sum(x * x for x in v) ** 0.5 for i, v in plain.items()}
    for (q, i), score in got.items():
        dot = sum(x * y for x, y in zip(plain[q], plain[i], strict=True))
        assert score == pytest.approx(dot / (size[q] * size[i]) if size[q] * size[i] else 0.0, abs=2e-6)


def test_similarities_without_queries_or_rows(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0])], VECTORS)
    assert R.similarities(corpus.where("vec_id = 0"), corpus).count() == 0
    assert R.similarities(corpus, corpus.where("vec_id = 0")).count() == 0


def test_diff_tells_null_digests_from_missing_rows(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "b"), (5, "c")], "id int, h string")
    new = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "b"), (6, None)], "id int, h string")
    got = {r.id: r.action for r in B.diff(old, new, "id", "h").collect()}
    assert got == {1: "unchanged", 2: "updated", 3: "updated", 4: "unchanged", 5: "deleted", 6: "created"}
