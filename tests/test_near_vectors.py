"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from quillspark.operators import near_vectors as N


def all_pairs(rows, threshold):
    first = {}
    for i, v in sorted((i, v) for i, v in rows if i is not None and v is not None and any(v)):
        first.setdefault(tuple(v), i)
    star = {(first[tuple(v)], i) for i, v in rows if i is not None and v is not None and any(v) and first[tuple(v)] != i}
    ids = np.array(sorted(first.values()))
    x = np.array([next(v for v, i in first.items() if i == k) for k in ids])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    return star | set(zip(ids[a].tolist(), ids[b].tolist(), strict=True))


def clustered(n, dim, clusters, spread, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, dim))
    return [(int(i), [float(c) for c in v * rng.uniform(0.5, 3)]) for i, v in enumerate(x)]


@pytest.mark.parametrize("exact", [True, False])
def test_pairs_of_clusters(spark, exact):
    rows = clustered(700, 16, 25, 0.16)
    rows += [(1000 + i, v) for i, v in rows[:40]] + [(3000 + i, rows[0][1]) for i in range(60)] + [(0, rows[0][1]), (5000, None), (None, rows[1][1]), (5001, [0.0] * 16)]
    want = all_pairs(rows, 0.95)
    found = N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, exact, miss=1e-7).collect()
    got = [(r.a, r.b) for r in found]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 3000
    assert all(r.score >= 0.95 and r.a < r.b for r in found)


@pytest.mark.parametrize("exact", [True, False])
def test_a_dense_cell_is_cut_into_parts(spark, monkeypatch, exact):
    monkeypatch.setattr(N, "PART", 16)
    rows = clustered(150, 8, 2, 0.05)
    got = N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9, exact, miss=1e-7).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(all_pairs(rows, 0.9))


def test_recall_of_bands_is_as_stated(spark):
    """Pairs planted at the threshold itself: as many are found as the bands promise."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal((1500, 64))
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = 0.9501
    y = c * x + math.sqrt(1 - c * c) * z
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = {(r.a, r.b) for r in N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, miss=0.05).collect()}
    recall = np.mean([(i, 1500 + i) in got for i in range(1500)])
    print(f"recall {recall:.4f}")
    assert 0.93 < recall < 0.98


def test_of_little(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert N.near_duplicates(none).collect() == [] == N.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0])], none.schema), exact=True).collect()
    with pytest.raises(ValueError):
        N.near_duplicates(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], none.schema))


def test_a_vector_is_not_copied_for_each_band_or_cell(spark):
    """Bands carry sketches; a vector without structure around it is a guest of blocks, not of each of the cells."""
    rows = spark.createDataFrame(clustered(3000, 16, 3000, 1.0), "vec_id long, embedding array<double>").select("vec_id", "embedding")
    single = rows.select(rows.vec_id.alias("id"), rows.embedding.alias("vec"))
    assert "vec" not in N._buckets(N._banded(single, 16, 20, 12, 7)).columns
    pivots = np.array([r.vec for r in single.limit(54).collect()])
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]
    first, count = N._blocks(single, pivots, N.TILE)
    blocks = int((first + count).max())
    assert blocks < 10 and N._celled(single, pivots, 0.3, first, count).count() <= 3000 * blocks
