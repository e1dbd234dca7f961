"""Queries of near-duplicate vectors. Each vector has a drifted copy, some as they are, some beyond the threshold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import near_vectors as N
from ..registry import query, table

#: The copy of a vector is moved along a diagonal by a tenth of its id's last digit.
DRIFTED = "SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x, i: (x::DOUBLE + (vec_id % 10) * 0.0125 * (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END))::FLOAT) FROM embeddings"
PAIRS = f"""WITH v AS ({DRIFTED}), r AS (SELECT embedding::DOUBLE[] AS e, min(vec_id) AS id FROM v GROUP BY embedding)
 SELECT a, b, round(score, 6) AS score FROM (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS score FROM r x, r y WHERE x.id < y.id) WHERE score >= 0.95
 UNION ALL SELECT r.id, v.vec_id, 1.0 FROM v JOIN r ON v.embedding::DOUBLE[] = r.e WHERE v.vec_id <> r.id"""


def _drifted(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    step = (F.col("vec_id") % 10) * F.lit(0.0125)
    moved = F.transform("embedding", lambda x, i: (x.cast("double") + step * F.when(i % 2 == 0, 1).otherwise(-1)).cast("float"))
    return vectors.unionByName(vectors.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), moved.alias("embedding")))


@query(PAIRS)
def near_duplicate_vectors(spark, sf_dir):
    """By banded hyperplanes, a pair at the threshold missed once in a million."""
    return N.near_duplicates(_drifted(spark, sf_dir), miss=1e-6).select("a", "b", F.round("score", 6).alias("score"))


@query(PAIRS)
def near_duplicate_vectors_exact(spark, sf_dir):
    """By cells around pivots, none missed."""
    return N.near_duplicates(_drifted(spark, sf_dir), exact=True).select("a", "b", F.round("score", 6).alias("score"))
