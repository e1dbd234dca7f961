"""Removal of near-duplicates by fingerprints where ids are null or repeat."""

import random

from quillspark.llm import simhash

from .helpers import DOCS, clashing, edge_rows, prose
from .test_operators import brute_fingerprint, components_of


def test_null_and_repeated_ids_lose_no_component(spark):
    """One row of each component stays; the smallest id is not lost to another text of the same id."""
    data = edge_rows() + [(i, prose(random.Random(k), 60), "en", "s", 1) for k, i in enumerate((None, None, None, 9, 9, 9))]
    docs = spark.createDataFrame(data, DOCS)
    fps = [brute_fingerprint(r[1]) for r in data]
    comp = components_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS])
    least = {}
    for (d, *_), c in zip(data, comp, strict=True):
        least.setdefault(c, set()).add((d is None, d or 0))
    for frame in (docs, clashing(docs)):
        got = simhash.keep_first(frame).collect()
        kept = [(comp[next(i for i, x in enumerate(data) if x[:2] == (r.doc_id, r.text))], r.doc_id) for r in got]
        assert sorted(c for c, _ in kept) == sorted(set(comp))
        assert all((d is None, d or 0) == min(least[c]) for c, d in kept)
