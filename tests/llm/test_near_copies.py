"""The pipeline's near_dedup stage against brute force over all pairs."""

import random
import re

import corpus_pipeline
from quillspark.llm import near_copies
from quillspark.llm.rows import ROW

from .helpers import DOCS, clashing, components_of, edge_rows, prose

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    near = lambda a, b: len(a & b) >= similarity * len(a | b)
    return components_of(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])])


def edited(rng, text, share):
    return " ".join(rng.choice("abcdefgh") * 9 if rng.random() < share else w for w in text.split(" "))


def planted():
    """Copies with edits on either side of a similarity of 0.8, far beyond four bits of a fingerprint."""
    rng = random.Random(5)
    found = []
    for _ in range(40):
        text = prose(rng, rng.choice((60, 200, 500)))
        found += [text, *(edited(rng, text, share) for share in (0.005, 0.015, 0.02, 0.025, 0.04))]
    return found


def test_stage_matches_brute_force(spark):
    texts = planted()
    data = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    comp = brute(texts)
    assert len(texts) // 4 < len(set(comp)) < 3 * len(texts) // 4
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, clashing(data), SF).collect()) == sorted(set(comp))


def test_stage_on_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = sorted((r.doc_id, r.text) for r in docs.collect())
    comp = brute([t for _, t in data])
    assert sorted(r.doc_id for r in near_copies.keep_first(docs).collect()) == sorted(data[c][0] for c in set(comp))


def test_links_in_split_bands(spark):
    """A band of texts apart, none of which leads the others: all pairs are compared, in parts or not."""
    rng = random.Random(1)
    sets = [set(rng.sample(range(10**6), 50)) for _ in range(30)]
    sets += [set(list(s)[:46]) | {-k} for k, s in enumerate(sets, 1)]
    want = components_of(60, [(i, i - 30) for i in range(30, 60)])
    bands = spark.createDataFrame([(7, i) for i in range(60)], "band long, unit long")
    held = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "unit long, shingles array<long>")
    for part in (near_copies.PART, 9):
        got = dict(map(tuple, near_copies.links(bands, held, part=part).collect()))
        assert [got.get(i, i) for i in range(60)] == want


def test_null_and_repeated_ids_lose_no_text(spark):
    """One row of each component stays, whatever its id."""
    data = edge_rows() + [(None, prose(random.Random(k), 40), "en", "s", 1) for k in range(4)]
    docs = spark.createDataFrame(data, DOCS)
    comp = brute([r[1] for r in data])
    got = near_copies.keep_first(docs).collect()
    places = [next(i for i, d in enumerate(data) if d[:2] == (r.doc_id, r.text)) for r in got]
    assert sorted(comp[i] for i in places) == sorted(set(comp))
    assert near_copies.near_copies(docs).select(ROW).count() == len(data)
    assert (5, data[4][1]) in [(r.doc_id, r.text) for r in got]


def test_empty(spark):
    assert near_copies.keep_first(spark.createDataFrame([], DOCS)).count() == 0


def test_no_pair_is_left_to_chance(spark):
    """Pairs of a similarity of 0.8 that share none of the 20 MinHash bands the stage once had."""
    pairs = [43772, 151615, 176558, 181188, 195492]
    texts = [" ".join(f"w{i}x{k}" for k in range(12)) + end for i in pairs for end in (" a", " b")]
    data = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, data, SF).collect()) == list(range(0, 10, 2)) == sorted(set(brute(texts)))


def test_pairs_are_compared_in_lists_or_in_cells(spark):
    rng = random.Random(2)
    sets = [set(rng.sample(range(10**6), 50)) for _ in range(30)]
    sets += [set(list(s)[:46]) | {-k} for k, s in enumerate(sets, 1)]
    bands = spark.createDataFrame([(7, i) for i in range(60)] + [(8, 3), (8, 33)], "band long, unit long")
    held = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "unit long, shingles array<long>")
    want = components_of(60, [(i, i - 30) for i in range(30, 60)])
    for part, listed in ((9, 4), (9, 64), (2_000, 1)):
        got = dict(map(tuple, near_copies.links(bands, held, part=part, listed=listed).collect()))
        assert [got.get(i, i) for i in range(60)] == want
