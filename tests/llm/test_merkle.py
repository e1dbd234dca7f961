"""The Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle

from .helpers import DOCS, clashing, edge_rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def up(nodes):
    """Levels from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def walk(levels, i, h, siblings):
    for level in levels[:-1]:
        run, slot = level[i // 8 * 8 : i // 8 * 8 + 8], i % 8
        siblings += run[:slot] + run[slot + 1 :]
        h, i = sha(*run[:slot], h, *run[slot + 1 :]), i // 8
    return h


def brute(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = lambda t: sha(*map(framed, (doc_id, source, lang, n_chars, t)))  # noqa: B023, E731
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(text), leaf(lowered(text)) if changed else leaf(text), doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g]), up([x[2] for x in sorted(groups[g])])) for g in names}
    upper = up([trees[g][1][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        leaves, levels = trees[g]
        for i, (_, _, leaf, altered, doc_id) in enumerate(leaves):
            siblings = []
            folded = walk(upper, k, walk(levels, i, altered, siblings), siblings)
            out.append((doc_id, leaf, levels[-1][0], upper[-1][0], sha(*siblings), folded, folded == upper[-1][0]))
    return sorted(out, key=str)


def many(n_en, langs):
    rng = random.Random(4)
    sizes = {"en": n_en} | {f"l{i}": rng.randint(1, 20) for i in range(langs)} | {None: 3, "é": 1, "": 2}
    rows = [(None, "Text %d" % i, lang, "s", i) for lang, n in sizes.items() for i in range(n)]
    ids = rng.sample(range(-50, 10**6), len(rows))
    return [(i, *r[1:]) for i, r in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("rows", [edge_rows(), many(700, 12), many(1, 60), [(i, "A", "en", "s", 1) for i in range(65)], [(5, "Same", "en", "s", 4)] * 40], ids=["edges", "many", "groups", "overflow", "repeats"])
def test_manifest_equals_plain_python(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert sorted(map(tuple, merkle.verified(clashing(docs)).collect()), key=str) == brute(rows)


def test_of_nothing(spark):
    assert merkle.verified(spark.createDataFrame([], DOCS)).collect() == []


def test_a_change_of_any_field_is_seen(spark):
    docs = spark.createDataFrame(many(30, 2), DOCS)
    root = merkle.manifest(docs).first().root
    for c, v in (("text", F.concat("text", F.lit(" "))), ("source", F.lit(None).cast("string")), ("n_chars", F.col("n_chars") + 1)):
        assert merkle.manifest(docs.withColumn(c, F.when(F.col("lang") == "en", v).otherwise(F.col(c)))).first().root != root
