"""Ranked lexical search against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from quillspark.llm import lexical

from .helpers import DOCS, clashing, edge_rows, prose

ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=10):
    counts = [(d[0], Counter(terms(d[1]))) for d in docs]
    n_docs, n_words = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, of in wanted.items():
        scored = []
        for doc_id, c in counts:
            score = 0
            for t in of & c.keys():
                df = sum(t in x for _, x in counts)
                norm = 100 - 90 + 90 * sum(c.values()) * n_docs // n_words
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * norm))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item, k, doc_id, -score) for k, (score, _, doc_id) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    known = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 5))) for _ in range(120)] + ["ab", "a", "Bb", "don", "t", "é", "naïve", "x1"]
    docs = [(i, prose(rng, rng.randint(0, 90), known).replace(" ", rng.choice([" ", "  ", ", ", "-", "\n", "'"])), "en", "s", 1) for i in range(150)]
    docs += [(200 + i, docs[3][1], "en", "s", 1) for i in range(30)]  # ties
    items = [(i, prose(rng, rng.randint(1, 25), known)) for i in range(20)] + [(3, "a naïve don't"), (None, "x1"), (None, "ab é"), (40, None), (41, " ., "), (42, "zzzzzz")]
    return docs + edge_rows(), items


@pytest.mark.parametrize("limit", [lexical.TERM_BYTES, 300])
def test_search_equals_plain_python(spark, limit):
    docs, items = corpus()
    got = lexical.search(clashing(spark.createDataFrame(docs, DOCS)).repartition(3), spark.createDataFrame(items, ITEMS), limit=limit)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_of_nothing(spark):
    docs, items = corpus()
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.search(none, spark.createDataFrame(items, ITEMS)).collect() == []
    assert lexical.search(spark.createDataFrame(docs, DOCS), no_items).collect() == []


def test_a_long_text_is_read_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    rng = random.Random(2)
    text = prose(rng, 4000, ["a", "ab", "abc", "b", "c", "abcabcabcabc"])
    automaton = lexical.TermAutomaton.build([(0, "a"), (0, "abc"), (1, "a"), (1, "abcabcabcabc")])
    n, found, tf = automaton.count(text)
    want = Counter(terms(text))
    assert n == 4000 and dict(zip(found.tolist(), tf.tolist(), strict=True)) == {0: want["a"], 1: want["abc"], 2: want["abcabcabcabc"]}
