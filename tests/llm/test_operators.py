import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import chat, cotraining, decontaminate, licenses, mixing, paragraphs, prefix_forest, pseudo_likelihood, queries, scratch, simhash, token_shards
from quillspark.llm.components import components
from quillspark.llm.scratch import settle
from quillspark.llm.words import hashed_words

from .helpers import DOCS, clashing, components_of, edge_rows, prose

SF = "/root/testdata/sf0.001"
ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


# components


def test_components_match_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 420)] + [(7, 7)]
    got = dict(rows(components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"))))
    want = components_of(421, pairs)
    met = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in met}
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


# op 1


def test_cotraining_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = labels.withColumn("held", F.col("doc_id") % 3 == 0)
    model = cotraining.train(settle(cotraining.views(docs), "views"), known.where("not held"))
    got = cotraining.score(docs, model).join(known.where("held").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id").select("keep", "quality").collect()
    good, bad = [r.keep for r in got if r.quality == 1], [not r.keep for r in got if r.quality == 0]
    assert np.mean(good) >= 0.95 and np.mean(bad) >= 0.8


def test_cotraining_exchanges_labels():
    """The metadata view learns from the text view's pseudo-labels: what they add up to comes in parts."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 900).astype(float)
    text = np.stack([y * 4 + rng.normal(0, 0.5, 900), rng.normal(0, 1, 900)], axis=1)
    meta = np.stack([y + rng.normal(0, 0.4, 900), rng.normal(0, 1, 900)], axis=1)
    parts = np.array_split(np.arange(120, 500), 7)
    model = cotraining.CoTrained.fit(text[:120], meta[:120], y[:120], lambda f: sum(f(text[p], meta[p]) for p in parts))
    alone = cotraining.CoTrained.fit(text[:120], meta[:120], y[:120], lambda f: f(text[:0], meta[:0]))
    assert np.abs(model.meta.model.weights - alone.meta.model.weights).max() > 0.05
    _, own, both = model.scores(text[500:], meta[500:])
    assert np.mean((own > 0.5) == (y[500:] == 1)) > 0.85
    assert np.mean((both > 0.5) == (y[500:] == 1)) > 0.98


def test_cotraining_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (4, None, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert cotraining.classify(edges, labels).where("keep").count() == len(edge_rows())  # one class: no model
    assert cotraining.classify(empty, labels).count() == 0
    some = spark.read.parquet(f"{SF}/documents.parquet").unionByName(edges)
    got = cotraining.classify(clashing(some), spark.read.parquet(f"{SF}/labels.parquet"))
    assert got.count() == some.count() and got.where("score is null").count() == 0
    assert {r.keep for r in got.join(edges.where("doc_id in (2, 3)").select("doc_id"), "doc_id").where("score = 0").collect()} == {False}


def test_keep_good_leaves_columns_as_they_are(spark, edges):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    some = spark.read.parquet(f"{SF}/documents.parquet").unionByName(edges)
    own = some.withColumns({"score": F.lit(7), "keep": F.lit(False), "text_score": F.lit("x"), "size": F.lit(3), "th": F.lit(None).cast("int")})
    kept = cotraining.keep_good(own, labels)
    assert kept.schema == own.schema
    assert {(r.score, r.keep, r.text_score, r.size, r.th) for r in kept.collect()} == {(7, False, "x", 3, None)}
    good = cotraining.classify(some, labels).where("keep").groupBy("doc_id").count().collect()
    assert sorted(map(tuple, good), key=str) == sorted(map(tuple, kept.groupBy("doc_id").count().collect()), key=str)


def test_histogram_edges_take_whole_bins():
    counts = np.zeros(cotraining.BINS)
    counts[[3, 10, 20]] = 50, 5, 4
    step = lambda k: cotraining.SURE + cotraining.BIN * k
    assert cotraining.edge(counts, 9) == pytest.approx(step(4)) and cotraining.edge(counts, 1) == pytest.approx(step(20))
    assert cotraining.edge(counts, 100) == pytest.approx(cotraining.SURE) and cotraining.edge(counts * 0, 9) == np.inf


# op 2


def brute_nearest(vectors, k=10):
    out = {}
    for q, a in vectors:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((b - a) ** 2).sum())), i) for i, b in vectors if i != q)
            out[q] = near[:k]
    return out


def test_forest_recall_on_real_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in prefix_forest.nearest(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    want = brute_nearest([(r.vec_id, np.array(r.embedding, float)) for r in table.collect()])
    hits = [i in got[q] for q, near in want.items() for _, i in near]
    assert np.mean(hits) >= 0.9
    assert all(len(x) == 10 for x in got.values())
    exact = {(q, i): s for q, near in want.items() for s, i in near}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, x in got.items() for i, s in x.items() if (q, i) in exact)


def _forest_recall(data, asks, k=10):
    """(recall of the k nearest, share of the vectors met)."""
    forest = prefix_forest.Forest(data, prefix_forest.Hashes(data[:4_096].mean(axis=0)))
    found = [near for near, _ in forest.search(asks, k + 1)]
    want = [np.argsort(((data - q) ** 2).sum(1))[: k + 1] for q in asks]
    return np.mean([np.isin(w, c).mean() for w, c in zip(want, found, strict=True)]), forest.met / len(asks) / len(data)


def test_forest_meets_few_vectors_of_clusters_and_more_where_there_are_none():
    r = np.random.default_rng(2)
    centres = r.standard_normal((100, 64))
    clustered = centres[r.integers(0, 100, 8_000)] + 0.3 * r.standard_normal((8_000, 64))
    recall, met = _forest_recall(clustered, clustered[:60])
    assert recall >= 0.95 and met < 0.05
    gaussian = r.standard_normal((6_000, 64))
    recall, met = _forest_recall(gaussian, gaussian[:60])
    assert recall >= 0.9 and met < 0.8


def test_forest_descends_to_the_longest_prefix():
    r = np.random.default_rng(4)
    forest = prefix_forest.Forest(r.standard_normal((500, 8)), prefix_forest.Hashes(np.zeros(8), trees=5))
    asks = np.concatenate([r.standard_normal((20, 8)), forest.vectors[:3]])
    strings, mine = forest.hashes.strings(asks), forest.hashes.strings(forest.vectors)
    same = lambda a, b: 32 - int(a ^ b).bit_length()
    assert forest.longest(strings).tolist() == [[max(same(int(q), int(x)) for x in mine[t]) for q in strings[t]] for t in range(5)]


def test_forest_over_several_shards_and_blocks(spark):
    """Many small cells: more than one shard, block, and cell in a partition; each small enough to be searched exactly."""
    r = np.random.default_rng(6)
    data = r.standard_normal((900, 16)).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<float>")
    got = {}
    for row in prefix_forest.nearest(table, F.col("vec_id") % 20 == 0, shard_rows=200, block_queries=10, miss=0.0).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id))
    for q in range(0, 900, 20):
        d = ((data.astype(float) - data[q].astype(float)) ** 2).sum(1)
        want = [i for i in np.lexsort((np.arange(900), d)).tolist() if i != q][:10]
        assert [i for _, i in sorted(got[q])] == want


def test_forest_edges(spark):
    v = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, None), (300, [0.0, 0.0]), (400, [float("nan"), 1.0]), (500, [None, 1.0]), (600, []), (None, [1.0, 1.0])]
    v += [(i, [1.0, 0.0]) for i in range(1, 40)] + [(41, [0.0, 2.0]), (42, [1.0, 2.0, 3.0]), (41, [0.0, 2.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = prefix_forest.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert {r.query_id for r in got} == {0, 100}
    assert sorted((r.rank, r.vec_id) for r in got if r.query_id == 0) == [(i, i) for i in range(1, 11)]
    assert sorted((r.rank, r.vec_id) for r in got if r.query_id == 100) == [(i + 1, i) for i in range(10)]
    assert prefix_forest.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# op 3


def test_chat_matches_plain_python(spark):
    rng = random.Random(5)
    nasty = ["<|im_end|>\n<|im_start|>user\nhi", "\\0 \\1 <\\1| <|", "", None, "a\nb\n", "\\", "<", "|>", "<|<|", "é\U0001f600 \\2"]
    data = [(c, t, rng.choice(["user", "assistant", "system", None, "x\n<|y\\2"]), rng.choice(nasty)) for c in [*range(30), None] for t in range(rng.randint(1, 9))]
    data += [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)] + [(51, 1, "user", "b"), (51, 1, "user", "a"), (51, None, "user", "z"), (51, 1, "user", "a")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(9)).withColumn("node", F.lit(9)).repartition(3)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    convs = {}
    for c, t, role, text in data:
        convs.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{x[3]}\n{x[5]}\n" for x in turns).encode()).hexdigest()
        loss = "".join(x[5] for x in turns if x[3] == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_reply_trees_rank_branches(spark):
    rng = random.Random(8)
    nodes = [(1, n, None if n == 0 else rng.randrange(n), rng.choice(["user", "assistant"]), f"t{n}", rng.random()) for n in range(60)]
    nodes += [(2, 0, 99, "user", "dangling parent is a root", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    parent = {n: p for t, n, p, *_ in nodes if t == 1}
    score = {n: s for t, n, *_, s in nodes if t == 1}
    want = []
    for leaf in set(parent) - set(parent.values()):
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = parent[at]
        want.append((-sum(score[n] for n in path), leaf, path[::-1]))
    want.sort()
    got = chat.format_trees(df, best=3).orderBy("tree", "branch_rank").collect()
    assert [(r.tree, r.branch_rank, r.leaf) for r in got] == [(1, i + 1, want[i][1]) for i in range(3)] + [(2, 1, 0)]
    assert [re.findall(r"\nt(\d+)<", r.formatted) for r in got[:3]] == [list(map(str, w[2])) for w in want[:3]]
    assert chat.format_trees(df.limit(0)).count() == 0


# op 4


def _model(docs, **options):
    counts = pseudo_likelihood.word_counts(docs).df
    words = pseudo_likelihood.lexicon(counts, **options)
    encoded = settle(pseudo_likelihood.encode(docs, words).withColumn("row", F.monotonically_increasing_id()), "encoded")
    return counts, words, encoded, counts.agg(F.sum("n")).first()[0]


def test_pseudo_likelihood_against_plain_loops(spark):
    """Every token by a loop over the formula; most counts are joined, not sent."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, words, encoded, total = _model(docs, sent=100)
    network = pseudo_likelihood.train(encoded, total, pseudo_likelihood.Network.start(words.log_mass))
    texts = {r.doc_id: r.text for r in docs.limit(6).collect()}
    every = Counter(w.translate(decontaminate.UPPER) for r in docs.select("text").collect() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert sum(every.values()) == total
    hashes = {w: hashed_words(pa.array([w])).hashes for w in every}
    cell = {w: int(words.encode(h)[0][0]) for w, h in hashes.items()}
    mass = Counter()
    for w, n in every.items():
        mass[cell[w]] += n
    got = {r.doc_id: r for r in pseudo_likelihood.score(encoded, counts, network).collect()}
    softmax = lambda z: np.exp(z) / np.exp(z).sum()
    for doc_id, text in texts.items():
        said = [w.translate(decontaminate.UPPER) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        total = 0.0
        for i, w in enumerate(said):
            around = [cell[said[i + k]] if 0 <= i + k < len(said) else pseudo_likelihood.CELLS for k in (-2, -1, 1, 2)]
            hidden = np.tanh(np.concatenate([network.table[a] for a in around]) @ network.w1 + network.b1)
            g, m = divmod(cell[w], pseudo_likelihood.MEMBERS)
            total += np.log(softmax(hidden @ network.w2 + network.b2)[g]) + np.log(softmax(hidden @ network.u[g] + network.c[g])[m]) + np.log(every[w] / mass[cell[w]])
        assert got[doc_id].n_tokens == len(said) and got[doc_id].sum_logprob == pytest.approx(total, rel=1e-4)


def test_pseudo_likelihood_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, eight = ({r.doc_id: r.sum_logprob for r in pseudo_likelihood.pseudo_likelihood(docs.repartition(n)).collect()} for n in (1, 8))
    assert one == pytest.approx(eight, rel=1e-6)


def test_pseudo_likelihood_learns_the_word_from_both_sides(spark, monkeypatch):
    """The order of words is learnt by several shards, whose networks are averaged part by part."""
    monkeypatch.setattr(pseudo_likelihood, "MEAN_OF", 2)
    rng = random.Random(1)
    order = [" ".join(f"w{(s + i) % 50}" for i in range(200)) for s in range(50)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(order * 8)], "doc_id long, text string")
    shuffled = order[0].split()
    rng.shuffle(shuffled)
    docs = docs.unionByName(spark.createDataFrame([(1000, order[0]), (1001, " ".join(shuffled))], "doc_id long, text string"))
    counts, words, encoded, total = _model(docs)
    network = pseudo_likelihood.train(encoded, total, pseudo_likelihood.Network.start(words.log_mass), rounds=4, shard_words=total // 5)
    got = {r.doc_id: r.mean_logprob for r in pseudo_likelihood.score(encoded, counts, network).collect()}
    assert got[1000] > got[1001] + 0.5


def test_pseudo_likelihood_edges(spark, edges, empty):
    got = pseudo_likelihood.pseudo_likelihood(clashing(edges)).collect()
    assert len(got) == len(edge_rows())
    assert all(r.sum_logprob == 0 and r.mean_logprob is None for r in got if r.n_tokens == 0)
    assert pseudo_likelihood.pseudo_likelihood(empty).count() == 0


# op 5


def brute_contamination(docs, items, width=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    windows = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[p : p + width]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [decontaminate.AUTOMATON_BYTES, 40])
def test_contamination_matches_brute_force(spark, limit):
    rng = random.Random(4)
    few = ["a", "B", "c1", "é", "dd"]
    items = [(i, prose(rng, rng.choice([0, 1, 3, 9, 10, 11, 14]), few)) for i in range(25)] + [(3, "a B c1"), (None, "dd dd dd"), (77, None), (78, "...")]
    docs = [(i, rng.choice([", ", " ", "\n", "--"]).join(prose(rng, rng.randint(0, 60), few).split())) for i in range(60)] + [(d, t) for d, t, *_ in edge_rows()]
    full = [(d, t, "en", "s", 1) for d, t in docs]
    got = decontaminate.contamination(clashing(spark.createDataFrame(full, DOCS)), spark.createDataFrame(items, ITEMS), limit=limit)
    assert sorted(map(str, rows(got.drop("spans")))) == sorted(map(str, brute_contamination(docs, items)))
    for text, spans in rows(decontaminate.scan(spark.createDataFrame(full[:60], DOCS), spark.createDataFrame(items, ITEMS), limit=limit).select("text", "spans")):
        assert all(len(decontaminate.WORD.findall(text[s.start : s.end].translate(decontaminate.UPPER))) >= 1 for s in spans)


def test_contamination_empty_tables(spark, edges, empty):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.contamination(edges, none).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, none).count() == 0
    assert decontaminate.clean(edges, none).count() == len(edge_rows())


# op 6


@pytest.fixture(scope="module")
def license_model():
    return licenses.train()


def _found(spark, model, texts):
    got = licenses.scan(clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)), model).collect()
    return [sorted((r.family, r.confirmed) for r in got if r.doc_id == i) for i in range(len(texts))], got


def test_licenses_are_found_and_prose_is_left_alone(spark, license_model):
    rng = random.Random(2)
    notes = {f: t[0] for f, t in licenses.TEMPLATES.items()}
    texts = [f"{prose(rng, 80)}\n\n{t}\n\n{prose(rng, 40)}" for t in notes.values()] + [f"{prose(rng, 60)} {t} {prose(rng, 200)}" for t in notes.values()]
    plain = [prose(rng, 300), "of the " * 80, "mit " * 50, "driving licenses rise " + prose(rng, 30), "Ich gehe mit dir und mit dem Hund", None, ""]
    found, rows = _found(spark, license_model, texts + plain)
    want = [[(f, True)] for f in notes]
    assert found[: len(notes)] == want
    assert np.mean([(f, True) in x for f, x in zip(notes, found[len(notes) :], strict=False)]) >= 0.8
    assert all(not x for x in found[2 * len(notes) :])
    by_paragraph = [r for r in rows if r.doc_id < len(notes)]
    assert all(r.paragraph == 1 and abs(r.start - texts[r.doc_id].index(list(notes.values())[r.doc_id])) <= 40 for r in by_paragraph)
    assert all(texts[r.doc_id][r.start : r.start + r.length].strip() for r in rows)


def test_licenses_in_wrapped_lines_and_short_forms(spark, license_model):
    """Real notices as they are written: wrapped, in comments, by SPDX tag, two at once; unlisted families are unknown."""
    gpl = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software"
    apache = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#     http://www.apache.org/licenses/LICENSE-2.0"
    one = {gpl: "GPL-3.0", mit: "MIT", apache: "Apache-2.0", "SPDX-License-Identifier: MIT": "MIT", "Released under GPLv3": "GPL-3.0", "CC BY-SA 4.0": "CC-BY-SA", "Creative Commons Attribution 4.0 International": "CC-BY", "Licensed under the MIT licence": "MIT"}
    assert _found(spark, license_model, list(one))[0] == [[(f, True)] for f in one.values()]
    two = ["Dual MIT/Apache-2.0", "SPDX-License-Identifier: MIT OR Apache-2.0", "This is licensed under either the MIT license or the Apache License, Version 2.0 at your option."]
    assert all([f for f, _ in x] == ["Apache-2.0", "MIT"] for x in _found(spark, license_model, two)[0])
    other = ["Licensed under the Eclipse Public License v1.0.", "Licensed under the Artistic License 2.0.", "Distributed under the Frobnicator License agreement of the vendor, version 9."]
    assert _found(spark, license_model, other)[0] == [[("unknown", False)]] * 3


def test_licenses_windows_cover_every_word():
    """Paragraphs and windows against plain Python."""
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["", " ", prose(rng, rng.randint(1, 30))]) for _ in range(12)) for _ in range(30)] + [None, "", prose(rng, 700)]
    found = hashed_words(licenses.normal(pa.array(texts)))
    starts = licenses.paragraphs_of(found)
    want = [len(p.split()) for t in texts for p in re.split(r"\n[ \t]*\n\s*", (t or "").strip()) if p.split()]
    ends = np.append(starts[1:], len(found.hashes))
    assert (ends - starts).tolist() == want
    begin, end, owner = licenses._windows(starts, ends)
    covered = {i for b, e in zip(begin, end, strict=True) for i in range(b, e)}
    assert covered == set(range(len(found.hashes))) and (begin >= starts[owner]).all() and (end <= ends[owner]).all()


def test_licenses_edges(spark, edges, empty):
    assert licenses.scan(edges).where("confirmed").count() == 0
    assert licenses.scan(empty).count() == 0
    twice = spark.createDataFrame([(None, "Released under the MIT License.", "en", "s", 1)] * 2, DOCS)
    assert [r.family for r in licenses.scan(twice).collect()] == ["MIT", "MIT"]


# op 7


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_simhash(data):
    fps = [brute_fingerprint(t) for _, t in data]
    comp = components_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    ids = {}
    for (d, _), c in zip(data, comp, strict=True):
        ids.setdefault(c, []).extend([] if d is None else [d])
    return sorted(map(str, ((d, f"{f:016x}", min(ids[c], default=None)) for (d, _), f, c in zip(data, fps, comp, strict=True))))


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    data = rows(docs) + [(d, t) for d, t, *_ in edge_rows()]
    got = simhash.near_duplicates(clashing(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in data], DOCS)))
    assert sorted(map(str, rows(got))) == brute_simhash(data)
    kept = simhash.keep_first(docs).count()
    assert kept == len({c for *_, c in rows(simhash.near_duplicates(docs))})


def test_simhash_links_in_split_shards(spark):
    rng = np.random.default_rng(0)
    fps = {int(b) for b in rng.integers(0, 2**63, 40)}
    for f in list(fps):
        for _ in range(8):
            for bit in rng.choice(63, rng.integers(1, 4), replace=False):
                f ^= 1 << int(bit)
            fps.add(f)
    fps = sorted(fps)
    want = components_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for limit in (simhash.TREE_LIMIT, 3):
        edges = rows(simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long"), tree_limit=limit))
        at = {f: i for i, f in enumerate(fps)}
        assert components_of(len(fps), [(at[a], at[b]) for a, b in edges]) == want


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


# op 8


@pytest.mark.parametrize("shard_ids", [token_shards.SHARD_IDS, 3_000])
def test_token_shards_round_trip(spark, shard_ids):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(d, t) for d, t, *_ in edge_rows() if d is not None and d > 3 and d < 6]
    data += [(10**6 + i, t) for i, t in enumerate(["äb ̈c", "İstanbul ΣΑΣ Σ x", "<|startoftext|>x<|endoftext|>", "it's 12 don'T\x85y\x1cz", None, "", " \n"])]
    df = clashing(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in data], DOCS)).repartition(5)
    folder, manifest = token_shards.write_shards(df, path, n_ranges=4, shard_ids=shard_ids)
    got = token_shards.read_shards(folder, manifest).orderBy("start").collect()
    want, start = [], 0
    for d, t in sorted(data, key=lambda x: x[0]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    files = {r.file: r for r in manifest.collect()}
    assert len(files) == 4 if shard_ids == token_shards.SHARD_IDS else len(files) > 8
    assert sum(f.n_ids for f in files.values()) == start and sum(f.n_docs for f in files.values()) == len(got)
    for r in got[::17]:
        reader = token_shards.TableReader(open(f"{folder.removeprefix('file://')}/{r.file}", "rb").read())
        assert len(reader.get(r.doc_id)) >= 1 and reader.get(-5) is None


def test_encoder_under_other_rules():
    """A tokenizer that keeps case and blanks gets whole texts; one of the known rules gives the same ids word by word."""
    texts = ["One  two,\n Three's <|endoftext|> ÉÀ x2", "", "a", " b B. (c) DON'T", "\u0130 e\u0301 \u2003z"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = token_shards.Encoder(queries.tokenizer_path(name))
        assert encoder._by_word == (name == "word_bpe_49k.json")
        ids, ends = encoder.encode(pa.array(texts, pa.large_string()))
        want = [encoder._tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


def test_token_shards_edges(spark, edges, empty):
    folder, manifest = token_shards.write_shards(edges, queries.tokenizer_path())
    got = token_shards.read_shards(folder, manifest).orderBy("start").collect()
    assert len(got) == len(edge_rows()) and [r.doc_id for r in got][:2] == [None, None]
    assert token_shards.read_shards(*token_shards.write_shards(empty, queries.tokenizer_path())).count() == 0


def test_table_blocks_and_wide_ids():
    parts = []
    writer = token_shards.TableWriter(parts.append)
    keys = [None, -5, 0, 3, 3, 2**62]
    for i, k in enumerate(keys):
        writer.add(token_shards.key_of(k), np.arange(i * 40_000, dtype=np.uint32))
    writer.close()
    reader = token_shards.TableReader(b"".join(parts))
    assert [token_shards.id_of(k) for k, _ in reader] == keys and len(reader.blocks) > 2
    assert [len(x) for _, x in reader] == [i * 40_000 for i in range(6)]
    assert reader.get(2**62).max() == 199_999 and reader.get(4) is None and len(reader.get(3)) == 120_000
    with pytest.raises(ValueError):
        token_shards.TableReader(b"".join(parts)[:-1] + b"x")


# op 9


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        for s in over or free:
            target[s] = 2.0 * sizes[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


def test_mixing_reaches_targets(spark, edges, empty):
    rng = random.Random(6)
    data = [(i, prose(rng, rng.randint(0, 60)), "en", rng.choice(["a", "b", "Z", "é", None, "hot", "hot", "hot"]), 1) for i in range(3_000)] + edge_rows()
    df = clashing(spark.createDataFrame(data, DOCS))
    got = mixing.mix(df).collect()
    assert len(got) == len(data)
    by = {}
    for d, t, _, s, _ in data:
        by[s] = by.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(by)
    sizes = {(r.source_size, round(r.target, 6)) for r in got}
    assert sizes == {(by[s], round(want[s], 6)) for s in by}
    for s in by:
        taken = sum(r.taken for r in got if r.source_size == by[s])
        largest = max((r.size for r in got if r.source_size == by[s]), default=0)
        assert abs(taken - want[s]) <= largest
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    assert mixing.apply_mix(df).count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mix(edges).count() == len(edge_rows())


# op 10


def test_paragraphs_find_planted_passages(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3_000)]
    docs = {i: [prose(rng, 40, vocabulary) for _ in range(6)] for i in range(200)}
    passages = [prose(rng, 60, vocabulary) for _ in range(40)]
    held = set()
    for k, p in enumerate(passages):
        for d in (k, k + 50):
            held.add(d)
            if k % 2:
                docs[d].insert(3, p)
            else:  # inside a line
                words = docs[d][2].split()
                docs[d][2] = " ".join([*words[:17], p, *words[17:]])
    edited = prose(rng, 80, vocabulary).split()
    for d in (150, 151, 152):
        held.add(d)
        line = list(edited)
        line[d - 150] = "zzz"
        docs[d][0] = " ".join(line)
    df = spark.createDataFrame([(d, "\n".join(t), "en", "s", 1) for d, t in docs.items()], DOCS)
    got = paragraphs.repeats(clashing(df)).collect()
    found = {r.doc_id for r in got}
    assert len(found & held) >= 0.95 * len(held) and not found - held
    assert all(r.removed == (r.first_doc_id != r.doc_id) for r in got)
    texts = {r.doc_id: r.text for r in paragraphs.without_repeats(df).collect()}
    full = {d: "\n".join(t) for d, t in docs.items()}
    gone = Counter()
    for r in got:
        if r.removed:
            gone[r.doc_id] += r.n_words
    assert all(len(texts[d].split()) == len(full[d].split()) - gone[d] for d in full)


def test_paragraph_links_match_brute_force(spark):
    """Jaccard links of distinct paragraphs: every pair found is one, and of all pairs that are, few are missed."""
    rng = random.Random(10)
    lines = []
    for _ in range(60):
        base = prose(rng, 12).split()
        lines.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            base = base + [f"x{rng.randint(0, 9)}"] if rng.random() < 0.5 else base[:-1]
            lines.append(" ".join(base))
    import pyarrow as pa

    units = paragraphs.Units.of(pa.array(lines))
    shingles, starts = units.shingles()
    sets = dict(zip(units.names().tolist(), map(set, np.split(shingles, starts[1:])), strict=True))
    long = {u: s for u, s in sets.items() if u in set(units.names()[units.end - units.begin >= 5].tolist())}
    names = sorted(long)
    near = [(i, j) for i, a in enumerate(names) for j, b in enumerate(names[:i]) if len(long[a] & long[b]) >= 0.8 * len(long[a] | long[b])]
    want = components_of(len(names), near)
    got = dict(rows(paragraphs.near_units(spark.createDataFrame([(t,) for t in lines], "text string"))))
    label = [names.index(got.get(n, n)) for n in names]
    linked = {(a, b) for a, x in enumerate(want) for b, y in enumerate(want) if a < b and x == y}
    found = {(a, b) for a, x in enumerate(label) for b, y in enumerate(label) if a < b and x == y}
    assert found <= linked and len(found) >= 0.97 * len(linked)


def test_many_paragraphs_are_linked_as_few_are():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 12)
    sets = [np.unique(np.r_[base[: rng.integers(8, 13)], rng.integers(0, 1 << 40, rng.integers(0, 6))]) for _ in range(400)]
    few, many = paragraphs.similar(sets, 0.6), paragraphs.similar_many(sets, 0.6)
    groups = lambda root: {frozenset(np.flatnonzero(root == r)) for r in set(root.tolist())}
    assert groups(few) == groups(many)


def test_paragraph_parts_keep_links():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 12)) for _ in range(80)]
    want = components_of(80, [(i, j) for i in range(80) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.3 * len(np.union1d(sets[i], sets[j]))])
    assert paragraphs.similar(sets, 0.3).tolist() == want


def test_one_crowded_band(spark, monkeypatch):
    """50,000 paragraphs that share a shingle with all others, and so a band; 300 near copies among them."""
    monkeypatch.setattr(paragraphs, "BAND_PART", 200)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(14))
    top = max((f"top{i}" for i in range(200_000)), key=dict(zip((f"top{i}" for i in range(200_000)), hashed_words(pa.array([" ".join(f"top{i}" for i in range(200_000))])).hashes.tolist(), strict=True)).get)
    lines = [f"{top} one two three four {word()} {word()}" for _ in range(50_000)]  # the word of the largest hash begins the paragraph
    close = [" ".join([*x.split()[:-1], "end"]) for x in lines[:300]]
    units = paragraphs.Units.of(pa.array([*lines, *close]))
    assert len(units.begin) < 50_310
    got = dict(rows(paragraphs.near_units(spark.createDataFrame([(x,) for x in [*lines, *close]], "text string"), similarity=0.5)))
    names = units.names()[units.first == 0].tolist()
    assert np.mean([a in got and got[a] == got.get(b) for a, b in zip(names[:300], names[50_000:], strict=True)]) >= 0.97
    assert len(got) <= 600


def test_paragraph_edges(spark, edges, empty):
    got = paragraphs.repeats(clashing(edges)).collect()
    assert {r.doc_id for r in got} == {None, 5, 6}
    assert paragraphs.repeats(empty).count() == 0
    assert paragraphs.without_repeats(edges).count() == len(edge_rows())


# SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got[columns].itertuples(index=False))) == sorted(map(str, want[columns].itertuples(index=False)))


def test_several_automata_leave_hits_alone(spark, tmp_path, monkeypatch):
    """Of passes only the hits are written: far less than the texts, however many automata there are."""
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    many = decontaminate.contamination(docs, items, limit=1500).drop("spans")
    got = sorted(map(tuple, many.collect()))
    assert got == sorted(map(tuple, decontaminate.contamination(docs, items).drop("spans").collect()))
    kept = decontaminate.clean(docs.unionByName(docs), items, limit=1500)
    clean = [r[0] for r in got if not r[5]]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean + clean)
    written = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert 0 < written < 0.3 * sum(len(r.text.encode()) for r in docs.select("text").collect())
