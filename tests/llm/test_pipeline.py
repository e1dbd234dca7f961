"""Each stage of the pipeline against plain Python on a small table, then the whole."""

import random
import re
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import cotraining, queries
from quillspark.llm.scratch import settle

from .helpers import DOCS, components_of, prose
from .test_operators import rows

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def docs(spark):
    """Prose, near copies on either side of 0.8, exact copies, passages of the benchmark, nulls and repeats."""
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(30, 90)) for _ in range(40)]
    for t in texts[:12]:
        w = t.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += texts[:6] + [None, "", " \n", "one"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(5).collect()]
    texts += [f"{prose(rng, 20)} {' '.join(x.split()[3:16])} {prose(rng, 20)}" for x in items] + [f"{prose(rng, 20)} {' '.join(x.split()[3:11])} {prose(rng, 20)}" for x in items]
    table = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*table, (None, texts[0], None, None, None), table[3]], DOCS)


def test_stages_in_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mix", "tokens"]


def test_quality_keeps_what_the_classifier_keeps(spark, docs):
    kept = corpus_pipeline.quality(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = cotraining.train(settle(cotraining.views(docs), "views"), labels)
    want = cotraining.score(docs, model).where("keep").select(docs.columns)
    assert kept.columns == docs.columns and sorted(map(str, rows(kept))) == sorted(map(str, rows(want)))


def test_near_dedup_against_all_pairs(spark, docs):
    every = rows(docs)
    sets = [shingles(r[1]) for r in every]
    alike = lambda a, b: not a and not b or bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    group = components_of(len(every), [(i, j) for i in range(len(every)) for j in range(i) if alike(sets[i], sets[j])])
    got = rows(corpus_pipeline.near_dedup(spark, docs, SF))
    lead = {}
    for r, g in zip(every, group, strict=True):
        lead[g] = min(lead.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted(lead.values())


def test_decontamination_against_windows(spark, docs):
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = plain(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))
    own = docs.withColumns({"items": F.lit("mine"), "n_words": F.lit(-1), "ranges": F.lit(None).cast("int")})
    got = corpus_pipeline.decontamination(spark, own, SF)
    want = [r for r in rows(own) if not hit(plain(r[1]))]
    assert got.columns == own.columns and sorted(map(str, rows(got))) == sorted(map(str, want)) and 0 < len(want) < own.count()


def test_mix_comes_near_its_targets(spark, docs):
    got = corpus_pipeline.mix(spark, docs, SF)
    assert got.columns == docs.columns
    sizes, taken = Counter(), Counter()
    for r in rows(docs):
        sizes[r[3]] += len(words(r[1]))
    for r in rows(got):
        taken[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        part = {s: (budget - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if part[s] >= 2 * sizes[s]}
        target.update({s: 2.0 * sizes[s] for s in over} if over else part)
        free -= over if over else free
    most = max(len(words(r[1])) for r in rows(docs))
    assert all(abs(taken[s] - target[s]) <= most for s in names)
    times = Counter(map(str, rows(got)))
    assert max(n / m for r, m in Counter(map(str, rows(docs))).items() if (n := times[r])) <= 2


def test_tokens_are_those_of_the_tokenizer(spark, docs):
    got = corpus_pipeline.tokens(spark, docs, SF).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    sizes = sorted((r[0] is None, r[0] or 0, len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows(docs))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sizes
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


def test_the_whole(spark):
    """Run twice: the same rows; no stage adds documents that weren't there."""
    one, two = ([tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()] for _ in range(2))
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert one == two and one and {r[0] for r in one} <= ids


def test_stages_say_what_they_do():
    assert all(f.__doc__ and "null" in f.__doc__.lower() for _, f in corpus_pipeline.STAGES), sys.modules[corpus_pipeline.__name__]
