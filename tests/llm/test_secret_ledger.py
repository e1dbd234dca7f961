"""The secret ledger against plain Python."""

import hashlib
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillspark.llm import secret_ledger
from quillspark.llm.scratch import fresh_path
from quillspark.llm.secret_ledger import BASE, RULES, Ledger, Rule, report

from .helpers import DOCS, clashing, edge_rows

#: The contract's words, written apart from the rules.
CONTRACT = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute(text):
    base = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}", kind) for k, (kind, (p, ok)) in enumerate(CONTRACT.items()) for m in p.finditer(text or "") if ok(m))
    more = [(m.start(), 3 + k, f"{r.kind}:{m.start()}:{m.end()}", r.kind) for k, r in enumerate(RULES[3:]) for m in re.finditer(r.pattern, text or "")]
    counts = [sum(x[3] == kind for x in base) for kind in CONTRACT]
    listed = ",".join(x[2] for x in base)
    return (*counts, hashlib.sha256(listed.encode()).hexdigest(), ",".join(x[2] for x in sorted(base + more)))


def texts():
    rng = random.Random(6)
    bits = ["password", "PassWD", "secret", "ToKen", "api_key", "APIkey", "toKen", "ſecret", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "x", "\n", "é", "\U0001f600",
            "abcdefgh", "-", "ghp_" + "a1" * 18, "xoxb-1234567890ab", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "x" * 35, "the", "\x00", "\r\n"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return made + ["api_key=token\"=abcdefg", "token=secret=abcdefgh", "token = ab token=abcdef", "a" * 23, "f" * 24, "AKIA" * 10, "password: hunter22 " * 3000, None, ""]


def test_report_equals_plain_python(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts())]
    rows += [(1000 + i, rows[5][1], "en", "s", 1) for i in range(50)] + edge_rows()
    got = report(clashing(spark.createDataFrame(rows, DOCS)).repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)


def test_copies_of_a_common_text_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(secret_ledger, "PART_ROWS", 7)
    rows = [(i, "token = abcdefgh" if i % 2 else f"no secret {i % 5}", "en", "s", 1) for i in range(100)]
    got = report(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], *brute(r[1])) for r in rows)


@pytest.fixture
def ledger(spark):
    return Ledger(spark, fresh_path(spark, "test-ledger"))


def added(spark, ledger, before):
    """Rows that the last scan appended: blobs, and pairs of blob and rule."""
    rows = spark.read.parquet(ledger.path)
    new = rows.count() - before[0], rows.select(F.explode("rules")).count() - before[1]
    return new, (before[0] + new[0], before[1] + new[1])


def test_only_unseen_pairs_are_scanned(spark, ledger):
    first = [(1, "token=abcdefgh", None, None, None), (2, "token=abcdefgh", None, None, None), (3, "nothing", None, None, None)]
    report(spark.createDataFrame(first, DOCS), ledger)
    new, total = added(spark, ledger, (0, 0))
    assert new == (2, 2 * len(RULES))
    report(spark.createDataFrame(first, DOCS), ledger)
    assert added(spark, ledger, total)[0] == (0, 0)
    again = report(spark.createDataFrame([*first, (4, "AKIA" + "X" * 16, None, None, None), (None, None, None, None, None)], DOCS), ledger)
    new, total = added(spark, ledger, total)
    assert new == (2, 2 * len(RULES))
    assert {r.doc_id: r.spans for r in again.collect()} == {1: "assign:0:14", 2: "assign:0:14", 3: "", 4: "access:0:20", None: ""}
    # a new version of one rule is scanned alone, and what its old version found no longer counts
    stricter = (replace(BASE[0], version=2, least=20), *RULES[1:], Rule("nothing", 1, "noth[a-z]+"))
    newer = report(spark.createDataFrame(first, DOCS), ledger, stricter)
    new, total = added(spark, ledger, total)
    assert new == (2, 4)
    assert {r.doc_id: r.spans for r in newer.collect()} == {1: "", 2: "", 3: "nothing:0:7"}


def test_of_nothing(spark, ledger):
    assert report(spark.createDataFrame([], DOCS), ledger).collect() == []
    assert ledger.entries().collect() == []
