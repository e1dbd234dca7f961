"""Benchmark decontamination: one Aho-Corasick automaton over windows of normalised benchmark words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import ROW, row_key
from .scratch import Settled
from .words import as_strings, text_chunks

WINDOW = 10
#: UTF-8 bytes of benchmark texts in one automaton (about 60 times as much memory); a larger benchmark becomes several automata.
AUTOMATON_BYTES = 2_000_000
#: Separators are the ASCII characters that are neither letters nor digits; A-Z is lower-cased; other characters are word characters.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NORMAL = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return (text or "").encode().translate(NORMAL).split()


def _joined(words: list[bytes]) -> str:
    """Words between blanks, byte by byte, so that a match is one of whole words."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""


@dataclass
class Automaton:
    """Windows of all items of a block; ``ids`` has each window's items."""

    width: int
    ids: list[list[str]] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    machine: ahocorasick.Automaton = field(default_factory=ahocorasick.Automaton)

    @classmethod
    def of(cls, items: list[tuple[object, str | None]], width: int) -> Automaton:
        self, known = cls(width), {}
        for item, text in items:
            words = normal_words(text)
            for i in range(max(1, len(words) - width + 1) if words else 0):
                window = words[i : i + width]
                key = _joined(window)
                if key not in known:
                    known[key] = len(self.ids)
                    self.ids.append([])
                    self.lengths.append(len(window))
                    self.machine.add_word(key, known[key])
                if item is not None and str(item) not in self.ids[known[key]]:
                    self.ids[known[key]].append(str(item))
        self.machine.make_automaton()
        return self

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges [start, end) inside occurrences, and the items that occur. One pass over the text."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.ids or not words:
            return found, items
        text, at, seen = _joined(words), 0, 0
        spans = []
        for end, k in self.machine.iter(text):
            seen += text.count(" ", at, end)
            at = end
            spans.append((seen - self.lengths[k], seen))
            items.update(self.ids[k])
        for a, b in sorted(spans):
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], max(b, found[-1][1]))
            else:
                found.append((a, b))
        return found, items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as offsets in the original text."""
    words = [m.span() for m in WORD.finditer(text.translate(UPPER))] if ranges else []
    return [(words[a][0], words[b - 1][1]) for a, b in ranges]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, limit: int) -> Iterator[Automaton]:
    """Automata of at most about ``limit`` bytes of texts each, read one block at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // limit) or 1
    for i in range(count):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == i) if count > 1 else items
        yield Automaton.of([(r["item"], r["text"]) for r in block.toLocalIterator()], width)


#: What a scan adds, under names of its own.
N_WORDS, RANGES, ITEMS, SPANS = (f"__qs_{x}" for x in ("n_words", "ranges", "items", "spans"))
PAIRS = "array<struct<start:int,end:int>>"


def _scanned(docs: DataFrame, benchmark: DataFrame, width: int, doc_text: str, item_id: str, item_text: str, limit: int) -> DataFrame:
    """``docs`` with the four columns. A task holds one automaton, however many there are.

    One automaton scans the rows as they pass. Of several each has a pass of its own over the texts, of which only the hits
    are written, under a key of the row; they are put together and joined to the rows once.
    """
    spark = docs.sparkSession
    none = {N_WORDS: F.lit(0).cast("long"), RANGES: F.lit(None).cast(PAIRS), ITEMS: F.lit(None).cast("array<string>"), SPANS: F.lit(None).cast(PAIRS)}
    base, parts = docs.withColumns(none), []
    blocks = _blocks(benchmark, item_id, item_text, width, limit)
    automaton = next(blocks)
    for following in blocks:
        parts.append(_hits(docs, automaton, none, doc_text))
        automaton = following
    if parts:
        parts.append(_hits(docs, automaton, none, doc_text))
        every = reduce(DataFrame.unionByName, parts).groupBy(ROW).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in (RANGES, ITEMS)])
        base = docs.withColumn(ROW, row_key(docs)).join(every, ROW, "left").withColumns({N_WORDS: none[N_WORDS], SPANS: none[SPANS]}).select(*docs.columns, *none)
        automaton = Automaton.of([], width)  # finds nothing more: it counts words and places the hits
    return base.mapInArrow(_scanner(spark.sparkContext.broadcast(automaton), doc_text), base.schema)


def _hits(docs: DataFrame, automaton: Automaton, none: dict, doc_text: str) -> DataFrame:
    """(ROW, ranges, items) of the rows in which an automaton finds something, written to the shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast(automaton)
    narrow = docs.select(row_key(docs).alias(ROW), doc_text).withColumns(none)
    found = narrow.mapInArrow(_scanner(sent, doc_text), narrow.schema).where(F.size(RANGES) > 0).select(ROW, RANGES, ITEMS)
    settled = Settled(found.dropDuplicates([ROW]), "hits")
    sent.unpersist()
    return settled.df


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with n_words, ranges (hit words), items and spans (offsets in the original text).

    A window is ``width`` consecutive words of an item, all of them if it has fewer, none if it has none; a word of a
    document inside any occurrence of a window is hit. One automaton holds up to ``limit`` bytes of benchmark text and
    is sent to the tasks; a larger benchmark is dealt into blocks, each scanned in a pass of its own, so that neither a
    task nor a broadcast grows with it. Null texts have no words; an item with a null id hits but is not named;
    repeated items count once. An empty table on either side gives no hits. Columns of ``docs`` whose names clash with
    the new ones are replaced.
    """
    names = {N_WORDS: "n_words", RANGES: "ranges", ITEMS: "items", SPANS: "spans"}
    return _scanned(docs.drop(*names.values()), benchmark, width, doc_text, item_id, item_text, limit).withColumnsRenamed(names)


def _scanner(sent, doc_text: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for batch in text_chunks(batches, doc_text):
            names = batch.schema.names
            n_words, ranges, items, spans = [], [], [], []
            before = zip(batch.column(RANGES).to_pylist(), batch.column(ITEMS).to_pylist(), strict=True)
            for text, (old, named) in zip(as_strings(batch.column(doc_text)).to_pylist(), before, strict=True):
                words = normal_words(text)
                hit, found = automaton.scan(words)
                hit = merge(hit + [(r["start"], r["end"]) for r in old or []])
                n_words.append(len(words))
                ranges.append([{"start": a, "end": b} for a, b in hit])
                items.append(sorted(found.union(named or [])))
                spans.append([{"start": a, "end": b} for a, b in char_spans(text, hit)])
            new = {N_WORDS: n_words, RANGES: ranges, ITEMS: items, SPANS: spans}
            columns = [pa.array(new[n], batch.schema.field(n).type) if n in new else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return work


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the spans, one row per row of ``docs``."""
    found = scan(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["start"]))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans",
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns as they are.

    Null and empty texts hold none and stay; rows that repeat stay or go together; an empty benchmark removes nothing.
    """
    return _scanned(docs, benchmark, width, doc_text, item_id, item_text, limit).where(F.size(RANGES) == 0).select(*docs.columns)


CONTAMINATION_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS r FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM v),
x AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, lens WHERE len(w) >= k),
m AS (SELECT x.r, x.p, x.k, v.item_id FROM x JOIN v ON v.k = x.k AND v.s = array_to_string(x.w[x.p : x.p + x.k - 1], ' ')),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN n ON n.r = d.r
"""
