"""Ranked lexical search: one pass of an Aho-Corasick automaton over each text counts the terms of all items."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .decontaminate import NORMAL
from .scratch import settle
from .words import as_strings, text_chunks

#: Bytes of distinct terms in one automaton (about 60 times as much memory); more terms become several automata.
TERM_BYTES = 2_000_000
#: A term is a maximal run of characters other than the ASCII ones that are neither letters nor digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text that the automaton sees at once, and scores of a batch that stand in memory.
PIECE, CELLS = 4 << 20, 1 << 20
#: Parts in which an item's candidates are ranked first.
PARTS = 64


def _guarded(text: str) -> bytes:
    """The text as terms between blanks, with a blank at both ends, so that ``b' term '`` is found where a whole term is."""
    return b" " + text.encode().translate(NORMAL) + b" "


def _pieces(data: bytes) -> Iterator[str]:
    """The same in pieces that begin and end at a blank; no term is cut."""
    at = 0
    while len(data) - at > PIECE:
        end = data.find(b" ", at + PIECE)
        yield data[at : end + 1].decode("latin-1")
        at = end
    yield data[at:].decode("latin-1")


def _length(data: bytes) -> int:
    full = np.frombuffer(data, np.uint8) != 32
    return int(np.count_nonzero(full[1:] & ~full[:-1]))


@dataclass
class TermAutomaton:
    """Terms of a block of items; output k of the machine belongs to the items ``of[begin[k]:begin[k + 1]]``."""

    machine: ahocorasick.Automaton
    n_terms: int
    n_items: int
    begin: np.ndarray
    of: np.ndarray

    @classmethod
    def build(cls, pairs: list[tuple[int, str]]) -> TermAutomaton:
        """``pairs`` are distinct (item, term), items from 0."""
        known: dict[str, list[int]] = {}
        for item, term in pairs:
            known.setdefault(term, []).append(item)
        machine = ahocorasick.Automaton()
        for k, term in enumerate(known):
            machine.add_word(f" {term} ".encode().decode("latin-1"), k)
        machine.make_automaton()
        begin = np.concatenate([[0], np.cumsum([len(x) for x in known.values()])]).astype(np.int64)
        return cls(machine, len(known), max((i for i, _ in pairs), default=-1) + 1, begin, np.array([i for x in known.values() for i in x], np.int64))

    def count(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of terms of a text, and which of ours it holds how often."""
        data, found = _guarded(text), Counter()
        if self.n_terms:
            for piece in _pieces(data):
                found.update(map(itemgetter(1), self.machine.iter(piece)))
        size = len(found)
        return _length(data), np.fromiter(found.keys(), np.int64, size), np.fromiter(found.values(), np.int64, size)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _counter(sent, text: str):
    """Per task: rows (term, count), where term is an output of the machine, -1 for documents with terms and -2 for terms in all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        holds, docs, words = np.zeros(automaton.n_terms, np.int64), 0, 0
        for batch in text_chunks(batches, text):
            for value in as_strings(batch.column(text)):
                n, terms, _ = automaton.count(value.as_py())
                holds[terms] += 1
                docs += n > 0
                words += n
        met = np.flatnonzero(holds)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate([met, [-1, -2]]), "held": np.concatenate([holds[met], [docs, words]])})

    return work


class Best:
    """The ``best`` rows of each item among those shown, highest score first, then smallest doc_id, nulls last."""

    def __init__(self, n_items: int, best: int):
        self.best, self.least = best, np.ones(n_items, np.int64)
        self.item, self.score, self.doc, self.none = (np.zeros(0, np.int64) for _ in range(4))

    def show(self, docs: np.ndarray, none: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` has a row per document and a column per item."""
        row, item = np.nonzero(scores >= self.least)
        if len(row):
            self.item, self.score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
            self.doc, self.none = np.concatenate([self.doc, docs[row]]), np.concatenate([self.none, none[row]])
            self._reduce()

    def _reduce(self) -> None:
        order = np.lexsort((self.doc, self.none, -self.score, self.item))
        item = self.item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.best]
        self.item, self.score, self.doc, self.none = self.item[order], self.score[order], self.doc[order], self.none[order]
        ends = np.flatnonzero(place[place < self.best] == self.best - 1)
        self.least[self.item[ends]] = self.score[ends]


def _scorer(sent, weights: np.ndarray, n_docs: int, n_words: int, best: int, doc_id: str, text: str):
    """Per task: rows (item, doc_id, score), at most ``best`` for each item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        found, step = Best(automaton.n_items, best), max(1, CELLS // max(1, automaton.n_items))
        items_of = np.diff(automaton.begin)
        for batch in text_chunks(batches, text):
            ids = batch.column(doc_id)
            none = np.asarray(ids.is_null()).astype(np.int64)
            docs = np.asarray(ids.fill_null(0)).astype(np.int64)
            texts = as_strings(batch.column(text))
            for at in range(0, batch.num_rows, step):
                rows = range(at, min(at + step, batch.num_rows))
                scores = np.zeros((len(rows), automaton.n_items), np.int64)
                for k, i in enumerate(rows):
                    n, terms, tf = automaton.count(texts[i].as_py())
                    if not len(terms):
                        continue
                    norm = 10 + 90 * n * n_docs // n_words
                    values = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * norm))
                    # the items of each term one after the other, with the term's value
                    sizes = items_of[terms]
                    ends = np.cumsum(sizes)
                    where = np.arange(ends[-1]) + np.repeat(automaton.begin[terms] - ends + sizes, sizes)
                    np.add.at(scores[k], automaton.of[where], np.repeat(values, sizes))
                found.show(docs[at : rows.stop], none[at : rows.stop], scores)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.item), pa.array(found.doc, mask=found.none.astype(bool)), pa.array(found.score)], names=["item", "doc_id", "score"]
        )

    return work


def _top(rows: DataFrame, by: list[str], best: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = TERM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``best`` documents with a score above 0.

    A document's score for an item sums, over the item's distinct terms, the term's weight times its saturated frequency.
    Terms are counted in the texts themselves by a broadcast automaton whose patterns are terms between blanks; there is
    no index. Documents are read twice for each automaton: once for the documents that hold each term (one row a task and
    term), once for the scores, of which a task keeps ``best`` for each item. An automaton holds up to ``limit`` bytes of
    terms; more become several, dealt by item, so that neither a task nor a broadcast grows with the items. Only the
    terms of one item must fit into one.

    Null and blank texts have no terms and are not counted; items without terms have no rows. Rows of one item_id are one
    item with all their terms, null being an id. Each row of ``docs`` is a document, also where ids repeat; of equal scores
    null ids come last. An empty table on either side gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    words = F.explode(F.regexp_extract_all(F.translate(F.col(item_text), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    pairs = settle(items.select(F.col(item_id).alias("item_id"), words.alias("term")).distinct(), "terms")
    count = -(-(pairs.agg(F.sum(F.octet_length("term"))).first()[0] or 0) // limit) or 1
    kind = pairs.schema["item_id"].dataType
    found = []
    for i in range(count):
        block = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == i) if count > 1 else pairs
        of: dict[object, int] = {}
        sent = spark.sparkContext.broadcast(TermAutomaton.build([(of.setdefault(r["item_id"], len(of)), r["term"]) for r in block.toLocalIterator()]))
        held = narrow.select("text").mapInArrow(_counter(sent, "text"), "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
        seen = {r["term"]: r["held"] for r in held.toLocalIterator()}  # one row for each term of the automaton
        n_docs, n_words = seen.pop(-1, 0), seen.pop(-2, 0)
        weights = np.zeros(sent.value.n_terms, np.int64)
        for k, df in seen.items():
            weights[k] = weight(n_docs, df)
        scored = narrow.mapInArrow(_scorer(sent, weights, n_docs, n_words, best, "doc_id", "text"), "item long, doc_id long, score long")
        few = _top(scored.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))), ["item", "part"], best)
        ranked = _top(few.drop("rank"), ["item"], best)
        names = spark.createDataFrame([(k, v) for v, k in of.items()], f"item long, item_id {kind.simpleString()}")
        named = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found.append(settle(named, "ranked") if count > 1 else named)
        if count > 1:
            sent.unpersist()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n
  FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) SEMI JOIN i USING (term) GROUP BY r, term),
g AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, t GROUP BY term),
v AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))) AS value FROM f JOIN g USING (term), t),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(value)::BIGINT AS score FROM v JOIN i USING (term) GROUP BY item_id, r HAVING sum(value) > 0),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score FROM s)
SELECT * FROM k WHERE rank <= 10
"""
