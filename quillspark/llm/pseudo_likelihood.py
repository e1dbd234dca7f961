"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both its sides."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Settled, settle
from .words import HASH_BYTES, hashed_words, text_chunks

#: The network chooses a group, then a cell in it. The HEAD most frequent words have a cell each; the other words are
#: dealt to the remaining cells by hash. A cell is also what the network sees of a word.
GROUPS, MEMBERS, HEAD = 48, 48, 1_728
CELLS = GROUPS * MEMBERS
#: Words whose counts are sent to the tasks, the most frequent ones; the counts of all others are joined.
SENT = 1 << 17
#: Words on either side, sizes of an embedding and of the hidden layer.
SIDE, DIM, HIDDEN = 2, 12, 24
#: Every position of every document trains, in one of ROUNDS passes. A pass trains one network per shard of about
#: SHARD_WORDS words and averages them, MEAN_OF at a time.
ROUNDS, BATCH, RATE, SHARD_WORDS, MEAN_OF = 2, 8_192, 0.05, 4_000_000, 64
#: Windows scored at once.
FORWARD = 1 << 16


def cells_of(head: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Cells of words: ``head`` are the sorted hashes of the frequent ones, ``at`` their cells."""
    cells = HEAD + (hashes.view(np.int64) % (CELLS - HEAD))
    if len(head):
        place = np.minimum(np.searchsorted(head, hashes), len(head) - 1)
        cells = np.where(head[place] == hashes, at[place], cells)
    return cells


@dataclass
class Lexicon:
    """What the whole corpus says of words: cells, and the log-probability of a word inside its cell, by its count."""

    head: np.ndarray
    head_cell: np.ndarray
    known: np.ndarray
    log_count: np.ndarray
    log_mass: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, tail_mass: np.ndarray) -> Lexicon:
        """``hashes`` (unsigned) in order of falling counts; ``tail_mass`` sums the counts of all words of each tail cell."""
        n = min(HEAD, len(hashes))
        order, by_hash = np.argsort(hashes[:n]), np.argsort(hashes)
        mass = np.concatenate([counts[:n], np.zeros(HEAD - n), tail_mass])
        return cls(hashes[:n][order], order.astype(np.int64), hashes[by_hash], np.log(counts[by_hash]), np.log(np.maximum(mass, 1)))

    def encode(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, the log-probability inside the cell but for the counts of words that weren't sent, and which those are."""
        cells = cells_of(self.head, self.head_cell, hashes)
        inside = -self.log_mass[cells]
        if not len(self.known):
            return cells, inside, np.ones(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        rare = self.known[place] != hashes
        return cells, inside + np.where(rare, 0.0, self.log_count[place]), rare


@dataclass
class Network:
    """Embeddings of the 2 * SIDE words around a position, a tanh layer, softmaxes over groups and over a group's cells.

    The edge of a text has an embedding too.
    """

    table: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    u: np.ndarray
    c: np.ndarray

    @classmethod
    def start(cls, log_mass: np.ndarray | None = None, seed: int = 11) -> Network:
        """Random weights; the biases are those of the cells' frequencies."""
        r = np.random.default_rng(seed)
        make = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        mass = np.exp(log_mass if log_mass is not None else np.zeros(CELLS)).reshape(GROUPS, MEMBERS)
        return cls(
            (0.3 * r.standard_normal((CELLS + 1, DIM))).astype(np.float32), make(2 * SIDE * DIM, HIDDEN), np.zeros(HIDDEN, np.float32),
            0.1 * make(HIDDEN, GROUPS), np.log(mass.sum(1) / mass.sum()).astype(np.float32), 0.1 * make(GROUPS, HIDDEN, MEMBERS), np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32),
        )

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.table, self.w1, self.b1, self.w2, self.b2, self.u, self.c]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    def filled(self, flat: np.ndarray) -> Network:
        ends = np.cumsum([0, *(x.size for x in self.parts)])
        return Network(*(flat[a:b].reshape(x.shape).astype(np.float32) for a, b, x in zip(ends[:-1], ends[1:], self.parts, strict=True)))

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden layer and the log-probabilities of groups."""
        x = self.table[context].reshape(len(context), -1)
        h = np.tanh(x @ self.w1 + self.b1)
        return x, h, _log_softmax(h @ self.w2 + self.b2)

    def log_cells(self, context: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The log-probability of each position's cell given its context."""
        _, h, z = self.hidden(context)
        out = z[np.arange(len(cells)), cells // MEMBERS]
        for g, at in _by_group(cells):
            out[at] += _log_softmax(h[at] @ self.u[g] + self.c[g])[np.arange(len(at)), cells[at] % MEMBERS]
        return out

    def train(self, context: np.ndarray, cells: np.ndarray, memory: list[np.ndarray]) -> None:
        """One Adagrad step on the mean cross-entropy."""
        n = len(cells)
        x, h, logp = self.hidden(context)
        d = np.exp(logp)
        d[np.arange(n), cells // MEMBERS] -= 1
        d /= n
        back = d @ self.w2.T
        gu, gc = np.zeros_like(self.u), np.zeros_like(self.c)
        for g, at in _by_group(cells):
            inside = h[at]
            e = np.exp(_log_softmax(inside @ self.u[g] + self.c[g]))
            e[np.arange(len(at)), cells[at] % MEMBERS] -= 1
            e /= n
            back[at] += e @ self.u[g].T
            gu[g], gc[g] = inside.T @ e, e.sum(0)
        dh = back * (1 - h * h)
        dx = (dh @ self.w1.T).reshape(-1, DIM)
        flat = context.ravel()
        table = np.stack([np.bincount(flat, weights=dx[:, k], minlength=len(self.table)) for k in range(DIM)], axis=1).astype(np.float32)
        for p, grad, m in zip(self.parts, (table, x.T @ dh, dh.sum(0), h.T @ d, d.sum(0), gu, gc), memory, strict=True):
            m += grad * grad
            p -= RATE * grad / np.sqrt(m + 1e-8)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    """Of each row. One maximum for all rows is far quicker than each row's own; rows far below it get their own."""
    z = z - z.max()
    total = np.exp(z) @ np.ones((z.shape[1], 1), z.dtype)
    low = np.flatnonzero(total[:, 0] < 1e-20)
    if len(low):
        own = z[low] - z[low].max(1, keepdims=True)
        z[low], total[low] = own, np.exp(own).sum(1, keepdims=True)
    return z - np.log(total)


def _by_group(cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    groups = (cells // MEMBERS).astype(np.uint8)
    order = np.argsort(groups, kind="stable")
    ends = np.cumsum(np.bincount(groups, minlength=GROUPS))
    for g, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
        if b > a:
            yield g, order[a:b]


def _contexts(cells: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cells of the words around the positions ``at``, the edge's where the text ends."""
    out = np.full((len(at), 2 * SIDE), CELLS)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        place = at + step
        inside = (place >= 0) & (place < len(cells))
        inside[inside] = text[place[inside]] == text[at[inside]]
        out[inside, k] = cells[place[inside]]
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, limit=HASH_BYTES):
        words, n = np.unique(hashed_words(batch.column("text")).hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def word_counts(docs: DataFrame) -> Settled:
    """(word, n): every word of every document, by its hash, with its count."""
    return Settled(docs.select("text").mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def lexicon(counts: DataFrame, sent: int = SENT) -> Lexicon:
    """The ``sent`` most frequent words and the mass of each tail cell come to the driver; both are of fixed size."""
    top = counts.orderBy(F.desc("n"), "word").limit(sent).toArrow()
    words, n = top.column("word").to_numpy(), top.column("n").to_numpy().astype(np.float64)
    tail = CELLS - HEAD
    mass = np.zeros(tail)
    for row in counts.groupBy(F.pmod("word", F.lit(tail)).alias("cell")).agg(F.sum("n").alias("n")).collect():
        mass[row["cell"]] = row["n"]
    np.subtract.at(mass, words[:HEAD] % tail, n[:HEAD])
    return Lexicon.of(words.view(np.uint64), n, mass)


ENCODED = "doc_id long, h long, n_tokens int, cells array<int>, inside double, rare array<long>"


def encode(docs: DataFrame, words: Lexicon) -> DataFrame:
    """The cells of each document's words, the part of their log-probability inside the cells, and the words to be joined."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def ragged(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, limit=HASH_BYTES):
            found = hashed_words(batch.column("text"))
            cells, inside, rare = sent.value.encode(found.hashes)
            total, rest = np.concatenate([[0.0], np.cumsum(inside)]), np.concatenate([[0], np.cumsum(rare)])
            off = found.offsets
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(np.diff(off).astype(np.int32)), ragged(cells.astype(np.int32), off), pa.array(total[off[1:]] - total[off[:-1]]), ragged(found.hashes[rare].view(np.int64), rest[off])]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ENCODED.split(", ")])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", "doc_id").alias("h"), "text")
    return source.mapInArrow(work, ENCODED)


def training_positions(offsets: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The words that train in a round: in each text, one in ``rounds``; the rounds together take every word once."""
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
    return np.flatnonzero(place % rounds == turn)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


class _Trainer:
    """Trains one network on the texts of one shard, in their order, whatever batches they come in."""

    def __init__(self, network: Network, turn: int, rounds: int):
        self.network, self._turn, self._rounds = network.filled(network.flat().copy()), turn, rounds
        self._memory = [np.zeros_like(x) for x in self.network.parts]
        self.seen, self._held = 0, [np.zeros((0, 2 * SIDE), np.int64), np.zeros(0, np.int64)]

    def take(self, cells: np.ndarray, offsets: np.ndarray) -> None:
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = training_positions(offsets, self._turn, self._rounds)
        for a in range(0, len(at), FORWARD):
            part = at[a : a + FORWARD]
            self._held = [np.concatenate([self._held[0], _contexts(cells, text, part)]), np.concatenate([self._held[1], cells[part]])]
            full = len(self._held[1]) // BATCH * BATCH
            for b in range(0, full, BATCH):
                self._step(self._held[0][b : b + BATCH], self._held[1][b : b + BATCH])
            self._held = [x[full:] for x in self._held]

    def _step(self, context: np.ndarray, cells: np.ndarray) -> None:
        self.network.train(context, cells, self._memory)
        self.seen += len(cells)

    def row(self, shard: int) -> pa.RecordBatch:
        if len(self._held[1]):
            self._step(*self._held)
        return _weights(shard, self.network.flat(), float(self.seen))


WEIGHTS = "shard long, n double, weights array<float>"


def _weights(shard: int, flat: np.ndarray, n: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([n]), pa.array([flat.astype(np.float32)], pa.list_(pa.float32()))], ["shard", "n", "weights"])


def _training(sent, turn: int, rounds: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = trainer = None
        for batch in batches:
            shards = np.asarray(batch.column("shard"))
            cells, offsets = _texts(batch.column("cells"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if shards[a] != now:
                    if trainer is not None:
                        yield trainer.row(now)
                    now, trainer = int(shards[a]), _Trainer(sent.value, turn, rounds)
                trainer.take(cells[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        if trainer is not None:
            yield trainer.row(now)

    return work


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted mean of the networks of each ``shard``, added up in the order in which they come."""
    now = total = None
    n = 0.0
    for batch in batches:
        for shard, k, row in zip(batch.column("shard").to_pylist(), batch.column("n").to_pylist(), batch.column("weights"), strict=True):
            if shard != now:
                if n:
                    yield _weights(now, total / n, n)
                now, total, n = shard, 0.0, 0.0
            total, n = total + np.asarray(row.values, np.float64) * k, n + k
    if n:
        yield _weights(now, total / n, n)


def train(encoded: DataFrame, n_words: int, start: Network, rounds: int = ROUNDS, shard_words: int = SHARD_WORDS) -> Network:
    """Networks of all shards are trained from the same start; their weighted mean starts the next round.

    A document's shard depends on its id and text alone, and a shard's documents go by hash, so the result depends
    neither on the input's partitions nor on the cluster. The driver gets MEAN_OF networks at most.
    """
    spark, network = encoded.sparkSession, start
    count = max(1, math.ceil(n_words / shard_words))
    source = encoded.where("n_tokens > 0").select(F.pmod("h", F.lit(count)).alias("shard"), "h", "doc_id", "cells")
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(network)
        rows = source.repartition(count, "shard").sortWithinPartitions("shard", "h", "doc_id")
        found, left = Settled(rows.select("shard", "cells").mapInArrow(_training(sent, turn, rounds), WEIGHTS), "networks"), count
        while left > MEAN_OF:
            dealt = found.df.select(F.floor(F.col("shard") / MEAN_OF).alias("shard"), F.col("shard").alias("part"), "n", "weights")
            dealt = dealt.repartition("shard").sortWithinPartitions("shard", "part").select("shard", "n", "weights")
            found, before, left = Settled(dealt.mapInArrow(_means, WEIGHTS), "networks"), found, math.ceil(left / MEAN_OF)
            before.drop()
        last = sorted(found.df.collect(), key=lambda r: r["shard"])
        found.drop()
        if n := sum(r["n"] for r in last):
            network = network.filled(sum(np.asarray(r["weights"], np.float64) * r["n"] for r in last) / n)
    return network


def log_cells(network: Network, cells: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The log-probability of every word's cell given both its sides."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros(len(cells))
    for a in range(0, len(cells), FORWARD):
        at = np.arange(a, min(a + FORWARD, len(cells)))
        out[at] = network.log_cells(_contexts(cells, text, at), cells[at])
    return out


def score(encoded: DataFrame, counts: DataFrame, network: Network) -> DataFrame:
    """doc_id, n_tokens, sum_logprob, mean_logprob, perplexity; one row per row of ``encoded``, which is a written table."""
    sent = encoded.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, offsets = _texts(batch.column("cells"))
            total = np.concatenate([[0.0], np.cumsum(log_cells(sent.value, cells, offsets))])
            known = np.asarray(batch.column("inside")) + total[offsets[1:]] - total[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_tokens").cast(pa.int64()), pa.array(known)], ["row", "doc_id", "n_tokens", "known"])

    rows = encoded.select("row", "doc_id", "n_tokens", "inside", "cells").mapInArrow(work, "row long, doc_id long, n_tokens long, known double")
    rare = encoded.select("row", F.explode("rare").alias("word"))
    rest = rare.join(counts, "word").groupBy("row").agg(F.sum(F.log("n")).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, F.col("sum_logprob") / F.col("n_tokens"))
    scored = rows.join(rest, "row", "left").select("doc_id", "n_tokens", total.alias("sum_logprob"))
    return scored.select("*", mean.alias("mean_logprob"), F.exp(-mean).alias("perplexity"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Scores all documents by a network trained on every position of all of them.

    Tokens are lower-cased white-space words. The words around a token choose its group, and its cell in the group;
    inside a cell, which a frequent word has for itself, a word's probability is its share of the cell's count in the
    corpus. The sum of the logarithms over a document's tokens is its pseudo-log-likelihood. Null and empty texts have
    no token: sum 0, mean and perplexity null. Repeated rows are each scored. An empty table gives an empty result.
    Scores don't depend on how the input is partitioned.
    """
    counts = word_counts(docs)
    words = lexicon(counts.df)
    # The table is written once, so a row keeps its number when a task runs again.
    encoded = settle(encode(docs, words).withColumn("row", F.monotonically_increasing_id()), "encoded")
    total = counts.df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return score(encoded, counts.df, train(encoded, total, Network.start(words.log_mass)))
