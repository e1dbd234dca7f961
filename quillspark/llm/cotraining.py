"""Quality classifier by co-training: a view of the text and a view of the page's metadata teach each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle
from .words import HASH_BYTES, hashed_words, text_chunks

#: Most labelled documents to fit and calibrate on; every unlabelled document takes part in the exchange.
LABELLED = 4_000
#: Rounds of exchange; the share of all documents that a view may label in a round; its least confidence; steps of a refit.
ROUNDS, STEP, CONFIDENCE, REFIT = 3, 0.1, 0.95, 5
#: Held-out rows on which a view has to be right at its least confidence before it labels.
PROOF = 5
#: Bins of the histogram of log-odds above the least confidence, and their width.
BINS, BIN = 400, 0.05
#: Documents scored below this are rejected.
THRESHOLD = 0.5
HASHED, META_HASHED = 256, 64

UPPER = np.isin(np.arange(256), np.arange(65, 91)).astype(np.float64)
LETTER = (np.isin(np.arange(256), np.r_[65:91, 97:123]) | (np.arange(256) >= 128)).astype(np.float64)
DIGIT = np.isin(np.arange(256), np.arange(48, 58)).astype(np.float64)
STOP = np.isin(np.arange(256), [33, 46, 63]).astype(np.float64)
N_TEXT = 14
#: Features of texts are kept in a table in this type.
STORED = np.float16


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_view(texts: pa.Array) -> np.ndarray:
    """Shape and word features of whole texts, (n, N_TEXT + HASHED); the row of a text without words is 0 but for a flag."""
    found = hashed_words(texts)
    n, at, words, count = len(texts), found.text_of_word, found.hashes, np.maximum(found.lengths, 1)
    edges = np.searchsorted(found.begin, found.begin)  # words are in order of their bytes
    begin, end, off = found.begin, found.end, found.offsets
    per_word = {}
    for name, table in (("upper", UPPER), ("letter", LETTER), ("digit", DIGIT)):
        total = np.concatenate([[0.0], np.cumsum(table[found.data])])
        per_word[name] = total[end] - total[begin]
    size = (end - begin).astype(np.float64)
    chars = np.maximum(_row_sums(size, off), 1)
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (at[1:] == at[:-1])
    order = np.lexsort((words, at)) if len(words) else edges
    fresh = np.ones(len(words))
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (at[order][1:] != at[order][:-1])
    symbols = size - per_word["letter"] - per_word["digit"]
    last = found.data[end - 1] if len(end) else np.zeros(0, np.uint8)
    lines = np.zeros(n)
    np.maximum.at(lines, at, found.line + 1.0)
    rows = [
        (found.lengths == 0).astype(float), np.log1p(found.lengths) / 10, _row_sums(size, off) / count / 10,
        _row_sums(per_word["upper"], off) / chars, _row_sums(per_word["digit"], off) / chars, _row_sums(symbols, off) / chars,
        _row_sums((symbols > 1).astype(float), off) / count, _row_sums((symbols == size).astype(float), off) / count,
        _row_sums((per_word["upper"] == np.maximum(per_word["letter"], 1)).astype(float), off) / count,
        _row_sums(fresh, off) / count, _row_sums(same, off) / count, _row_sums(STOP[last], off) / count,
        lines / count, _row_sums((size > 20).astype(float), off) / count,
    ]
    hashed = np.bincount(at * HASHED + (words % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    return np.concatenate([np.stack(rows, axis=1), np.sqrt(hashed / count[:, None])], axis=1).astype(STORED)


def meta_view(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Language and source by hash, the declared length by its logarithm; nulls have flags of their own."""
    n = len(lang)
    out = np.zeros((n, 2 * META_HASHED + 27))
    for k, column in enumerate((lang, source)):
        names = column.dictionary_encode()
        places = [int(hashed_words(pa.array([x.replace(" ", "_")])).hashes[:1].sum()) % META_HASHED if x else 0 for x in names.dictionary.to_pylist()]
        at = np.flatnonzero(np.asarray(column.is_valid()))
        out[at, k * META_HASHED + np.array(places, np.int64)[np.asarray(names.indices.drop_null())]] = 1
    size = np.asarray(pc.fill_null(n_chars.cast(pa.float64()), -1.0))
    bucket = np.where(size < 0, 0, 1 + np.minimum(24, np.log2(np.maximum(size, 0) + 1).astype(int)))
    out[np.arange(n), 2 * META_HASHED + bucket] = 1
    out[:, -1] = np.log1p(np.maximum(size, 0)) / 10
    return out


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def start(cls, mean: np.ndarray, scale: np.ndarray) -> Logistic:
        return cls(mean, scale, np.zeros(len(mean) + 1))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = self.standard(x)
        return z.T @ (_sigmoid(z @ self.weights) - y)

    def penalty(self, ridge: float = 3.0) -> np.ndarray:
        return np.append(np.full(len(self.mean), ridge), 1e-3)

    def hessian(self, x: np.ndarray, ridge: float = 3.0) -> np.ndarray:
        z = self.standard(x)
        p = _sigmoid(z @ self.weights)
        return (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(self.penalty(ridge))

    def moved(self, by: np.ndarray) -> Logistic:
        return Logistic(self.mean, self.scale, self.weights - by)

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 12) -> Logistic:
        now = self
        for _ in range(steps):
            move = np.linalg.solve(now.hessian(x, ridge), now.gradient(x, y) + now.penalty(ridge) * now.weights)
            now = now.moved(move)
            if np.abs(move).max() < 1e-5:
                break
        return now


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Calibrated:
    """A model whose log-odds are fitted again on rows that it hasn't seen, so that its confidence can be believed."""

    model: Logistic
    slope: float
    offset: float

    @classmethod
    def fit(cls, model: Logistic, x: np.ndarray, y: np.ndarray) -> Calibrated:
        """A view that orders the rows the wrong way round says nothing but the prior."""
        line = Logistic.start(np.zeros(1), np.ones(1)).fit(model.logit(x)[:, None], y, ridge=0.5)
        slope, offset = line.weights
        return cls(model, slope, offset) if slope > 0 else cls(model, 0.0, float(np.log(y.mean() / (1 - y.mean()))))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.model.logit(x) + self.offset


def moments(text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Number of rows, sums and sums of squares of both views."""
    return np.concatenate([[len(text)], text.sum(0), (text * text).sum(0), meta.sum(0), (meta * meta).sum(0)])


@dataclass
class Exchange:
    """The rounds so far: the models of a round and, of each view and label, the least log-odds at which it labels.

    What a document has been taught as follows from the rounds, so no table of pseudo-labels is kept.
    """

    rounds: list[tuple[list[Calibrated], np.ndarray]]

    def taken(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(2, n) the label that each view learns (-1: none) and which documents no view has labelled.

        A view's label teaches the other view. Where both are sure and disagree, neither counts in that round.
        """
        learnt, free = np.full((2, len(text)), -1), np.ones(len(text), bool)
        for models, edges in self.rounds:
            said = []
            for k, x in enumerate((text, meta)):
                z = models[k].logit(x)
                said.append(np.where(z >= edges[k, 1], 1, np.where(-z >= edges[k, 0], 0, -1)))
            use = free & ~((said[0] >= 0) & (said[1] >= 0) & (said[0] != said[1]))
            for k in (0, 1):
                at = use & (said[k] >= 0)
                learnt[1 - k, at] = said[k][at]
                free &= ~at
        return learnt, free

    def histogram(self, models: list[Calibrated], text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Of each view and label, free documents by how far their log-odds exceed the least confidence."""
        _, free = self.taken(text, meta)
        out = np.zeros((2, 2, BINS))
        for k, x in enumerate((text[free], meta[free])):
            z = models[k].logit(x)
            for label, sure in ((0, -z), (1, z)):
                bins = (sure[sure >= SURE] - SURE) / BIN
                out[k, label] = np.bincount(np.minimum(bins, BINS - 1).astype(np.int64), minlength=BINS)
        return out.ravel()

    def gradients(self, models: list[Logistic], text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Of each view, the number of documents that it learns and the gradient over them."""
        learnt, _ = self.taken(text, meta)
        out = []
        for k, x in enumerate((text, meta)):
            at = learnt[k] >= 0
            out += [[at.sum()], models[k].gradient(x[at], learnt[k][at])]
        return np.concatenate(out)


SURE = float(np.log(CONFIDENCE / (1 - CONFIDENCE)))


def proven(sure: np.ndarray, right: np.ndarray) -> float:
    """The least log-odds above which a view is right on held-out rows as often as it has to be, infinite without PROOF of them."""
    order = np.argsort(-sure, kind="stable")
    sure, hits = sure[order], np.cumsum(right[order])
    n = np.arange(1, len(sure) + 1)
    good = np.flatnonzero((hits >= CONFIDENCE * n) & (n >= PROOF) & (sure >= SURE))
    return float(sure[good[-1]]) if len(good) else np.inf


def edge(counts: np.ndarray, most: float, least: float = SURE) -> float:
    """The least log-odds so that about ``most`` documents are labelled; whole bins are, the highest in any case."""
    if least == np.inf or not counts.any():
        return np.inf
    counts = np.where(np.arange(BINS) * BIN + SURE >= least - BIN, counts, 0)
    if not counts.any():
        return np.inf
    above = np.cumsum(counts[::-1])[::-1]
    low = min(int(np.argmax(above <= most)) if (above <= most).any() else BINS, int(np.flatnonzero(counts).max()))
    return max(least, SURE + BIN * low)


@dataclass
class CoTrained:
    text: Calibrated
    meta: Calibrated
    prior: float

    @classmethod
    def fit(cls, text: np.ndarray, meta: np.ndarray, y: np.ndarray, over_pool: Callable[[Callable], np.ndarray], rounds: int = ROUNDS) -> CoTrained | None:
        """None unless both classes are there. Every fifth labelled row calibrates, in each round, and is never trained on.

        ``over_pool(f)`` sums f(text view, meta view) over all unlabelled documents. In a refit the pseudo-labelled ones
        weigh as much as the labelled ones at most; the steps are scaled by the curvature of the labelled ones.
        """
        if len(y) < 10 or not 0 < y.mean() < 1:
            return None
        held = np.arange(len(y)) % 5 == 4
        if not 0 < y[held].mean() < 1 or not 0 < y[~held].mean() < 1:
            held = np.zeros(len(y), bool)
        views, own = (text.astype(np.float64), meta.astype(np.float64)), y[~held]
        sums = over_pool(moments) + moments(*views)
        n, parts = sums[0], np.split(sums[1:], np.cumsum([text.shape[1], text.shape[1], meta.shape[1]]))
        start = [Logistic.start(a / n, np.sqrt(np.maximum(b / n - (a / n) ** 2, 0)) + 1e-3) for a, b in (parts[:2], parts[2:])]
        models = [m.fit(v[~held], own) for m, v in zip(start, views, strict=True)]
        exchange, rows = Exchange([]), held if held.any() else ~held
        calibrated = lambda: [Calibrated.fit(m, v[rows], y[rows]) for m, v in zip(models, views, strict=True)]
        for _ in range(rounds if n > len(y) else 0):
            said = calibrated()
            counts = over_pool(partial(exchange.histogram, said)).reshape(2, 2, BINS)
            if not counts.any():
                break
            most = [STEP * (n - len(y)) * share for share in (1 - y.mean(), y.mean())]
            least = [[proven(np.where(c, 1, -1) * m.logit(v[rows]), y[rows] == c) for c in (0, 1)] for m, v in zip(said, views, strict=True)]
            edges = np.array([[edge(counts[k, c], most[c], least[k][c]) for c in (0, 1)] for k in (0, 1)])
            exchange = Exchange([*exchange.rounds, (said, edges)])
            curves = [m.hessian(v[~held]) for m, v in zip(models, views, strict=True)]
            for _ in range(REFIT):
                found = np.split(over_pool(partial(exchange.gradients, models)), [1, text.shape[1] + 2, text.shape[1] + 3])
                for k in (0, 1):
                    taught, gradient = found[2 * k][0], found[2 * k + 1]
                    weight = min(1.0, len(own) / taught) if taught else 0.0
                    whole = models[k].gradient(views[k][~held], own) + weight * gradient + models[k].penalty() * models[k].weights
                    models = [m.moved(np.linalg.solve(curves[k], whole) / (1 + weight * taught / len(own))) if i == k else m for i, m in enumerate(models)]
        return cls(*calibrated(), float(np.log(y.mean() / (1 - y.mean()))))

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the views, and of both: their log-odds add up, the prior counts once."""
        a, b = self.text.logit(text), self.meta.logit(meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def _scores(model: CoTrained, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scores of rows; that of a text without words is 0."""
    a, b, both = model.scores(text, meta)
    return a, b, np.where(text[:, 0] > 0, 0.0, both)


VIEWS = "doc_id long, th long, text_view binary, lang string, source string, size double"
N_VIEW = N_TEXT + HASHED


def views(docs: DataFrame) -> DataFrame:
    """The features of each whole text, and what the view of the metadata is made from; one row per row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, limit=HASH_BYTES):
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(N_VIEW * 2), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(text_view(batch.column("text"))))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "th")), rows.cast(pa.binary()), *(batch.column(c) for c in ("lang", "source", "size"))], [f.split()[0] for f in VIEWS.split(", ")])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text", *_metadata())
    return source.mapInArrow(work, VIEWS)


def _metadata(prefix: str = "") -> list:
    return [F.col("lang").cast("string").alias(f"{prefix}lang"), F.col("source").cast("string").alias(f"{prefix}source"), F.col("n_chars").cast("double").alias(f"{prefix}size")]


def _both(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows of the table of views."""
    text = batch.column("text_view")
    flat = np.frombuffer(b"".join(text.to_pylist()), STORED).reshape(batch.num_rows, N_VIEW)
    return flat.astype(np.float64), meta_view(*(batch.column(c) for c in ("lang", "source", "size")))


def _over(table: DataFrame, labelled: np.ndarray) -> Callable[[Callable], np.ndarray]:
    """Sums vectors over all rows of the table of views but those of the labelled ids. Each task gives one vector."""
    spark = table.sparkSession
    ids = spark.sparkContext.broadcast(labelled)

    def over(f: Callable) -> np.ndarray:
        sent = spark.sparkContext.broadcast(f)
        size = len(f(np.zeros((0, N_VIEW)), np.zeros((0, 2 * META_HASHED + 27))))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                known = pc.is_in(batch.column("doc_id"), value_set=pa.array(ids.value, pa.int64()))
                batch = batch.filter(pc.invert(known))
                for at in range(0, batch.num_rows, 4_096):
                    total += sent.value(*_both(batch.slice(at, 4_096)))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "value"])

        found = table.mapInArrow(work, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(size)
        out[found.column("at").to_numpy()] = found.column("value").to_numpy()
        return out

    return over


def train(table: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoTrained | None:
    """A model fitted on at most ``labelled`` labelled documents, those of the smallest id hash, and on all unlabelled ones.

    ``table`` is a written table of ``views``. A document with several labels takes the majority, a draw is 1; labels
    other than 0 and 1 and null ids are left out, as are labels without a document. Of rows that repeat a labelled id
    that of the smallest text hash is used. The other documents, those of labels beyond the bound too, are unlabelled.
    """
    truth = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    there = truth.join(table.select("doc_id"), "doc_id", "left_semi")
    chosen = settle(there.orderBy(F.xxhash64("doc_id", F.lit("co-training")), "doc_id").limit(labelled), "labelled")
    # No more than ``labelled`` rows of two numbers.
    rows = table.join(F.broadcast(chosen), "doc_id")
    least = rows.groupBy("doc_id", "y").agg(F.min(F.struct("th", "lang", "source", "size", "text_view")).alias("least"))
    got = least.select("doc_id", "y", "least.*").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return None
    text, meta = _both(got.to_batches()[0])
    return CoTrained.fit(text, meta, got.column("y").to_numpy(), _over(table, got.column("doc_id").to_numpy()))


TEXT_SCORE, META_SCORE, SCORE = (f"__qs_{x}" for x in ("text_score", "meta_score", "score"))


def _scored(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """``docs`` with the three scores, under names of our own."""
    none = F.lit(None).cast("double")
    if model is None:
        return docs.select("*", *(none.alias(c) for c in (TEXT_SCORE, META_SCORE, SCORE)))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    full = docs.select("*", *_metadata("__qs_"), *(none.alias(c) for c in (TEXT_SCORE, META_SCORE, SCORE)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, limit=HASH_BYTES):
            text, meta = text_view(batch.column("text")), meta_view(*(batch.column(f"__qs_{c}") for c in ("lang", "source", "size")))
            new = dict(zip((TEXT_SCORE, META_SCORE, SCORE), _scores(sent.value, text.astype(np.float64), meta), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(new[n]) if n in new else batch.column(n) for n in batch.schema.names], schema=batch.schema)

    return full.mapInArrow(work, full.schema).drop("__qs_lang", "__qs_source", "__qs_size")


def score(docs: DataFrame, model: CoTrained | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with text_score, meta_score, score and keep; columns of those names are replaced.

    Every whole text is scored. Without a model scores are null and every row is kept. A null text counts as empty; a
    text without words scores 0.
    """
    found = _scored(docs.drop("text_score", "meta_score", "score", "keep"), model)
    named = found.withColumnsRenamed({TEXT_SCORE: "text_score", META_SCORE: "meta_score", SCORE: "score"})
    return named.withColumn("keep", F.coalesce(F.col("score") >= threshold, F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep: one row per row of ``docs``.

    Null ids and texts, repeated rows and ids are scored like any other; an empty table gives an empty result. Without
    labels of both classes the scores are null and every row is kept.
    """
    table = settle(views(docs), "views")
    model = train(table, labels)
    names = ("text_score", "meta_score", "score")
    if model is None:
        return table.select("doc_id", *(F.lit(None).cast("double").alias(c) for c in names), F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, _scores(sent.value, *_both(part)))], ["doc_id", *names])

    found = table.mapInArrow(work, "doc_id long, text_score double, meta_score double, score double")
    return found.withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns as they are.

    Texts without words are rejected. Rows that repeat stay or go together; without labels of both classes all stay.
    """
    model = train(settle(views(docs), "views"), labels)
    return _scored(docs, model).where(F.coalesce(F.col(SCORE) >= threshold, F.lit(True))).select(*docs.columns)
