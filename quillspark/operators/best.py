"""The best of each query, kept inside tasks: batches of scored rows are narrowed before anything is listed or shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that a task holds, queries of a block that meet a batch at once, and rows of a batch.
HELD, BLOCK, BATCH = 32_768, 256, 8_192
#: Scores that may be equal when rounded to 6 digits, or are summed in another order, differ by less.
MARGIN = 2e-6


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 digits, half away from zero in decimals, as Spark rounds."""
    scaled = np.abs(x) * 1e6
    out = np.sign(x) * (np.floor(scaled + 0.5) / 1e6) + 0.0
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


class Best:
    """The k best rows of each query by score, null scores (NaN) last, ties to the smaller id (the first column)."""

    def __init__(self, queries: int, k: int):
        self.k, self.q, self.score, self.rows = k, np.zeros(0, np.int64), np.zeros(0), None
        #: What a row must reach to come in: the last score of each full list.
        self.floor = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, rows: pa.Table) -> None:
        if not len(q):
            return
        q, score = np.concatenate([self.q, q]), np.concatenate([self.score, score])
        rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        ids = np.asarray(pc.rank(rows.column(0).combine_chunks(), "ascending", null_placement="at_start", tiebreaker="min"))
        order = np.lexsort((ids, np.where(np.isnan(score), np.inf, -score), q))
        sorted_q = q[order]
        nth = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
        order = order[nth < self.k]
        self.q, self.score, self.rows = q[order], score[order], rows.take(pa.array(order))
        last = nth[nth < self.k] == self.k - 1
        self.floor[self.q[last]] = np.where(np.isnan(self.score[last]), -np.inf, self.score[last])

    def batch(self, query_ids: pa.Array, name: str = "score") -> pa.Table | None:
        if self.rows is None:
            return None
        score = pa.array(self.score, mask=np.isnan(self.score))
        return self.rows.add_column(0, "query_id", query_ids.take(pa.array(self.q))).append_column(name, score)


class _Vectors:
    """Vectors as rows of one matrix, shorter ones filled up with zeros; ``null`` where a component is null."""

    def __init__(self, column: pa.Array):
        lengths = np.asarray(pc.list_value_length(column)).astype(np.int64)
        flat = column.flatten()
        missing = np.asarray(flat.is_null().to_numpy(zero_copy_only=False), bool)
        values = np.asarray(pc.fill_null(flat, 0) if flat.null_count else flat).astype(np.float64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.x = np.zeros((len(lengths), int(lengths.max(initial=0))))
        self.x[row, at] = values
        self.lengths, self.null = lengths, np.zeros(len(lengths), bool)
        self.null[row[missing]] = True
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = np.sqrt(sum((c * c for c in self.x.T), np.zeros(len(lengths))))
            self.wild = ~((self.norm == 0) | (self.norm > 1e-100) & (self.norm < 1e100))
            self.unit = np.where((self.wild | (self.norm == 0))[:, None], 0.0, self.x / np.where(self.norm == 0, 1.0, self.norm)[:, None])
        self.odd = bool(self.null.any() or self.wild.any() or len(set(lengths)) > 1)

    def widened(self, width: int) -> np.ndarray:
        return self.unit if self.unit.shape[1] == width else np.pad(self.unit, ((0, 0), (0, width - self.unit.shape[1])))


def _meet(best: Best, asked: _Vectors, part: slice, rows: _Vectors, held: pa.Table, k: int, threshold: float | None, same: np.ndarray | None, query_ids: np.ndarray) -> None:
    """A block of queries against a batch. A product of matrices names the candidates, whose scores are then summed in order."""
    width = max(asked.x.shape[1], rows.x.shape[1])
    near = asked.widened(width)[part] @ rows.widened(width).T
    odd = asked.odd or rows.odd or asked.x.shape[1] != rows.x.shape[1]
    none = wild = np.zeros((1, 1), bool)
    if odd:
        other = (asked.lengths[part][:, None] != rows.lengths) & (asked.norm[part][:, None] * rows.norm != 0)
        none = asked.null[part][:, None] | rows.null | other
        wild = ~none & (asked.wild[part][:, None] | rows.wild)
        near[none | wild] = -np.inf
    out = None if same is None else query_ids[part][:, None] == same
    if out is not None:
        near[out] = -np.inf
    n = near.shape[1]
    least = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -np.inf)
    least = np.maximum(least, best.floor[part]) - MARGIN
    if threshold is not None:
        least = np.maximum(least, threshold - MARGIN)
    wanted = near >= least[:, None]
    if odd:
        wanted |= wild
    if out is not None:
        wanted &= ~out
    q, r = np.nonzero(wanted)
    dot = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for a, b in zip(asked.x[part].T, rows.x.T, strict=False):
            dot += a[q] * b[r]
        size = asked.norm[part][q] * rows.norm[r]
        score = np.where(size == 0, 0.0, np.fmin(1.0, dot / size))
    score = rounded(score)
    if odd:
        score[np.broadcast_to(none, near.shape)[q, r]] = np.nan
    if threshold is not None:
        kept = score >= threshold
        q, r, score = q[kept], r[kept], score[kept]
    best.add(q + part.start, score, held.take(pa.array(r)))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding", more: tuple[str, ...] = (), itself: bool = True) -> DataFrame:
    """(query_id, id, ``more``, score) of the k best rows of each part of ``corpus`` for each query; the k best of all are among them.

    Scores are cosines rounded to 6 digits, ties go to the smaller id; only scores of at least ``threshold`` count. Rows are dealt to
    cells, to each of which the queries come first, HELD of them at most; then the rows stream past. Null vectors take
    no part, a zero vector scores 0, a null component or another number of components than the query's scores null. Without ``itself``
    a row doesn't meet the query of its own id.
    """
    spark = corpus.sparkSession
    parts, blocks = max(16, 4 * spark.sparkContext.defaultParallelism), max(1, -(-queries.count() // HELD))
    kind = dict((f.name, f.dataType) for f in corpus.schema)
    element = kind[vec_col].elementType.simpleString()
    vector = F.col(vec_col) if element in ("float", "double") else F.col(vec_col).cast("array<double>")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), *more, vector.alias("vec"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks)).withColumn("query_id", F.lit(None).cast("long"))
    asked = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast(f"array<{element if element in ('float', 'double') else 'double'}>").alias("vec"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "vec"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    columns = ["part", "block", "asks", "query_id", "id", *more, "vec"]
    both = asked.withColumn("asks", F.lit(0)).unionByName(rows.withColumn("asks", F.lit(1)), allowMissingColumns=True).select(columns)
    carried = ["id", *more]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in cells(batches):
            first = list(stream.of(0))
            if not first:
                for _ in stream.of(1):  # no query for these
                    pass
                continue
            ids = pa.concat_arrays([b.column("query_id") for b in first])
            vectors = _Vectors(pa.concat_arrays([b.column("vec") for b in first]))
            numbers = np.asarray(pc.fill_null(ids, 0))
            best = Best(len(ids), k)
            for batch in stream.of(1):
                batch = batch if itself else batch.filter(pc.is_valid(batch.column("id")))
                held = pa.Table.from_batches([batch.select(carried)])
                if not batch.num_rows:
                    continue
                found, same = _Vectors(batch.column("vec")), None if itself else np.asarray(batch.column("id"))
                for at in range(0, len(ids), BLOCK):
                    _meet(best, vectors, slice(at, min(at + BLOCK, len(ids))), found, held, k, threshold, same, numbers)
            out = best.batch(ids)
            if out is not None:
                yield from out.to_batches(max_chunksize=65_536)

    names = ", ".join(["query_id long", *(f"`{c}` {t.simpleString()}" for c, t in ((c, kind[id_col if c == "id" else c]) for c in carried)), "score double"])
    group = ["part", "block"]
    return both.repartition(*group).sortWithinPartitions(*group, "asks").mapInArrow(work, names)


class _Cell:
    def __init__(self, source: _Source, cell: tuple):
        self.source, self.cell = source, cell

    def of(self, asks: int) -> Iterator[pa.RecordBatch]:
        while self.source.head is not None and self.source.mark() == (*self.cell, asks):
            yield self.source.take()


class _Source:
    """Batches cut where (part, block, asks) changes, and to BATCH rows at most."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.cut = self._cut(batches)
        self.head = next(self.cut, None)

    @staticmethod
    def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([np.asarray(batch.column(c)) for c in ("part", "block", "asks")], 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(a, b, BATCH):
                    yield batch.slice(at, min(BATCH, b - at))

    def mark(self) -> tuple:
        return tuple(self.head.column(c)[0].as_py() for c in ("part", "block", "asks"))

    def take(self) -> pa.RecordBatch:
        batch, self.head = self.head, next(self.cut, None)
        return batch


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[_Cell]:
    """The cells (part, block) of sorted batches, inside which ``asks`` tells two kinds of rows apart; both are to be read, 0 first."""
    source = _Source(batches)
    while source.head is not None:
        yield _Cell(source, source.mark()[:2])
