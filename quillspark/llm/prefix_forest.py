"""Approximate nearest neighbours with a hash-prefix forest: one sorted array of long hash strings per tree."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import settle

NEIGHBOURS = 10
#: Trees, and bits of a hash string.
TREES, BITS = 256, 32
#: A query stops going up once a vector as near as its k-th found is missed by all trees with this probability at most.
MISS = 0.1
#: Most distinct vectors of a shard, whose forest one task holds; queries that meet it in one go, in parts of QUERY_PART.
SHARD_ROWS, BLOCK_QUERIES, QUERY_PART = 32_768, 65_536, 256
#: Most vectors on which the centre of the hashes is fitted.
FIT_ROWS = 4_096


@dataclass
class Hashes:
    """Bit b of tree t: on which side of a random hyperplane through the centre a vector lies."""

    centre: np.ndarray
    trees: int = TREES
    bits: int = BITS
    seed: int = 7

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, n): the hash strings as integers, first bit highest."""
        planes = np.random.default_rng(self.seed).standard_normal((self.trees, self.bits, len(self.centre))).astype(np.float32)
        moved, weights = (vectors - self.centre).astype(np.float32), 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return np.stack([(moved @ tree.T > 0) @ weights for tree in planes])


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the vector ``a`` and the rows of ``b``."""
    size = np.linalg.norm(a) * np.linalg.norm(b, axis=1)
    return np.arccos(np.clip(np.divide(b @ a, size, out=np.ones(len(b)), where=size > 0), -1, 1))


class Forest:
    """One sorted array of hash strings per tree over the same vectors."""

    def __init__(self, vectors: np.ndarray, hashes: Hashes):
        self.vectors, self.hashes = vectors, hashes
        strings = hashes.strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, axis=1)
        self.met = 0

    def longest(self, strings: np.ndarray) -> np.ndarray:
        """(trees, queries): bits of the longest prefix that a query's string shares with one of the tree's."""
        best = np.zeros(strings.shape, np.int64)
        for t, (mine, asked) in enumerate(zip(self.sorted, strings, strict=True)):
            at = np.searchsorted(mine, asked)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(mine) - 1)):
                apart = np.frexp((mine[near] ^ asked).astype(np.float64))[1]  # the bits from the first one that differs
                best[t] = np.maximum(best[t], self.hashes.bits - apart)
        return best

    def search(self, queries: np.ndarray, k: int, miss: float = MISS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (indexes of the vectors met, distances).

        All trees go down to their longest matches and then up together, one bit at a time. A vector under the angle of
        the k-th nearest met so far is in a tree's range of ``level`` bits with a probability of p ** level, p the one
        that a hyperplane doesn't part them; the query stops where all trees miss it with a probability of ``miss`` at
        most. At level 0 it has met everything.
        """
        strings = self.hashes.strings(queries)
        longest = self.longest(strings)
        seen = np.zeros((len(queries), len(self.vectors)), bool)
        found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        active = np.arange(len(queries))
        trees, n = self.order.shape
        for level in range(int(longest.max(initial=0)), -1, -1):
            there = longest[:, active] >= level
            if not len(active) or not there.any():
                continue
            free = self.hashes.bits - level
            low, high = np.zeros(there.shape, np.int64), np.zeros(there.shape, np.int64)
            for t in np.flatnonzero(there.any(axis=1)):
                prefix = strings[t, active[there[t]]] >> free
                low[t, there[t]] = np.searchsorted(self.sorted[t], prefix << free)
                high[t, there[t]] = np.searchsorted(self.sorted[t], (prefix + 1) << free)
            done = np.zeros(len(active), bool)
            for i, q in enumerate(active.tolist()):
                new = self._new(seen[q], low[:, i], high[:, i], n)
                if len(new):
                    near = np.concatenate([found[q][0], new])
                    score = np.concatenate([found[q][1], np.sqrt(((self.vectors[new] - queries[q]) ** 2).sum(axis=1))])
                    found[q] = near, score
                done[i] = len(found[q][0]) >= k and self._enough(queries[q], *found[q], k, level, trees, miss)
            active = active[~done]
        self.met += int(seen.sum())
        yield from found

    def _new(self, seen: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
        """The vectors of a query's ranges that it hasn't met; now it has."""
        size = high - low
        if (total := int(size.sum())) >= 4 * n:  # meetings so many that the whole shard is sooner gone through
            new = np.flatnonzero(~seen)
        else:
            at = np.repeat(np.arange(len(size)) * n + low - np.cumsum(size) + size, size) + np.arange(total)
            met = np.zeros(n, bool)
            met[self.order.ravel()[at]] = True
            new = np.flatnonzero(met & ~seen)
        seen[new] = True
        return new

    def _enough(self, query: np.ndarray, near: np.ndarray, score: np.ndarray, k: int, level: int, trees: int, miss: float) -> bool:
        best = near[np.argpartition(score, k - 1)[:k]]
        widest = _angles(query - self.hashes.centre, self.vectors[best] - self.hashes.centre).max()
        return (1 - (1 - widest / np.pi) ** level) ** trees <= miss


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of vectors that take part: not null or empty, all finite, not all zero."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("embedding")).where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull())


def _answers(hashes: dict[int, Hashes], k: int, miss: float, part: int):
    """Per cell, its index rows come first, then its queries, which stream past the forest."""

    def answer(forest: Forest | None, ids: list, asks: np.ndarray, names: list) -> pa.RecordBatch:
        out = []
        if forest is not None:
            for a in range(0, len(asks), part):
                # A query's own row and rows of its id aren't reported, so one more is looked for.
                for query_id, (near, score) in zip(names[a : a + part], forest.search(asks[a : a + part], min(k + 1, len(forest.vectors)), miss), strict=True):
                    within = score <= (np.partition(score, k)[k] if len(score) > k + 1 else np.inf)
                    found = sorted((s, i) for s, at in zip(score[within].tolist(), near[within].tolist(), strict=True) for i in ids[at] if i != query_id)
                    out += [(query_id, i, s) for s, i in found[:k]]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, vectors, ids, forest = None, [], [], None
        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "block", "asks")), strict=True))
            cuts = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1]), len(cells)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                rows = np.asarray(batch.column("embedding").slice(a, b - a).flatten()).reshape(b - a, cells[a][0])
                if cells[a][:3] != cell:
                    cell, vectors, ids, forest = cells[a][:3], [], [], None
                if not cells[a][3]:
                    vectors.append(rows)
                    ids += batch.column("ids").slice(a, b - a).to_pylist()
                    continue
                if vectors:
                    forest, vectors = Forest(np.concatenate(vectors), hashes[cells[a][0]]), []
                yield answer(forest, ids, rows, batch.column("query_id").slice(a, b - a).to_pylist())

    return work


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, miss: float = MISS, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``is_query`` (a Column on vec_id) holds.

    Euclidean distance in double precision, nearest first, ties to the smaller vec_id; a row isn't its own neighbour,
    rows with equal vectors are each other's at distance 0. Of equal vectors one is indexed, with the k + 1 smallest
    ids, more than which no query can need. Distinct vectors are dealt by hash to shards of about ``shard_rows``; a
    shard's forest is built once for ``block_queries`` queries, which stream past it, so the work is that of the stated
    query set against all rows. Null ids and vectors that are null, empty, zero or not finite take no part; vectors of
    other dimensions are no candidates. An id that repeats with different vectors has each of its rows; a neighbour of
    the same id is never reported. The centre of the hashes is fitted on at most FIT_ROWS vectors. An empty table gives
    an empty result. Other columns are ignored.
    """
    rows = usable(vectors, id_col, vec_col).withColumn("vh", F.xxhash64("embedding"))
    first = W.partitionBy("vh", "embedding").orderBy("vec_id")
    alike = rows.distinct().withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    classes = settle(alike.groupBy("vh", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("embedding")), "vectors")
    asked = settle(rows.where(is_query).distinct().select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("dim")), "queries")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).toLocalIterator()}
    hashes = {}
    for dim in sizes:
        sample = classes.where(F.col("dim") == dim).orderBy("vh").limit(FIT_ROWS).select("embedding").collect()
        hashes[dim] = Hashes(np.array([r[0] for r in sample], np.float64).mean(axis=0), trees)
    blocks = max(1, math.ceil(asked.count() / block_queries))
    counts = {d: max(1, math.ceil(n / shard_rows)) for d, n in (sizes or {0: 0}).items()}
    shards = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    index = classes.select("dim", F.pmod("vh", shards[F.col("dim")]).cast("int").alias("shard"), each_block, F.lit(False).alias("asks"), F.lit(None).cast("long").alias("query_id"), "embedding", "ids")
    each_shard = F.explode(F.sequence(F.lit(0), shards[F.col("dim")] - 1)).alias("shard")
    queries = asked.where(shards[F.col("dim")].isNotNull()).select("dim", each_shard, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), "query_id", "embedding", F.lit(None).cast("array<long>").alias("ids"))
    cells = blocks * sum(counts.values())
    met = index.unionByName(queries).repartition(cells, "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "asks")
    found = met.mapInArrow(_answers(hashes, k, miss, QUERY_PART), "query_id long, vec_id long, score double")
    ranked = found.distinct().withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
