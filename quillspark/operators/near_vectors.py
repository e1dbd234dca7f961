"""Near-duplicate vectors without all pairs: banded hyperplanes, or exactly by cells around pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import spread_join

#: Rows of a bucket of a band, or of a block of cells, that are held together; most pivots, each a row of the table, that are sent to the tasks.
PART, BLOCK, PIVOTS = 4096, 32_768, 1024
#: Signs that go along with each vector and are compared before it is, and vectors that are multiplied at once.
SKETCH, TILE = 128, 1024


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def banding(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bands, bits): bits as many as make chance meetings rare among n vectors, bands as many as a pair at the threshold needs.

    Two vectors agree on a random hyperplane with a probability of 1 - angle / pi.
    """
    bits = min(48, max(8, math.ceil(math.log2(max(n, 2)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree))) if agree < 1 else 1, bits


def apart(threshold: float, miss: float) -> int:
    """Signs of a sketch in which two vectors at the threshold differ at most, but for a probability of ``miss``."""
    p, rest = math.acos(threshold) / math.pi, 1.0
    for k in range(SKETCH):
        rest -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if rest <= miss:
            return k
    return SKETCH


def _banded(rows: DataFrame, dim: int, bands: int, bits: int, seed: int) -> DataFrame:
    """(id, s0, s1, key): each vector's sketch once for each band, under the signs of that band's hyperplanes; vectors stay behind."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((dim, bands * bits + SKETCH))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                signs = vectors_of(part.column("vec"), dim) @ planes > 0
                keys = pa.array(list(signs[:, :-SKETCH].reshape(part.num_rows, bands, bits) @ weights), pa.list_(pa.int64()))
                sketch = np.packbits(signs[:, -SKETCH:], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()), keys], names=["id", "s0", "s1", "keys"])

    keyed = rows.mapInArrow(work, "id long, s0 long, s1 long, keys array<long>").select("id", "s0", "s1", F.posexplode("keys").alias("band", "key"))
    return keyed.select("id", "s0", "s1", F.xxhash64("band", "key").alias("key"))


def _buckets(rows: DataFrame) -> DataFrame:
    """Rows sorted by bucket (key, cell). Those of over PART rows are cut into parts, and a row goes wherever its part meets another one."""
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("key", F.ceil(F.col("n") / PART).cast("int").alias("p"))
    dealt = rows.join(F.broadcast(large), "key", "left").withColumn("p", F.coalesce("p", F.lit(1)))
    mine = F.pmod(F.xxhash64("id"), F.col("p")).cast("int")
    to = F.explode(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda k: F.least(mine, k) * F.col("p") + F.greatest(mine, k))).alias("cell")
    return dealt.select("id", "s0", "s1", "key", to).repartition("key", "cell").sortWithinPartitions("key", "cell")


def _proposed(buckets: DataFrame, limit: int) -> DataFrame:
    """(a, b): each two vectors of a bucket whose sketches differ in ``limit`` signs at most."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        ids, key, cell, s0, s1 = (t.column(c).to_numpy() for c in ("id", "key", "cell", "s0", "s1"))
        s0, s1 = s0.view(np.uint64), s1.view(np.uint64)  # of a negative number, bits would be counted without its sign
        at, found, step = np.arange(len(ids)), [], 0
        while len(at):  # each row with the next one of its bucket, the one after that, and so on
            step += 1
            at = at[at + step < len(ids)]
            to = at + step
            same = (key[at] == key[to]) & (cell[at] == cell[to])
            at, to = at[same], to[same]
            near = np.bitwise_count(s0[at] ^ s0[to]) + np.bitwise_count(s1[at] ^ s1[to]).astype(np.int16) <= limit
            found.append(np.stack([ids[at[near]], ids[to[near]]]))
        a, b = np.concatenate([*found, np.zeros((2, 0), np.int64)], axis=1)
        return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            key, cell = rows.column("key").to_numpy(), rows.column("cell").to_numpy()
            last = np.flatnonzero((key != key[-1:]) | (cell != cell[-1:]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
            if cut:
                yield pairs(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield pairs(held)

    return buckets.mapInArrow(work, "a long, b long").distinct()


def _judged(pairs: DataFrame, single: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b, score) of the pairs whose vectors, which join them, are near."""
    sides = [single.select(F.col("id").alias(c), F.col("vec").alias(f"v{c}")) for c in "ab"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = vectors_of(batch.column("va"), dim), vectors_of(batch.column("vb"), dim)
            near, score = _scores(x, y, threshold)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(pa.array(near)), "b": batch.column("b").filter(pa.array(near)), "score": score[near]})

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "va", "vb").mapInArrow(work, "a long, b long, score double")


def _scores(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    score = np.minimum(1.0, (x * y).sum(1) / (np.sqrt((x**2).sum(1)) * np.sqrt((y**2).sum(1))))
    return score >= threshold, score


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1))[:, None]


def _squares(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T


def _blocks(rows: DataFrame, pivots: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count): the blocks of each pivot's cell. Cells near each other share a block of about ``size`` vectors, larger ones are several blocks."""
    dim = pivots.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _squares(_unit(vectors_of(batch.column("vec"), dim)), pivots).argmin(1)
            cell, n = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_pydict({"cell": cell, "n": n})

    held = np.zeros(len(pivots), np.int64)
    for r in rows.select("vec").mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # PIVOTS rows at most
        held[r["cell"]] = r["n"]
    first, count = np.zeros(len(pivots), np.int64), np.maximum(1, -(-held // size))
    left, at, block, filled = np.ones(len(pivots), bool), 0, 0, 0
    while left.any():
        at = int(np.where(left, ((pivots - pivots[at]) ** 2).sum(1), np.inf).argmin())  # from each cell to the nearest one that is left
        left[at] = False
        if filled and filled + held[at] > size:
            block, filled = block + 1, 0
        first[at] = block
        block, filled = (block, filled + held[at]) if count[at] == 1 else (block + count[at], 0)
    return first, count


def _celled(rows: DataFrame, pivots: np.ndarray, reach: float, first: np.ndarray, count: np.ndarray) -> DataFrame:
    """(id, vec, block, guest): each vector in a block of its nearest pivot, and as a guest in those before it that a vector within ``reach`` may be in.

    What is nearest to another pivot lies beyond the plane midway between the two, so a cell whose plane is farther away
    than ``reach`` holds nothing that is within reach.
    """
    dim = pivots.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = np.sqrt(np.maximum(0, ((pivots[:, None] - pivots[None]) ** 2).sum(2)))
        block = np.arange(int((first + count).max()))
        inside = ((first[:, None] <= block) & (block < (first + count)[:, None])).astype(np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                squares = _squares(_unit(vectors_of(part.column("vec"), dim)), pivots)
                own = squares.argmin(1)
                gap = squares - squares[np.arange(len(own)), own][:, None]
                met = (gap <= 2 * between[own] * (reach + 1e-9) + 1e-9).astype(np.float32) @ inside > 0
                ids = np.asarray(part.column("id")).astype(np.uint64)
                home = first[own] + ((ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % count[own])
                row, to = np.nonzero(met & (block < home[:, None]))
                row, to, guest = np.concatenate([np.arange(len(own)), row]), np.concatenate([home, to]), np.arange(len(own) + len(row)) >= len(own)
                for k in range(0, len(row), 8192):
                    held = part.take(pa.array(row[k : k + 8192]))
                    yield pa.RecordBatch.from_arrays([held.column("id"), held.column("vec"), pa.array(to[k : k + 8192].astype(np.int32)), pa.array(guest[k : k + 8192])], names=["id", "vec", "block", "guest"])

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.select("id", "vec").mapInArrow(work, f"id long, vec {kind}, block int, guest boolean")


def _matches(celled: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b, score) with a < b of each two vectors that are near. A block's own vectors are held, its guests stream past them."""
    margin = 1e-5 + 1e-6 * dim  # of products of floats, which name the pairs whose scores are then worked out

    def meet(ids, x, other_ids, y, among: bool) -> Iterator[pa.RecordBatch]:
        u, w = _unit(x).astype(np.float32), _unit(y).astype(np.float32)
        for i in range(0, len(x), TILE):
            for j in range(i if among else 0, len(y), 4 * TILE):
                near = u[i : i + TILE] @ w[j : j + 4 * TILE].T >= threshold - margin
                if not near.any():
                    continue
                r, c = np.nonzero(near)
                r, c = r + i, c + j
                if among:
                    r, c = r[r < c], c[r < c]
                close, score = _scores(x[r], y[c], threshold)
                a, b = ids[r[close]], other_ids[c[close]]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score[close]})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, own, whole = None, [], [], None
        for batch in batches:
            marks = np.asarray(batch.column("block")) * 2 + np.asarray(batch.column("guest").to_numpy(zero_copy_only=False), np.int64)
            cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1), len(marks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part, now, guest = batch.slice(a, b - a), int(marks[a]) // 2, bool(marks[a] % 2)
                if now != block:
                    if whole is None and own:
                        whole = np.concatenate(ids), np.concatenate(own)
                        yield from meet(*whole, *whole, True)
                    block, ids, own, whole = now, [], [], None
                x, names = vectors_of(part.column("vec"), dim), np.asarray(part.column("id"))
                if not guest:
                    ids.append(names)
                    own.append(x)
                    continue
                if whole is None:
                    whole = np.concatenate([*ids, names[:0]]), np.concatenate([*own, x[:0]])
                    yield from meet(*whole, *whole, True)
                yield from meet(names, x, *whole, False)
        if whole is None and own:
            whole = np.concatenate(ids), np.concatenate(own)
            yield from meet(*whole, *whole, True)

    sorted_ = celled.repartition("block").sortWithinPartitions("block", "guest")
    return sorted_.mapInArrow(work, "a long, b long, score double")


def _sound(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    kind = vectors.schema[vec_col].dataType.simpleString()
    vec = F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")  # floats take half the room, and are doubles where they are compared
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("vec", lambda x: x != 0))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, exact: bool = False, miss: float = 1e-4, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """(a, b, score): pairs of vectors with a cosine of at least ``threshold`` (over 0, under 1), a being the smaller id.

    Vectors that are alike are one: each copy is paired with the copy of the smallest id, with a score of 1, and only that
    one with others, so that a group of copies does not become all its pairs. By default a pair is compared if it shares
    one of some bands of random hyperplanes and their sketches, further signs, are alike enough; a pair at the threshold is missed with a
    probability of ``miss``, one that is nearer with less. ``exact`` compares by cells around pivots and misses none; it saves work where vectors lie in
    clusters, and little where they have no structure: then each block of cells meets half of all vectors, which stream past it.

    Null ids and vectors, vectors with nulls or values that aren't finite and zero vectors take no part; all vectors have
    one dimension, another one fails the query. Repeated rows are copies. An empty table has no pairs.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    rows = _sound(vectors, id_col, vec_col)
    single = rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    others = spread_join(rows.distinct(), single.where("n > 1").select("vec", F.col("id").alias("a")), "vec").where("id != a")
    star = others.select("a", F.col("id").alias("b"), F.lit(1.0).alias("score"))
    n, dim, least = single.agg(F.count("*"), F.max(F.size("vec")), F.min(F.size("vec"))).first()
    if dim != least:
        raise ValueError(f"vectors have {least} to {dim} dimensions")
    if n < 2:
        return star
    if exact:
        count = min(PIVOTS, max(2, math.isqrt(n)))
        chosen = [r["vec"] for r in single.orderBy(F.xxhash64("vec"), "id").limit(count).collect()]  # PIVOTS rows at most
        pivots = np.unique(np.array(chosen) / np.linalg.norm(chosen, axis=1)[:, None], axis=0)
        size = min(BLOCK, max(TILE, n // (4 * vectors.sparkSession.sparkContext.defaultParallelism)))
        found = _matches(_celled(single, pivots, math.sqrt(2 - 2 * threshold), *_blocks(single, pivots, size)), dim, threshold)
    else:
        bands = _banded(single.select("id", "vec"), dim, *banding(n, threshold, 0.9 * miss), seed)
        found = _judged(_proposed(_buckets(bands), apart(threshold, 0.1 * miss)), single, dim, threshold)
    return found.unionByName(star)
