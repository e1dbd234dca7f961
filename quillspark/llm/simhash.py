"""SimHash near-duplicates with BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .rows import ROW, keep_least, row_key
from .scratch import settle
from .words import as_strings, text_chunks

SHINGLE = 4
RADIUS = 4
#: A pair within RADIUS bits agrees on at least two of six blocks, so it meets in one of the fifteen shards of two blocks.
BLOCKS = 6
#: Most fingerprints of one tree; a larger shard becomes several trees, each searched by all of the shard.
TREE_LIMIT = 20_000
#: Pairs of query and tree node held at once in a task.
FRONTIER = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of word shingles; a text without words has 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n]
    ends = ends[-n:]
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        h = np.array([digest(flat[a:b], 42) for a, b in spans], np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *also: str) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``, fp the fingerprint as a signed long. A null text counts as an empty one.

    ``also`` names columns of longs that are passed on.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            fps = np.array([fingerprint(x) for x in as_strings(batch.column("text")).to_pylist()], np.uint64)
            passed = [batch.column(c) for c in ("doc_id", *also)]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(fps.view(np.int64))], ["doc_id", *also, "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *also, F.col(text_col).alias("text"))
    return source.mapInArrow(work, ", ".join(f"{c} long" for c in ("doc_id", *also, "fp")))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


class BkForest:
    """BK-trees of many shards, built and searched level by level for all of them at once.

    ``keys`` names the shard of each fingerprint; a node's children are keyed by their Hamming distance to it.
    """

    def __init__(self, keys: np.ndarray, fps: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.fps, self.keys = fps[order], keys[order]
        self.shards, first = np.unique(self.keys, return_index=True)
        self.roots = first
        at = np.repeat(first, np.diff(np.append(first, len(fps))))
        left = np.setdiff1d(np.arange(len(fps)), first, assume_unique=True)
        labels, nodes = [], []
        while len(left):
            edge = at[left] * 65 + _distance(self.fps[left], self.fps[at[left]])
            found, index, back = np.unique(edge, return_index=True, return_inverse=True)
            labels.append(found)
            nodes.append(left[index])
            at[left] = left[index][back]
            left = np.delete(left, index)
        labels, nodes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (labels, nodes))
        order = np.argsort(labels)
        self.edges, self.children = labels[order], nodes[order]

    def search(self, keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of indexes (query, node) within the radius, in parts; only edges within the radius are followed."""
        place = np.searchsorted(self.shards, keys)
        known = np.flatnonzero((place < len(self.shards)) & (self.shards[np.minimum(place, len(self.shards) - 1)] == keys)) if len(self.shards) else np.zeros(0, np.int64)
        todo = [(known[i : i + FRONTIER // 8], self.roots[place[known[i : i + FRONTIER // 8]]]) for i in range(0, len(known), FRONTIER // 8)]
        while todo:
            query, node = todo.pop()
            d = _distance(fps[query], self.fps[node])
            near = d <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 1))
            many = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), side="right") - low
            for a, b in _parts(many):
                part = many[a:b]
                if total := int(part.sum()):
                    step = np.arange(total) - np.repeat(np.cumsum(part) - part, part)
                    todo.append((np.repeat(query[a:b], part), self.children[np.repeat(low[a:b], part) + step]))


def _parts(many: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(many)
    start = 0
    while start < len(many):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + FRONTIER, side="right")))
        yield start, stop
        start = stop


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] for all i; a root is the smallest index of its set."""
    while len(a):
        for x in (a, b):
            while (up := parent[parent[x]]).tolist() != parent[x].tolist():
                parent[x] = up
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def link_shards(keys: np.ndarray, fps: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within each shard: each fingerprint with its set's first, never all pairs.

    Role 0 is in the tree and searches, 1 is in the tree only, 2 searches only.
    """
    order = np.argsort(keys, kind="stable")
    keys, fps, role = keys[order], fps[order], role[order]
    tree, asks = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    if not len(tree) or not len(asks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    forest = BkForest(keys[tree], fps[tree])
    parent = np.arange(len(keys))
    for query, node in forest.search(keys[asks], fps[asks], radius):
        a, b = asks[query], tree[node]
        use = a != b
        union(parent, a[use], b[use])
    every = np.arange(len(keys))
    while (up := parent[parent]).tolist() != parent.tolist():
        parent = up
    moved = every[parent != every]
    return fps[moved], fps[parent[moved]]


def _link(radius: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def flush(parts: list[np.ndarray], last: bool) -> tuple[np.ndarray, pa.RecordBatch | None]:
            """Works off all shards that have ended; the last one may go on in the next batch."""
            x = np.concatenate(parts, axis=1)
            cut = x.shape[1] if last else int(np.searchsorted(x[0], x[0, -1]))
            a, b = link_shards(x[0, :cut], x[1, :cut], x[2, :cut], radius)
            return x[:, cut:], pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)]))
                rows += batch.num_rows
            if rows >= 1 << 19:
                rest, out = flush(held, last=False)
                held, rows = [rest], 0
                yield out
        if held:
            yield flush(held, last=True)[1]

    return work


def linked(fps: DataFrame, radius: int = RADIUS, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) that give the components of all links within the radius."""
    if not 0 <= radius < BLOCKS - 1:
        raise ValueError(f"the shards of two blocks out of {BLOCKS} need a radius under {BLOCKS - 1}")
    width = [11, 11, 11, 11, 10, 10]
    low = [sum(width[:i]) for i in range(BLOCKS)]
    block = [F.shiftrightunsigned("fp", low[i]).bitwiseAND((1 << width[i]) - 1) for i in range(BLOCKS)]
    keys = [(F.shiftleft(block[i], 11) + block[j]) + F.lit(n << 22) for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    full = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cells = F.ceil(F.col("n") / tree_limit).cast("int")
    split = dealt.join(full, "key").select("key", "fp", cells.alias("cells"), F.pmod(F.xxhash64("fp"), cells).cast("int").alias("mine"))
    # A shard of several trees: the cell (i, j) has the tree of part i, and part j searches it.
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")
    work = split.select("key", "fp", "mine", "cells", other).select(
        F.when(F.col("cells") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("key"),
        "fp",
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("int").alias("role"),
    )
    sorted_shards = work.repartition("key").sortWithinPartitions("key")
    return sorted_shards.mapInArrow(_link(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    Fingerprints of 4-word shingles (ASCII lower case, white-space words) link at ``radius`` or fewer differing
    bits; component_id is the smallest doc_id reachable. Equal fingerprints count once in the search, so a group of
    copies costs one row. Null and empty texts have fingerprint zero and link like any other; a row with a null
    doc_id is kept, its id is never the component's unless the component has no other. Rows that repeat a doc_id are
    each fingerprinted. An empty table gives an empty result. Other columns are ignored.
    """
    own = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = settle(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    groups = components(linked(distinct, radius))
    grouped = settle(distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "grouped")
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row of the smallest doc_id stays, nulls last.

    Rows are told apart by all their columns, so null ids and repeated ids lose no component.
    """
    own = settle(fingerprints(docs.withColumn(ROW, row_key(docs)), "doc_id", "text", ROW), "fingerprints")
    groups = components(linked(settle(own.select("fp").distinct(), "distinct"), radius))
    named = own.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    return keep_least(docs, named.select("doc_id", ROW, F.coalesce("component", "fp").alias("component")))
