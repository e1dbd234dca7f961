"""Substring dedup: MinHash banding of paragraphs, exact Jaccard on collisions, removals clustered by components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import settle
from .simhash import union
from .words import HASH_BYTES, ODD, hashed_words, mix, powers, text_chunks

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.99
#: A paragraph ends at a line break and, inside a line, before a word whose hash is the largest of REACH words on either
#: side: these cuts depend on the words alone, so a passage gives the same paragraphs wherever it stands.
REACH = 6
#: Fewest words of a stretch of repeated paragraphs that is removed.
LEAST_WORDS = 16
#: Bits of the filter of colliding bands that is sent to the tasks, whatever their number.
FILTER_BITS = 1 << 26
#: Paragraphs of one band compared in one go. A band of more, one of the CROWDED largest, is cut into smaller ones by a
#: second hash, once under each of SECOND permutations: a pair of similarity 0.8 stays together in one of them with a
#: probability of 0.9997.
BAND_PART, CROWDED, SECOND = 2_000, 1 << 18, 5


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 1) -> int:
    """The fewest bands of ``rows`` hashes each in which a pair of that similarity meets with that probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


@dataclass
class Units:
    """Paragraphs of a batch of texts: word hashes of all, and of each its document, line, first word there and words."""

    words: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, reach: int = REACH) -> Units:
        found = hashed_words(texts)
        words, doc = found.hashes, found.text_of_word
        n = len(words)
        where = np.stack([doc, found.line])
        opens = np.ones(n, bool)
        opens[1:] = (where[:, 1:] != where[:, :-1]).any(axis=0)
        at = np.cumsum(opens)
        cut = np.ones(n, bool)
        for k in range(1, min(reach, n - 1) + 1):
            other = at[k:] != at[:-k]
            more = words[k:] > words[:-k]
            cut[k:] &= other | more
            cut[:-k] &= other | ~more & (words[k:] != words[:-k])
        cut |= opens
        begin = np.flatnonzero(cut)
        starts = np.flatnonzero(opens)
        first = begin - starts[at[begin] - 1]
        return cls(words, doc[begin], found.line[begin], first, begin, np.append(begin[1:], n) if n else begin)

    def names(self) -> np.ndarray:
        """A 64-bit hash of each paragraph's words in order."""
        if not len(self.begin):
            return np.zeros(0, np.int64)
        size = self.end - self.begin
        place = np.arange(len(self.words)) - np.repeat(self.begin, size)
        with np.errstate(over="ignore"):
            return mix(np.add.reduceat(self.words * powers(int(size.max()))[place], self.begin) + size.astype(np.uint64)).view(np.int64)

    def shingles(self, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word shingles of all paragraphs, and where each paragraph's begin; a shorter one is one shingle."""
        size = self.end - self.begin
        count = np.maximum(1, size - width + 1)
        starts = np.cumsum(count) - count
        at = np.repeat(self.begin - starts, count) + np.arange(int(count.sum()))
        last = np.repeat(self.end, count)
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), np.uint64)
            for k in range(width):
                inside = at + k < last
                h = h * ODD + np.where(inside, self.words[np.minimum(at + k, len(self.words) - 1)] if len(self.words) else 0, np.uint64(k + 1))
        return mix(h), starts

    def bands(self, count: int) -> np.ndarray:
        """(paragraphs, bands): smallest shingle hash under each band's permutation."""
        return least_hashes(*self.shingles(), range(count))


def least_hashes(shingles: np.ndarray, starts: np.ndarray, permutations: range) -> np.ndarray:
    """(sets, permutations): the smallest hash of each set of shingles, which begin at ``starts``."""
    with np.errstate(over="ignore"):
        found = [mix(np.minimum.reduceat(mix(shingles ^ (ODD * np.uint64(2 * j + 3))), starts) + np.uint64(j)) for j in permutations] if len(starts) else []
    return np.stack(found, axis=1).view(np.int64) if found else np.zeros((0, len(permutations)), np.int64)


def spread(bands: np.ndarray, rows: np.ndarray, sets: list[np.ndarray], crowded: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """``bands`` of ``rows``, each crowded one put in place by SECOND narrower ones; ``sets`` are the rows' shingles."""
    full = np.isin(bands, crowded)
    if not full.any():
        return bands, rows
    few = np.unique(rows[full])
    each = [sets[r] for r in few.tolist()]
    narrow = least_hashes(np.concatenate(each).view(np.uint64), np.cumsum([0, *map(len, each)])[:-1], range(first, first + SECOND))[np.searchsorted(few, rows[full])]
    with np.errstate(over="ignore"):
        made = mix(bands[full].view(np.uint64)[:, None] * ODD + narrow.view(np.uint64)).view(np.int64)
    return np.concatenate([bands[~full], made.ravel()]), np.concatenate([rows[~full], np.repeat(rows[full], SECOND)])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, limit=HASH_BYTES):
        units = Units.of(batch.column("text"))
        order = np.arange(len(units.doc)) - np.searchsorted(units.doc, units.doc)
        take = pa.array(units.doc)
        columns = [batch.column("doc_id").take(take), batch.column("th").take(take), *map(pa.array, (order.astype(np.int32), units.line.astype(np.int32), units.first.astype(np.int32), (units.end - units.begin).astype(np.int32), units.names()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "pos", "line", "first", "n", "unit"])


def _banded(count: int, sent=None):
    """(band, unit), with the shingles if ``sent`` has the filter of colliding bands, and then only of those."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, crowded = (None, None) if sent is None else (np.frombuffer(sent.value[0], np.uint8), sent.value[1])
        for batch in text_chunks(batches, limit=HASH_BYTES):
            units = Units.of(batch.column("text"))
            bands, names = units.bands(count), units.names()
            use = np.flatnonzero(units.end - units.begin >= SHINGLE)
            use = use[np.unique(names[use], return_index=True)[1]]
            bands, names = bands[use], names[use]
            if bits is None:
                yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(np.repeat(names, count))], ["band", "unit"])
                continue
            place = bands & (FILTER_BITS - 1)
            row, col = np.nonzero(bits[place >> 3] >> (place & 7) & 1)
            shingles, starts = units.shingles()
            ends = np.append(starts[1:], len(shingles))
            sets = {r: np.unique(shingles[starts[use[r]] : ends[use[r]]]).view(np.int64) for r in np.unique(row).tolist()}
            met, row = spread(bands[row, col], row, sets, crowded, count)
            rows = [sets[r] for r in row.tolist()]
            offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(names[row]), lists], ["band", "unit", "shingles"])

    return work


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Root indexes of the sets under "Jaccard similarity of at least"; every pair that shares an element is compared, none is listed."""
    parent = np.arange(len(sets))
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    low, high = np.searchsorted(flat[order], flat), np.searchsorted(flat[order], flat, side="right")
    owner_of = owner[order]
    ends = np.cumsum(size)
    for i in range(len(sets)):
        mine = range(ends[i] - size[i], ends[i])
        shared = np.bincount(np.concatenate([owner_of[low[j] : high[j]] for j in mine]), minlength=len(sets))
        near = np.flatnonzero(shared >= similarity * (size + size[i] - shared) - 1e-9)
        near = near[near > i]
        union(parent, np.full(len(near), i), near)
    while (up := parent[parent]).tolist() != parent.tolist():
        parent = up
    return parent


def similar_many(sets: list[np.ndarray], similarity: float, groups: np.ndarray | None = None) -> np.ndarray:
    """As ``similar``, for many sets: one after the other is held against all, but for those of the largest component so far.

    In a group of near copies nearly all are in it after the first; where few are alike the band is a narrow one. Sets of
    equal ``groups`` are in one component to begin with.
    """
    parent = np.arange(len(sets)) if groups is None else np.unique(groups, return_index=True)[1][np.unique(groups, return_inverse=True)[1]]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    values, owner = flat[order], np.repeat(np.arange(len(sets)), size)[order]
    done = np.zeros(len(sets), bool)
    while True:
        while (up := parent[parent]).tolist() != parent.tolist():
            parent = up
        known = done.any() or groups is not None
        left = np.flatnonzero(~done & (parent != np.bincount(parent).argmax())) if known else np.arange(len(sets))
        if not len(left):
            return parent
        for i in left[: 64 if known else 1].tolist():
            low, high = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], side="right")
            shared = np.bincount(np.concatenate([owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]), minlength=len(sets))
            near = np.flatnonzero(shared >= similarity * (size + size[i] - shared) - 1e-9)
            union(parent, np.full(len(near), i), near)
            done[i] = True


def _verify(similarity: float):
    def settle_band(units: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        root = (similar if len(units) <= BAND_PART else similar_many)(sets, similarity)
        moved = np.flatnonzero(root != np.arange(len(units)))
        return units[moved], units[root[moved]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, units, sets = None, [], []

        def done() -> pa.RecordBatch:
            a, b = settle_band(np.array(units), sets) if len(units) > 1 else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            lists = batch.column("shingles")
            flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            for i, (key, unit) in enumerate(zip(np.asarray(batch.column("band")).tolist(), np.asarray(batch.column("unit")).tolist(), strict=True)):
                if key != band:
                    if len(units) > 1:
                        yield done()
                    band, units, sets = key, [], []
                if not units or units[-1] != unit:
                    units.append(unit)
                    sets.append(flat[offsets[i] : offsets[i + 1]])
        if len(units) > 1:
            yield done()

    return work


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def near_units(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(node, component) of distinct paragraphs of at least five words that are linked to another by their Jaccard similarity."""
    spark = docs.sparkSession
    count = bands_for(similarity, recall)
    texts = docs.select("text")
    met = texts.mapInArrow(_banded(count), "band long, unit long").groupBy("band").agg(F.min("unit").alias("a"), F.max("unit").alias("b"), F.count("*").alias("n"))
    met = settle(met.where("a != b"), "bands")
    place = F.col("band").bitwiseAND(FILTER_BITS - 1)
    word = met.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(band & 63 AS int))").alias("bit"))
    filled = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    crowded = met.where(F.col("n") > BAND_PART).orderBy(F.desc("n"), "band").limit(CROWDED).select("band").toArrow().column("band").to_numpy()
    sent = spark.sparkContext.broadcast((bits.tobytes(), np.sort(crowded)))
    rows = texts.mapInArrow(_banded(count, sent), "band long, unit long, shingles array<long>")
    together = rows.repartition("band").sortWithinPartitions("band", "unit")
    return components(together.mapInArrow(_verify(similarity), "a long, b long"))


def repeats(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """The stretches of repeated paragraphs: doc_id, th, component_id, line, first, n_words, pos, removed, first_doc_id.

    Paragraphs are lines, longer ones cut where their words say so; 5-word shingles of lower-cased words. Two are alike
    if they are equal or their shingle sets have Jaccard similarity ``similarity`` or more; components of that join
    them. A component that stands in more than one document is a repeat: the document of the smallest doc_id keeps its
    paragraphs, those of all others are removed, where adjacent ones make at least ``least_words`` words. One row per
    paragraph of such a stretch, ``removed`` false in the document that keeps it; th is the hash of its text. Null and
    empty texts have none; rows of one id and equal text are one document; a null doc_id is smaller than any. Other
    columns are ignored.
    """
    units = settle(_source(docs).mapInArrow(_occurrences, "doc_id long, th long, pos int, line int, first int, n int, unit long"), "units")
    groups = settle(near_units(docs, similarity), "groups")
    document = F.struct("doc_id", "th")
    each = units.groupBy("unit").agg(F.min(document).alias("low"), F.max(document).alias("high"))
    named = each.join(groups.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component_id", F.coalesce("component", "unit"))
    loose = named.where("component is null and low != high").select("unit", "component_id", "low")
    tied = named.where("component is not null")
    whole = tied.groupBy("component_id").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("component_id", "low")
    marked = settle(loose.unionByName(tied.select("unit", "component_id").join(whole, "component_id").select("unit", "component_id", "low")), "marked")
    found = units.join(marked, "unit")
    run = W.partitionBy("doc_id", "th").orderBy("pos")
    found = found.withColumn("before", F.lag("pos").over(run)).where("before is null or before != pos")
    stretch = found.withColumn("run", F.col("pos") - F.row_number().over(run))
    long = stretch.withColumn("stretch", F.sum("n").over(W.partitionBy("doc_id", "th", "run"))).where(F.col("stretch") >= least_words)
    return long.select("doc_id", "th", "component_id", "line", "first", F.col("n").alias("n_words"), "pos", (F.struct("doc_id", "th") != F.col("low")).alias("removed"), F.col("low.doc_id").alias("first_doc_id"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the removed paragraphs taken out of the texts; the white space between other words stays as it is."""
    gone = repeats(docs, **options).where("removed").groupBy("doc_id", "th").agg(F.collect_list(F.struct("line", "first", "n_words")).alias("__qs_gone"))
    gone = gone.withColumnRenamed("doc_id", "__qs_id").withColumnRenamed("th", "__qs_th")
    joined = docs.withColumn("__qs_h", F.xxhash64("text")).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__qs_id")) & (F.col("__qs_h") == F.col("__qs_th")), "left")
    return joined.withColumn("text", _cut("text", "__qs_gone")).select(*docs.columns)


def cut_words(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` without the words (line, first, count)."""
    lines = text.split("\n")
    by_line: dict[int, set[int]] = {}
    for line, first, n in spans:
        by_line.setdefault(line, set()).update(range(first, first + n))
    for line, gone in by_line.items():
        words = list(re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", lines[line]))
        lines[line] = lines[line][: words[0].start()] + "".join(m.group() for i, m in enumerate(words) if i not in gone)
    return "\n".join(x for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c") or i not in by_line)


@F.pandas_udf(T.StringType())
def _cut(text, gone):
    return pd.Series([t if t is None or g is None else cut_words(t, [(s["line"], s["first"], s["n_words"]) for s in g]) for t, g in zip(text, gone, strict=True)])
