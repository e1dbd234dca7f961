"""Chunkers: word windows in Column expressions; recursive and hierarchical ones in Python, text by text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS
from ..functions.columns import let
from ..functions.text import chunk_id, estimate_tokens, tokens

# Separators, strongest first; the last one cuts between characters.
SEPARATORS = ["\n\n", "\n", "。", ".", "!", "?", "！", "？", ";", "；", ",", "，", " ", ""]


def word_windows(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of words that overlap; none for a text without words."""
    starts = lambda words: F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap))
    cut = lambda words: F.transform(starts(words), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    return let(tokens(text), lambda words: F.when(F.size(words) > 0, cut(words)).otherwise(F.array().cast("array<string>")))


def split_recursive(text: str | None, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: cut at the strongest separator there is, merged again up to the size.

    A chunk starts with up to ``overlap`` characters' worth of the last pieces of the one before. Blank chunks are
    dropped, ends are stripped.
    """
    if not text or not text.strip():
        return []
    chunks: list[str] = []
    _emit(_pieces(text, size, separators), size, overlap, chunks)
    return [c for c in (x.strip() for x in chunks) if c]


def _pieces(text: str, size: int, separators: list[str]) -> list[str]:
    """Pieces no longer than ``size``, each with its separator at the end."""
    work, out = [(text, 0)], []
    while work:
        part, level = work.pop()
        if len(part) <= size:
            out.append(part)
            continue
        while level < len(separators) - 1 and separators[level] not in part:
            level += 1
        mark = separators[level]
        cut = [part[i : i + size] for i in range(0, len(part), size)] if not mark else [x + mark for x in part.split(mark)[:-1]] + [part.rsplit(mark, 1)[1]]
        work += [(x, level + 1) for x in reversed(cut) if x]
    return out


def _emit(pieces: list[str], size: int, overlap: int, chunks: list[str]) -> None:
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            chunks.append("".join(held))
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if held:
        chunks.append("".join(held))


def recursive_chunks(size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap):
    """A Column function text -> array of chunks."""

    # A hundred texts at a time: batches of Arrow would hold 10,000, however long they are, and all their chunks.
    return F.udf(lambda text: split_recursive(text, size, overlap), T.ArrayType(T.StringType()), useArrow=False)


def _numbered(docs: DataFrame, parts: Column, kind: str | None = None) -> DataFrame:
    split = docs.select("doc_id", parts.alias("parts"))
    rows = split.select("doc_id", F.size("parts").cast("long").alias("total_chunks"), F.posexplode("parts").alias("chunk_index", "text"))
    key = [F.col("doc_id"), *([F.lit(kind)] if kind else []), F.col("chunk_index")]
    return rows.select(chunk_id(*key).alias("chunk_id"), "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "total_chunks", "text", estimate_tokens(F.col("text")).alias("token_count"))


def chunk_documents(docs: DataFrame, parts: Column) -> DataFrame:
    return _numbered(docs, parts)


Cut = Callable[[Column], Column]


def hierarchical(docs: DataFrame, d=DEFAULTS, include_parents: bool = True, parent_cut: Cut | None = None, child_cut: Cut | None = None) -> DataFrame:
    """Parents and their children: chunk_id, doc_id, chunk_type, chunk_index, parent_id, index_in_parent, text.

    Both are cut recursively, or by functions of a text Column of one's own.
    """
    parents = _numbered(docs, (parent_cut or recursive_chunks(d.parent_size, d.parent_overlap))(F.col("text")), "parent")
    cut = child_cut or recursive_chunks(d.child_size, d.child_overlap)
    split = parents.select("doc_id", F.col("chunk_id").alias("parent_id"), F.col("chunk_index").alias("parent_index"), cut(F.col("text")).alias("parts"))
    whole = split.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("parent_index", "parent_id", "parts"))).alias("tree"))
    tagged = F.flatten(F.transform("tree", lambda p: F.transform(p["parts"], lambda t, i: F.struct(p["parent_id"].alias("parent_id"), i.alias("index_in_parent"), t.alias("text")))))
    rows = whole.select("doc_id", F.posexplode(tagged).alias("chunk_index", "c"))
    children = rows.select(
        chunk_id(F.col("doc_id"), F.lit("child"), F.col("chunk_index")).alias("chunk_id"), "doc_id", F.lit("child").alias("chunk_type"), F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("c.parent_id").alias("parent_id"), F.col("c.index_in_parent").cast("long").alias("index_in_parent"), F.col("c.text").alias("text"),
    )
    if not include_parents:
        return children
    none = F.lit(None)
    own = parents.select("chunk_id", "doc_id", F.lit("parent").alias("chunk_type"), "chunk_index", none.cast("string").alias("parent_id"), none.cast("long").alias("index_in_parent"), "text")
    return own.unionByName(children)
