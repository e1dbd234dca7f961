"""An index kept in step with its documents: what changed is cut into chunks again, what went is taken out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import chunking, tables
from .observing import observed


def changes(indexed: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, action) by the hash of whole texts; ``indexed`` has doc_id and content_hash of each document that is in."""
    now = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return tables.diff(indexed, now, "doc_id", "content_hash")


ACTIONS = ("created", "updated", "unchanged", "deleted")


def written_changes(indexed: DataFrame, documents: DataFrame, path: str, *counters: Column) -> tuple[DataFrame, dict]:
    """(doc_id, action, content_hash) of all documents that aren't unchanged, written once, and how many there are of each action.

    The counts come with the write, as do ``counters``, aggregates over all rows (doc_id, action).
    """
    now = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    every = tables.diff(indexed, now, "doc_id", "content_hash", keep=True)
    seen = Observation()
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ACTIONS]
    observed(every, seen, *counts, *counters).where("action != 'unchanged'").write.parquet(path)
    return documents.sparkSession.read.schema(every.schema).parquet(path), seen.get


def refresh(chunks: DataFrame, indexed: DataFrame, documents: DataFrame, parts: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(chunks, changes) after a synchronisation.

    Only created and updated documents are cut and enter the shuffle with their texts; chunks of unchanged
    ones stay as they are, all others go. One plan for all documents, no call per document.
    """
    found = changes(indexed, documents)
    todo = found.where("action in ('created', 'updated')").select("doc_id")
    gone = found.where("action != 'unchanged'").select("doc_id")  # new ones too: a run before may have been cut off
    made = chunking.chunk_documents(documents.join(todo, "doc_id", "left_semi"), parts(F.col("text")))
    return chunks.join(gone, "doc_id", "left_anti").unionByName(made.select(chunks.columns)), found


def embedded(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", batch: int = 32, into: str = "embedding") -> DataFrame:
    """``rows`` with the vectors of a text column; ``load`` makes the model once per task, which takes ``batch`` texts at a time.

    Null and blank texts have no vector and never reach the model.
    """

    @F.pandas_udf("array<double>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out = pd.Series([None] * len(part), dtype=object)
            use = [i for i, t in enumerate(part) if t is not None and t.strip()]
            for at in range(0, len(use), batch):
                for i, v in zip(use[at : at + batch], model([part.iloc[j] for j in use[at : at + batch]]), strict=True):
                    out.iloc[i] = v
            yield out

    return rows.withColumn(into, vectors(F.col(text)))


def once_per(rows: DataFrame, key: str, value: Callable[[Column], Column], of: str, into: str) -> DataFrame:
    """``rows`` with ``value(of)``, made once for each ``key`` and joined back: equal keys cost one call."""
    once = rows.groupBy(key).agg(F.min(of).alias("_of")).select(key, value(F.col("_of")).alias(into))
    return rows.join(once, key, "left")
