"""The chunkers as a table function of SQL: ``SELECT ... FROM chunk(TABLE(documents), text => 'text', size => 1000)``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..config import DEFAULTS
from .chunking import SEPARATORS, split_recursive

KINDS = ("recursive", "words")


@dataclass
class _Settings(AnalyzeResult):
    text: str = "text"
    kind: str = "recursive"
    size: int = DEFAULTS.chunk_size
    overlap: int = DEFAULTS.chunk_overlap
    separators: tuple = tuple(SEPARATORS)


def words_of(text: str) -> list[str]:
    lowered = text.lower()
    for mark in "\t\n\r":
        lowered = lowered.replace(mark, " ")
    return [w for w in lowered.split(" ") if w]


def split_words(text: str | None, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` lower-cased words, each beginning ``size - overlap`` words after the one before."""
    words = words_of(text or "")
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size - overlap)]


class _Chunk:
    """Each row of the table with each chunk of its text: all other columns, chunk_index, total_chunks and the chunk.

    The schema follows the table and the arguments: ``text`` names its column, ``kind`` is recursive or words,
    ``separators`` is an array of strings, strongest first. Rows without text have no chunks.
    """

    def __init__(self, settings: _Settings | None = None):
        self.s = settings

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument | None = None, kind: AnalyzeArgument | None = None, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, separators: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument of chunk is a table")
        given = {"text": text, "kind": kind, "size": size, "overlap": overlap, "separators": separators}
        for name, a in given.items():
            if a is not None and not a.isConstantExpression:
                raise ValueError(f"{name} of chunk is a constant")
        s = {k: a.value for k, a in given.items() if a is not None and a.value is not None}
        s = {**s, "separators": tuple(s["separators"])} if "separators" in s else s
        column = s.get("text", "text")
        if column not in rows.dataType.names:
            raise ValueError(f"chunk finds no column {column}")
        if s.get("kind", "recursive") not in KINDS:
            raise ValueError(f"kind of chunk is one of {', '.join(KINDS)}")
        if not 0 <= s.get("overlap", DEFAULTS.chunk_overlap) < s.get("size", DEFAULTS.chunk_size):
            raise ValueError("overlap of chunk is less than its size")
        kept = [f for f in rows.dataType.fields if f.name not in (column, "chunk_index", "total_chunks")]
        schema = T.StructType([*kept, T.StructField("chunk_index", T.LongType()), T.StructField("total_chunks", T.LongType()), T.StructField(column, T.StringType())])
        return _Settings(schema=schema, **s)

    def eval(self, rows: Row, *_, **__) -> Iterator[tuple]:
        s = self.s
        text = rows[s.text]
        parts = split_words(text, s.size, s.overlap) if s.kind == "words" else split_recursive(text, s.size, s.overlap, list(s.separators))
        kept = tuple(v for n, v in zip(rows.__fields__, rows, strict=True) if n not in (s.text, "chunk_index", "total_chunks"))
        for i, part in enumerate(parts):
            yield *kept, i, len(parts), part


def register(spark: SparkSession, name: str = "chunk") -> None:
    spark.udtf.register(name, udtf(_Chunk))
