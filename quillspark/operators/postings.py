"""A lexical index: postings written once, in folders by term, and BM25 over those that the queries need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T
from .best import MARGIN, Best, cells, rounded

#: Folders of postings; a search reads those of its terms.
FOLDERS = 16
#: Documents whose postings a task holds at once, about.
DOCUMENTS = 40_000


def _folder():
    return F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int").alias("folder")


class _Matrix:
    """Postings of some documents by term."""

    def __init__(self, batches: list[pa.RecordBatch]):
        held = pa.Table.from_batches(batches)
        terms = held.column("term").combine_chunks().dictionary_encode()
        docs = held.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
        order = np.argsort(np.asarray(terms.indices), kind="stable")
        self.terms, self.ids = terms.dictionary, pa.table({"id": docs.dictionary})
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(np.asarray(terms.indices), minlength=len(self.terms)))])
        self.docs, self.weight = np.asarray(docs.indices)[order], np.asarray(held.column("weight"))[order]

    def best(self, asked: pa.RecordBatch, k: int) -> Best:
        """The k best documents for each query (terms, each with its idf)."""
        pairs = asked.column("terms")
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(pairs)))])
        flat = pairs.flatten()
        code = np.asarray(pc.fill_null(pc.index_in(flat.field("term"), self.terms), -1))
        idf = np.asarray(flat.field("idf"))
        best, held = Best(asked.num_rows, k), [[], [], []]
        for q in range(asked.num_rows):
            known = np.flatnonzero(code[ends[q] : ends[q + 1]] >= 0) + ends[q]
            score = np.zeros(self.ids.num_rows)
            for c, w in zip(code[known].tolist(), idf[known].tolist(), strict=True):
                part = slice(self.starts[c], self.starts[c + 1])
                score[self.docs[part]] += w * self.weight[part]  # a document is there once for a term
            least = np.partition(score, len(score) - k)[len(score) - k] - MARGIN if len(score) > k else 0.0
            found = np.flatnonzero((score > 0) & (score >= least))
            for x, y in zip(held, (np.full(len(found), q), rounded(score[found]), found), strict=True):
                x.append(y)
        q, score, doc = (np.concatenate([*x, np.zeros(0, t)]) for x, t in zip(held, (np.int64, np.float64, np.int64), strict=True))
        best.add(q, score, self.ids.take(pa.array(doc)))
        return best


class Postings:
    """``postings`` (id, dl, term, tf) in FOLDERS by the hash of the term, and ``stats`` (documents, their words in all), one row."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> Postings:
        """Cuts each text once. Null and blank texts are documents without words, and count as such; ids are not null and there once."""
        spark = docs.sparkSession
        words = docs.select(F.col(id_col).alias("id"), F.coalesce(T.tokens(F.col(text)), F.array().cast("array<string>")).alias("w"))
        counted = words.withColumn("dl", F.size("w")).select("id", "dl", F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
        counted.withColumn("folder", _folder()).repartition(FOLDERS, "folder").write.partitionBy("folder").parquet(f"{path}/postings")
        written = spark.read.schema("tf long").parquet(f"{path}/postings")
        written.agg(F.lit(docs.count()).alias("documents"), F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).write.parquet(f"{path}/stats")
        counted.select("id").limit(0).withColumns({"dl": F.lit(0), "term": F.lit(""), "tf": F.lit(0).cast("long"), "folder": F.lit(0)}).write.parquet(f"{path}/schema")
        return cls(spark, path)

    def search(self, asked: DataFrame, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> DataFrame:
        """(query_id, id, score): BM25 of every query (query_id, text) by its distinct words, of all documents that hold one.

        Words of queries choose the folders to read; document frequencies come from the postings of those words alone.
        Which documents score is known only from all of a query's words: queries of many common words bound little, so
        that early ends by upper bounds (measured: 34 to 76 % of all pairs remain) were not worth another pass.
        """
        rows, weighed, n, average = self._wanted(asked)
        part = self._idf(n) * self._weight(average, k1, b)
        # dealt by document first: what the words of many queries make of a posting is then summed where it is made
        return rows.repartition("id").join(weighed, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))

    def best(self, asked: DataFrame, k: int, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> DataFrame:
        """(query_id, id, score) of the k best documents of each part of the index for each query; the k best of all are among them.

        Scores are those of ``search``, ties go to the smaller id. A task holds the postings of about DOCUMENTS documents, past which
        the queries stream: every query meets every document that holds one of its words, and only the best leave the task.
        """
        rows, weighed, n, average = self._wanted(asked)
        parts = max(1, -(-n // DOCUMENTS), min(2 * self._spark.sparkContext.defaultParallelism, n // 1_000))
        told = weighed.select("query_id", "term", self._idf(n).alias("idf")).distinct().groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
        held = rows.select("id", "term", self._weight(average, k1, b).alias("weight"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("asks"))
        asks = told.select("query_id", "terms", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("asks"))
        both = held.unionByName(asks, allowMissingColumns=True).withColumn("block", F.lit(0))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell in cells(batches):
                postings = [b.select(["id", "term", "weight"]) for b in cell.of(0)]
                matrix = _Matrix(postings) if postings else None
                for batch in cell.of(1):
                    found = matrix.best(batch, k).batch(batch.column("query_id")) if matrix else None
                    if found is not None:
                        yield from found.to_batches(max_chunksize=65_536)

        kinds = {f.name: f.dataType.simpleString() for f in both.schema}
        return both.repartition("part").sortWithinPartitions("part", "asks").mapInArrow(work, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")

    def _wanted(self, asked: DataFrame) -> tuple[DataFrame, DataFrame, int, float]:
        """Postings in the folders of the queries' words, these words (query_id, term, df), the number of documents and their mean length."""
        terms = asked.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
        folders = [r[0] for r in terms.select(_folder()).distinct().collect()]  # FOLDERS numbers at most
        schema = self._spark.read.parquet(f"{self.path}/schema").schema
        rows = self._spark.read.schema(schema).parquet(f"{self.path}/postings").where(F.col("folder").isin(folders))
        known = rows.groupBy("term").agg(F.count("*").alias("df"))
        weighed = terms.join(known, "term")
        numbers = self._spark.read.parquet(f"{self.path}/stats").first()
        return rows, weighed, numbers.documents, numbers.words / max(numbers.documents, 1) or 1.0

    @staticmethod
    def _idf(n: int):
        return F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)

    @staticmethod
    def _weight(average: float, k1: float, b: float):
        return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(average)))
