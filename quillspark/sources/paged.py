"""A data source that walks lists which are handed out page by page under a cursor, as a table or as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "collection string, cursor string, position int, record string"
#: fetch(collection, cursor, size) -> {"results": [...], "has_more": bool, "next_cursor": str or None}; no cursor: the start.
Fetch = Callable[[str, str | None, int], dict]


def _pages(fetch: Fetch, collection: str, cursor: str | None, size: int, end: str | None = None) -> Iterator[tuple[str | None, dict]]:
    """Pages from a cursor on, up to the one that starts at ``end``. A cursor that comes again would never end: it fails."""
    seen = set()
    while cursor != end or not seen:
        if cursor in seen:
            raise ValueError(f"the cursors of {collection} run in a circle at {cursor!r}")
        seen.add(cursor)
        page = fetch(collection, cursor, size)
        yield cursor, page
        if not page.get("has_more") or page.get("next_cursor") is None:
            return
        cursor = page["next_cursor"]


def _rows(collection: str, cursor: str | None, page: dict) -> Iterator[tuple]:
    for at, record in enumerate(page.get("results") or []):
        yield collection, cursor, at, json.dumps(record, ensure_ascii=False)


@dataclass
class Walk(InputPartition):
    collection: str
    start: str | None = None
    end: str | None = None


class PagedSource(DataSource):
    """``format("paged")``: options ``fetch`` (module:factory), ``argument`` for the factory, ``collections`` (a JSON list), ``pageSize``.

    A row is a record as JSON with the cursor of its page and its place there. The factory makes a Fetch inside each
    task, so that clients and secrets stay out of the plan. A fetch that fails fails its task, which Spark runs again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Options:
    def __init__(self, options: dict):
        module, _, factory = options["fetch"].partition(":")
        self._factory, self._argument = (module, factory), options.get("argument")
        self.collections, self.size = json.loads(options["collections"]), int(options.get("pageSize", 100))
        self.pages = int(options.get("pagesPerTrigger", 10))

    def fetch(self) -> Fetch:
        module, factory = self._factory
        return getattr(import_module(module), factory)(self._argument)


class _Table(_Options, DataSourceReader):
    """A partition for each collection; its pages follow each other, as only a page tells the next cursor."""

    def partitions(self) -> list[Walk]:
        return [Walk(c) for c in self.collections]

    def read(self, partition: Walk) -> Iterator[tuple]:
        for cursor, page in _pages(self.fetch(), partition.collection, None, self.size):
            yield from _rows(partition.collection, cursor, page)


class _Stream(_Options, DataSourceStreamReader):
    """An offset is, for each collection, the cursor at which to go on, and whether its list is at its end.

    The driver walks ahead to learn cursors, ``pagesPerTrigger`` of them at most; rows are fetched by the tasks.
    """

    _at: dict | None = None

    def initialOffset(self) -> dict:
        return {c: {"cursor": None, "done": False} for c in self.collections}

    def latestOffset(self) -> dict:
        offset = dict(self._at or self.initialOffset())
        fetch = self.fetch()
        for c, at in offset.items():
            for taken, (_, page) in enumerate(_pages(fetch, c, at["cursor"], self.size) if not at["done"] else (), 1):
                more = bool(page.get("has_more")) and page.get("next_cursor") is not None
                offset[c] = {"cursor": page["next_cursor"] if more else None, "done": not more}
                if taken == self.pages:
                    break
        self._at = offset
        return offset

    def partitions(self, start: dict, end: dict) -> list[Walk]:
        self._at = end  # after a restart, too
        return [Walk(c, start[c]["cursor"], end[c]["cursor"]) for c in end if not start[c]["done"] and start[c] != end[c]]

    def read(self, partition: Walk) -> Iterator[tuple]:
        for cursor, page in _pages(self.fetch(), partition.collection, partition.start, self.size, partition.end):
            yield from _rows(partition.collection, cursor, page)


def read_paged(spark: SparkSession, fetch: str, collections: list[str], argument: str | None = None, page_size: int = 100) -> DataFrame:
    """SCHEMA rows of all collections, each record once; a collection without records gives none."""
    spark.dataSource.register(PagedSource)
    return _reader(spark.read, fetch, collections, argument, page_size).load()


def stream_paged(spark: SparkSession, fetch: str, collections: list[str], argument: str | None = None, page_size: int = 100, pages_per_trigger: int = 10) -> DataFrame:
    """The same as a stream: a query that stops goes on at the cursors of its checkpoint."""
    spark.dataSource.register(PagedSource)
    return _reader(spark.readStream, fetch, collections, argument, page_size).option("pagesPerTrigger", pages_per_trigger).load()


def _reader(reader, fetch, collections, argument, page_size):
    options = {"fetch": fetch, "collections": json.dumps(collections), "pageSize": str(page_size)} | ({"argument": argument} if argument else {})
    return reader.format("paged").options(**options)


def write_pages(records: DataFrame, folder: str, page_size: int) -> list[str]:
    """Lays out records (collection, position, record as JSON) as pages for ``folder_pages``; the names of the collections."""
    place = F.row_number().over(W.partitionBy("collection").orderBy("position")) - 1
    placed = records.withColumn("page", F.floor(place / page_size)).groupBy("collection", "page").agg(F.array_sort(F.collect_list(F.struct("position", "record"))).alias("rows"))
    last = F.max("page").over(W.partitionBy("collection"))
    body = F.array_join(F.transform("rows", lambda r: r["record"]), ",")
    more = F.col("page") < last
    following = F.when(more, F.concat(F.lit('"'), F.col("page") + 1, F.lit('"'))).otherwise("null")
    page = F.concat(F.lit('{"results":['), body, F.lit('],"has_more":'), more.cast("string"), F.lit(',"next_cursor":'), following, F.lit("}"))
    placed.select("collection", F.col("page").alias("cursor"), page.alias("value")).write.partitionBy("collection", "cursor").mode("overwrite").text(folder)
    return [r["collection"] for r in placed.select("collection").distinct().orderBy("collection").collect()]  # a name for each list


def folder_pages(folder: str) -> Fetch:
    """A Fetch over what ``write_pages`` has written, in any store that Arrow reads; the page size is the one written."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)

    def fetch(collection: str, cursor: str | None, size: int) -> dict:
        found = system.get_file_info(fs.FileSelector(f"{root}/collection={collection}/cursor={cursor or 0}"))
        path = next(f.path for f in found if f.base_name.startswith("part-"))
        with system.open_input_stream(path) as file:
            return json.loads(file.read())

    return fetch
