"""The command line: ``python -m quillspark.cli --home FOLDER source|sync|search|status ...``, with an exit code for each kind of failure.

A home folder holds the table of sources, a history of jobs and an index for each source.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
import uuid
from enum import IntEnum

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import catalog, retrieval
from .operators.parted import PartedTable, mask_of, part_of, parts_in
from .sources import files, openapi
from .sources.collections import drop

SOURCES = "source_id string, name string, source_type string, location string, created_at timestamp"
JOBS = "job_id string, source_id string, name string, started_at timestamp, finished_at timestamp, status string, created long, updated long, deleted long, chunks long, errors long, message string"
#: Types of sources: specifications in files, and tables of (doc_id, text).
TYPES = ("swagger", "documents")


class Exit(IntEnum):
    """What a command ends with."""

    SUCCESS = 0
    INPUT_ERROR = 1
    CONFIG_ERROR = 2
    CONNECTION_ERROR = 3
    SYNC_ERROR = 4
    INTERNAL_ERROR = 5


class Refused(Exception):
    """A request that can't be met as it is put."""


class Workspace:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self._sources = PartedTable(spark, f"{self.home}/sources", "source_id", SOURCES)
        self._jobs = PartedTable(spark, f"{self.home}/jobs", "job_id", JOBS)

    def _put(self, table: PartedTable, gone: DataFrame, rows: DataFrame) -> None:
        """Takes the keys ``gone`` out of a table and puts ``rows`` in."""
        keys = gone.select(table.key).unionByName(rows.select(table.key))
        table.merge(gone, rows, parts_in(keys.agg(mask_of(part_of(table.key))).first()[0]))

    def sources(self) -> DataFrame:
        return self._sources.read().drop("part")

    def add(self, name: str, source_type: str, location: str | None) -> str:
        if source_type not in TYPES:
            raise Refused(f"Invalid source type: {source_type}. Use one of {', '.join(TYPES)}.")
        if not location:
            raise Refused("A source needs --location.")
        new = self.spark.createDataFrame([(str(uuid.uuid4()), name, source_type, location, dt.datetime.now())], SOURCES)
        if refused := catalog.refused_sources(self.sources(), new).first():
            raise Refused(refused.reason)
        self._put(self._sources, new.select("source_id"), new)
        return new.first().source_id

    def find(self, which: str):
        """The source of an id, else of a name."""
        known = self.sources().where((F.col("source_id") == which) | (F.col("name") == which))
        found = known.orderBy((F.col("source_id") == which).desc()).first()
        if found is None:
            raise Refused(f"Source not found: {which}")
        return found

    def remove(self, which: str) -> str:
        """A source goes with its index."""
        source = self.find(which)
        drop(self.spark, self._index(source.source_id))
        gone = self.spark.createDataFrame([(source.source_id,)], "source_id string")
        self._put(self._sources, gone, self.sources().limit(0))
        return source.name

    def _index(self, source_id: str) -> str:
        return f"{self.home}/index/{source_id}"

    def documents(self, source) -> DataFrame:
        """(doc_id, text) of a source as it is now."""
        if source.source_type == "documents":
            return self.spark.read.parquet(source.location).select("doc_id", "text")
        found = openapi.documents_of(files.specifications(self.spark, source.location))
        return found.select(F.xxhash64("external_id").alias("doc_id"), F.concat("title", F.lit("\n\n"), "content").alias("text"))

    def sync(self, which: str | None = None) -> list[dict]:
        """Brings the index of one source or of all in step; a job for each, with what failed. One that fails doesn't keep others from it."""
        chosen = [self.find(which)] if which else self.sources().orderBy("name").collect()  # a row for each source
        done = []
        for source in chosen:
            job = {"job_id": str(uuid.uuid4()), "source_id": source.source_id, "name": source.name, "started_at": dt.datetime.now(), "status": "completed", "message": None}
            counters = dict.fromkeys(("created", "updated", "deleted", "chunks", "errors"), 0)
            try:
                api.sync(self.spark, self._index(source.source_id), self.documents(source), on_done=counters.update)
                job["status"] = "partial" if counters["errors"] else "completed"
            except PySparkException as error:  # what Spark says of the source
                job |= {"status": "failed", "message": str(error).splitlines()[0][:500]}
                counters["errors"] += 1
            job |= {c: counters[c] for c in ("created", "updated", "deleted", "chunks", "errors")} | {"finished_at": dt.datetime.now()}
            done.append(job)
        if done:
            rows = self.spark.createDataFrame([tuple(j[c.split()[0]] for c in JOBS.split(", ")) for j in done], JOBS)
            self._put(self._jobs, rows.select("job_id"), rows)
        return done

    def history(self, limit: int) -> DataFrame:
        return self._jobs.read().drop("part").orderBy(F.desc("started_at"), "job_id").limit(limit)

    def status(self) -> DataFrame:
        """(name, documents, chunks, tokens) of each source."""
        each = [api.status(self.spark, self._index(s.source_id)).select(F.lit(s.name).alias("name"), "documents", "chunks", "tokens") for s in self.sources().orderBy("name").collect()]
        out = self.spark.createDataFrame([], "name string, documents long, chunks long, tokens long")
        for rows in each:
            out = out.unionByName(rows)
        return out

    def search(self, text: str, limit: int) -> DataFrame:
        """(rank, score, name, doc_id, text): the best chunks of all sources."""
        every = self.spark.createDataFrame([], "chunk_id string, doc_id long, text string, name string")
        for s in self.sources().collect():
            chunks = PartedTable(self.spark, f"{self._index(s.source_id)}/chunks", "doc_id", api.CHUNKS).read()
            every = every.unionByName(chunks.select(F.concat(F.lit(f"{s.source_id}/"), "chunk_id").alias("chunk_id"), "doc_id", "text", F.lit(s.name).alias("name")))
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        best = retrieval.top_k(retrieval.search_terms(asked, every.select(F.col("chunk_id").alias("doc_id"), "text")), limit)
        return best.join(every.withColumnRenamed("chunk_id", "id"), "id").select("rank", "score", "name", "doc_id", "text").orderBy("rank")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillspark")
    parser.add_argument("--home", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    source = commands.add_parser("source").add_subparsers(dest="action", required=True)
    source.add_parser("list")
    add = source.add_parser("add")
    add.add_argument("--name", "-n", required=True)
    add.add_argument("--type", "-t", required=True, dest="source_type")
    add.add_argument("--location", "-l")
    for name in ("show", "remove"):
        source.add_parser(name).add_argument("source")
    sync = commands.add_parser("sync").add_subparsers(dest="action", required=True)
    sync.add_parser("run").add_argument("source", nargs="?")
    sync.add_parser("history").add_argument("--limit", type=int, default=10)
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=5)
    commands.add_parser("status")
    return parser


def _print(rows: DataFrame, limit: int = 1_000) -> None:
    for r in rows.limit(limit).collect():
        print("\t".join("" if v is None else str(v) for v in r))


def run(args: argparse.Namespace, spark: SparkSession) -> Exit:
    work = Workspace(spark, args.home)
    asked = (args.command, getattr(args, "action", None))
    if asked == ("source", "list"):
        _print(work.sources().select("source_id", "name", "source_type", "location").orderBy("name"))
    elif asked == ("source", "add"):
        print(work.add(args.name, args.source_type.lower(), args.location))
    elif asked == ("source", "show"):
        found = work.find(args.source)
        _print(spark.createDataFrame([found], work.sources().schema).join(work.status(), "name"))
    elif asked == ("source", "remove"):
        print(work.remove(args.source))
    elif asked == ("sync", "run"):
        done = work.sync(args.source)
        for job in done:
            print(job["name"], job["status"], *[f"{c}={job[c]}" for c in ("created", "updated", "deleted", "chunks", "errors")], job["message"] or "")
        if any(job["status"] != "completed" for job in done):
            return Exit.SYNC_ERROR
    elif asked == ("sync", "history"):
        _print(work.history(args.limit).select("started_at", "name", "status", "created", "updated", "deleted", "chunks", "errors"))
    elif args.command == "search":
        if not 1 <= args.limit <= 100:
            raise Refused("--limit must be between 1 and 100")
        _print(work.search(args.query, args.limit).withColumn("text", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 80)))
    else:
        _print(work.status())
    return Exit.SUCCESS


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; the exit code. Wrong arguments are input errors, as is a source that isn't there."""
    try:
        args = _parser().parse_args(argv)
    except SystemExit as stop:
        return int(Exit.SUCCESS if not stop.code else Exit.INPUT_ERROR)
    try:
        session = spark or SparkSession.builder.appName("quillspark").getOrCreate()
        return int(run(args, session))
    except Refused as why:
        print(why, file=sys.stderr)
        return int(Exit.INPUT_ERROR)
    except ConnectionError as error:
        print(error, file=sys.stderr)
        return int(Exit.CONNECTION_ERROR)
    except PySparkException as error:
        print(str(error).splitlines()[0], file=sys.stderr)
        return int(Exit.INTERNAL_ERROR)


if __name__ == "__main__":
    sys.exit(main())
