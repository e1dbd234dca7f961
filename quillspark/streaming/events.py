"""Event aggregates that run alike over a table and a stream, and conversation state with a sliding time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULTS
from ..operators.tables import last_write

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(event_type, window_start, n, total); a watermark bounds the state of a stream and does nothing to a table."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", lateness) if events.isStreaming else timed
    counts = timed.groupBy("event_type", F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total")


def conversation_state(messages: DataFrame, keep: int = DEFAULTS.history, ttl_ms: int = 10_800_000) -> DataFrame:
    """(thread, role, text, at): after each batch the last ``keep`` messages of the threads it touched.

    ``messages`` has thread, role, text, at (timestamp). Every message re-arms the thread's time to live; after that
    its state goes.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        for rows in batches:
            held += [f"{int(a.timestamp() * 1e6):020d}\x1f{r}\x1f{t}" for r, t, a in zip(rows["role"], rows["text"], rows["at"], strict=True)]
        held = sorted(held)[-keep:]
        state.update((held,))
        state.setTimeoutDuration(ttl_ms)
        parts = [h.split("\x1f", 2) for h in held]
        yield pd.DataFrame({"thread": [key[0]] * len(parts), "role": [p[1] for p in parts], "text": [p[2] for p in parts], "at": [pd.Timestamp(int(p[0]), unit="us") for p in parts]})

    grouped = messages.groupBy("thread")
    return grouped.applyInPandasWithState(update, "thread string, role string, text string, at timestamp", "held array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_stream(events: DataFrame, folder: str, checkpoint: str, key: str, order: list[str]) -> StreamingQuery:
    """Works off what there is and stops: each micro-batch is merged into the newest snapshot of ``folder``, the last write of a key wins.

    A snapshot has a folder named by its batch, so a batch that runs again writes the same one; readers take the newest.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        last = last_write(batch, key, [F.desc(c) for c in order])
        before = newest_snapshot(batch.sparkSession, folder, batch_id)
        rows = last if before is None else last_write(before.unionByName(last), key, [F.desc(c) for c in order])
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id:08d}")
        vacuum(batch.sparkSession, folder)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the finished snapshots, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def newest_number(spark: SparkSession, folder: str, before: int | None = None) -> int:
    """The number of the newest finished snapshot, of one under ``before`` if that is given; -1 if there is none."""
    return max((b for b in finished(spark, folder) if before is None or b < before), default=-1)


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Deletes all finished snapshots but the ``keep`` newest; the numbers of those that went. Readers of an older one fail."""
    gone = finished(spark, folder)[:-keep] if keep > 0 else []
    for number in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={number:08d}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def newest_snapshot(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest finished snapshot, of a batch under ``before`` if that is given; None if there is none."""
    number = newest_number(spark, folder, before)
    return spark.read.parquet(f"{folder}/batch={number:08d}") if number >= 0 else None
