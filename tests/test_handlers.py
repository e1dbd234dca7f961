"""Handlers over streams against their twins over tables: repeated rows, late rows, several batches."""

import datetime as dt
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from quillspark.plans.handlers import bot_events
from quillspark.streaming import events as E
from quillspark.streaming import handlers as H

SF = "/root/testdata/sf0.001"


@pytest.fixture
def sent(spark, tmp_path):
    """Three files of the events of some days in order of time; each has its own rows twice, the last one a row of long ago."""
    every = bot_events(spark.read.parquet(f"{SF}/events.parquet"))
    folder = tmp_path / "sent"
    times = [r.at for r in every.select("at").orderBy("at").collect()]
    third, two = times[len(times) // 3], times[2 * len(times) // 3]
    parts = [every.where(F.col("at") < third), every.where((F.col("at") >= third) & (F.col("at") < two)), every.where(F.col("at") >= two)]
    late = every.where(F.col("event_id") == "1").withColumns({"event_id": F.lit("late"), "message_ts": F.lit("late"), "bot_id": F.lit(None).cast("string"), "subtype": F.lit(None).cast("string"), "kind": F.lit("app_mention")})
    for i, part in enumerate([*parts[:2], parts[2].unionByName(late)]):
        part.unionByName(part).coalesce(1).write.parquet(f"{folder}/{i}")
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(3):
        name = next(f for f in os.listdir(f"{folder}/{i}") if f.endswith(".parquet"))
        shutil.move(f"{folder}/{i}/{name}", f"{flat}/{i}.parquet")
        os.utime(f"{flat}/{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    return every, spark.readStream.schema(H.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(flat))


def run(df, tmp_path, name, mode="append"):
    stream = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    stream.awaitTermination(200)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_repeated_and_late_events_are_dropped(sent, tmp_path):
    every, stream = sent
    got = run(H.once(stream).select("event_id"), tmp_path, "once_out")
    assert sorted(got) == sorted((r.event_id,) for r in every.select("event_id").collect())


def test_reactions_meet_their_messages(sent, tmp_path):
    every, stream = sent
    events = H.once(stream)
    got = run(H.rated_answers(H.reactions(events, "BOT"), events.where("user = 'BOT'"), "40 minutes", lateness=None), tmp_path, "rated_out")
    want = H.rated_answers(H.reactions(every, "BOT"), every.where("user = 'BOT'"), "40 minutes").collect()
    assert sorted(got) == sorted(map(tuple, want)) and len(want) > 3


def test_sliding_windows_of_a_stream(sent, tmp_path):
    every, stream = sent
    got = dict(((k, w), n) for k, w, n in run(H.sliding(stream.dropDuplicates(["event_id", "at"]), "kind"), tmp_path, "sliding_out", "append"))
    want = {(r.kind, r.window_start): r.n for r in H.sliding(every, "kind").collect()}
    newest = max(w for _, w in got)
    assert got and all(want[k] == n for k, n in got.items())
    assert set(got) == {k for k in want if k[1] <= newest}


def test_reactions_without_a_known_bot(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(str(i), at, "reaction_added", "u", "c", None, None, None, None, None, 0, r, owner, "1") for i, (r, owner) in enumerate([("+1", "B"), ("x", ""), ("x", None), ("eyes", "B"), ("-1", "A")])]
    events = spark.createDataFrame(rows, H.EVENTS)
    assert [r.event_id for r in H.reactions(events, None).collect()] == ["0", "4"]
    assert [r.event_id for r in H.reactions(events, "B").collect()] == ["0"]


def test_questions_are_answered_batch_by_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    event = lambda i, minutes, text, thread=None, kind="app_mention", bot=None, images=0: (f"e{i}", at + dt.timedelta(minutes=minutes), kind, "u", "D1", text, f"m{i}", thread, bot, None, images, None, None, None)
    batches = [
        [event(1, 0, "<@BOT> first"), event(2, 1, "second", "m1", "message"), event(2, 1, "second", "m1", "message"), event(3, 1, " ", None), event(4, 2, "bot", "m1", "message", "B")],
        [event(5, 3, "<@BOT> third", "m1"), event(6, 3, "<@BOT>", "m9", images=1)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, H.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    answer = lambda question, history: F.concat(F.lit("re: "), question, F.lit(" after "), F.length(history))

    def seen():
        found = spark.read.schema(H.MESSAGES).parquet(f"{tmp_path}/out/batch=*")
        return sorted(map(tuple, found.collect()))

    stream = lambda: spark.readStream.schema(H.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    H.answer_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/check", answer).awaitTermination(200)
    first = seen()
    assert [m for m in first if m[0] == "m1"][0] == ("m1", 0, "user", "first\nsecond")
    assert ("m1", 1, "assistant", "re: first\nsecond after 0") in first and ("m1", 2, "user", "third") in first
    assert [m[3] for m in first if m[0] == "m9"] == ["<@BOT>", "re: <@BOT> after 0"] and len(first) == 6
    H.answer_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/check", answer).awaitTermination(200)
    assert seen() == first


def test_old_snapshots_go(spark, tmp_path):
    for i in range(4):
        spark.range(i + 1).write.parquet(f"{tmp_path}/batch={i:08d}")
    assert E.vacuum(spark, str(tmp_path), keep=2) == [0, 1] and E.finished(spark, str(tmp_path)) == [2, 3]
    assert E.vacuum(spark, str(tmp_path), keep=2) == [] and E.newest_snapshot(spark, str(tmp_path)).count() == 4
