"""What a bot does with events, by kind: mentions, direct messages and reactions, alike over a table and a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import reaction_rating, strip_mentions
from ..operators import sessions
from .events import finished

#: ``at`` is the time of the event, the other times are names of messages, as the service gives them.
EVENTS = "event_id string, at timestamp, kind string, user string, channel string, text string, message_ts string, thread_ts string, bot_id string, subtype string, n_images int, reaction string, item_user string, item_ts string"


def once(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Each event_id once, as events are sent again until they are confirmed.

    A stream forgets an id once the watermark, ``lateness`` behind the newest event, has passed it; rows that are older
    still are dropped. A table keeps the row of the earliest time.
    """
    if events.isStreaming:
        return events.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["event_id"])
    rest = [c for c in events.columns if c not in ("event_id", "at")]
    first = events.groupBy("event_id").agg(F.min(F.struct("at", *rest)).alias("e"))
    return first.select("event_id", "e.*").select(*events.columns)


def mentions(events: DataFrame) -> DataFrame:
    """Messages that name the bot, in channels."""
    return events.where("kind = 'app_mention' and bot_id is null")


def direct_messages(events: DataFrame) -> DataFrame:
    """Messages to the bot alone: none of a bot and none of a subtype, such as edits."""
    return sessions.to_bot(events.where("kind = 'message'"))


def reactions(events: DataFrame, bot: str | None) -> DataFrame:
    """Reactions that rate a message of the bot, with their rating. Without a known bot those on any user's message count."""
    owned = F.coalesce("item_user", F.lit("")) != "" if bot is None else F.col("item_user") == bot
    return events.where((F.col("kind") == "reaction_added") & owned).withColumn("rating", reaction_rating(F.col("reaction"))).where("rating is not null")


def rated_answers(rated: DataFrame, answers: DataFrame, within: str = "1 day", lateness: str | None = "10 minutes") -> DataFrame:
    """(message_ts, thread, channel, user, answer, rating, reaction, at): reactions with the message they are on.

    ``answers`` are messages (channel, message_ts, thread_ts, text, at). Both streams wait for each other: a reaction is
    matched if it comes after its message and no later than ``within``, so their state is bounded by that time. Streams
    that have a watermark already, as those of ``once`` do, take no ``lateness``.
    """
    if lateness and rated.isStreaming:
        rated, answers = rated.withWatermark("at", lateness), answers.withWatermark("at", lateness)
    r = rated.select(F.col("channel").alias("r_channel"), F.col("item_ts").alias("r_item"), "user", "rating", "reaction", F.col("at").alias("r_at"))
    a = answers.select("channel", "message_ts", sessions.thread_of(F.col("thread_ts"), F.col("message_ts")).alias("thread"), F.col("text").alias("answer"), F.col("at").alias("a_at"))
    same = (F.col("r_channel") == F.col("channel")) & (F.col("r_item") == F.col("message_ts"))
    timely = (F.col("r_at") >= F.col("a_at")) & (F.col("r_at") <= F.col("a_at") + F.expr(f"INTERVAL {within}"))
    return r.join(a, same & timely).select("message_ts", "thread", "channel", "user", "answer", "rating", "reaction", F.col("r_at").alias("at"))


def sliding(events: DataFrame, by: str, width: str = "2 hours", slide: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(by, window_start, n): counts in windows that overlap; rows older than the watermark are no longer counted in a stream."""
    timed = events.withWatermark("at", lateness) if events.isStreaming else events
    return timed.groupBy(by, F.window("at", width, slide).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


def questions(events: DataFrame) -> DataFrame:
    """(thread, channel, at, question): what mentions and direct messages ask, without the tags; blank ones without images ask nothing."""
    asked = mentions(events).unionByName(direct_messages(events))
    kept = asked.where(sessions.has_content(strip_mentions(F.coalesce("text", F.lit(""))), F.col("n_images")))
    return kept.select(sessions.thread_of(F.col("thread_ts"), F.col("message_ts")).alias("thread"), "channel", "at", strip_mentions(F.coalesce("text", F.lit(""))).alias("question"))


MESSAGES = "conv_id string, turn long, role string, text string"


def answer_stream(events: DataFrame, folder: str, checkpoint: str, answer: Callable[[Column, Column], Column], lateness: str = "10 minutes") -> StreamingQuery:
    """Answers what a stream of events asks: each batch's questions with the threads' history, questions and answers saved under its number.

    A thread (conv_id) that asks more than once in a batch gets its questions as one, in order. Messages of a batch have a
    folder of their own, so a batch that runs again writes the same ones and sees those of earlier batches only. Works
    off what there is and stops.
    """

    def respond(batch: DataFrame, number: int) -> None:
        asked = batch.groupBy("thread").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "question"))), lambda q: q["question"]), "\n").alias("question"))
        asked = asked.select(F.col("thread").alias("conv_id"), "question")
        before = [f"{folder}/batch={n:08d}" for n in finished(batch.sparkSession, folder) if n < number]
        spark = batch.sparkSession
        known = spark.read.schema(MESSAGES).parquet(*before) if before else spark.createDataFrame([], MESSAGES)
        sessions.next_turn(known, asked, answer).select("conv_id", "turn", "role", "text").write.mode("overwrite").parquet(f"{folder}/batch={number:08d}")

    return questions(once(events, lateness)).writeStream.foreachBatch(respond).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
