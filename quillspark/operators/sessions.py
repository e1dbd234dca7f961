"""Sessions with their messages: appends, pairs, clearing, look-ups, message formats and a turn of a dialog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from .dialog import tail

# Roles that a message may have, and what is said where no answer came.
ROLES = ["user", "assistant"]
NO_ANSWER = "관련 문서를 찾을 수 없습니다. 다른 키워드로 질문해 주세요."


def append_messages(messages: DataFrame, new: DataFrame, sessions: DataFrame) -> DataFrame:
    """``messages`` and the new ones of a known session (conv_id) and an allowed role."""
    allowed = new.where(F.col("role").isin(ROLES)).join(sessions.select("conv_id").distinct(), "conv_id", "left_semi")
    return messages.unionByName(allowed.select(messages.columns))


def save_pairs(pairs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): two messages for each (conv_id, turn, question, answer), a null answer left out."""
    both = F.array(F.struct(F.col("turn").alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct((F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return pairs.select("conv_id", F.explode(both).alias("m")).select("conv_id", "m.*").where("text is not null")


def clear_sessions(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select("conv_id"), "conv_id", "left_anti")


def with_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, n_messages, first_turn, last_turn) of every session, 0 messages too."""
    known = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    return sessions.select("conv_id").distinct().join(known, "conv_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


def fetch(index: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The records that an index of times names, newest first in ``at``; names without a record are skipped."""
    return index.join(records, key)


def key_of(kind: str, name: Column) -> Column:
    """The name under which a record is kept."""
    return F.concat(F.lit(f"{kind}:"), name)


def model_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, messages): the conversation as an array of role and content in JSON, users and assistants only."""
    rows = messages.where("role in ('user', 'assistant')").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    said = F.transform("rows", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return rows.select("conv_id", F.to_json(said).alias("messages"))


def flat_history(messages: DataFrame) -> DataFrame:
    """(conv_id, history): a line of role and text for each message, in order of turns."""
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))).alias("rows"))
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda m: m["line"]), "\n").alias("history"))


def history_messages(pairs: DataFrame) -> DataFrame:
    """(conv_id, history): an array of role and content, in order of turns, of (conv_id, turn, user_message, assistant_message).

    Of each pair the user's message comes first; a half that is null or empty is left out, a conversation without any keeps an empty list.
    """
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    both = F.array(said("user", F.col("user_message")), said("assistant", F.col("assistant_message")))
    rows = pairs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", both.alias("both")))).alias("rows"))
    every = F.flatten(F.transform("rows", lambda r: r["both"]))
    return rows.select("conv_id", F.filter(every, lambda m: F.coalesce(m["content"], F.lit("")) != "").alias("history"))


def next_turn(messages: DataFrame, questions: DataFrame, answer: Callable[[Column, Column], Column], history: int = DEFAULTS.history) -> DataFrame:
    """The two messages that a turn adds to each conversation: the question and its answer.

    ``answer`` makes an answer from question and history; a blank one becomes the fixed reply. The turn follows the
    last one of the conversation, 0 where it is new.
    """
    last = messages.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    asked = questions.join(last, "conv_id", "left").withColumn("turn", F.coalesce("turn", F.lit(0))).join(flat_history(tail(messages, history)), "conv_id", "left")
    said = answer(F.col("question"), F.coalesce("history", F.lit("")))
    return save_pairs(asked.select("conv_id", "turn", "question", F.coalesce(F.nullif(F.trim(said), F.lit("")), F.lit(NO_ANSWER)).alias("answer")))


def to_bot(events: DataFrame) -> DataFrame:
    """Events (channel, bot_id, subtype) of a private channel that no bot sent and that have no subtype; batch or stream."""
    return events.where(is_private(F.col("channel")) & F.col("bot_id").isNull() & F.col("subtype").isNull())


def is_private(channel: Column) -> Column:
    return channel.startswith("D")


def thread_of(thread: Column, own: Column) -> Column:
    """The thread of a message, its own time where it has none."""
    return F.coalesce(F.nullif(thread, F.lit("")), own)


def has_content(text: Column, n_images: Column) -> Column:
    """False for blank messages without an image."""
    return (F.trim(F.coalesce(text, F.lit(""))) != "") | (F.coalesce(n_images, F.lit(0)) > 0)
