"""Conversation windows, turn pairs, context summaries and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS


def tail(messages: DataFrame, n: int = DEFAULTS.history) -> DataFrame:
    """The last n messages of each conversation."""
    order = W.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return messages.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def summary(messages: DataFrame, max_chars: int = DEFAULTS.summary_chars) -> DataFrame:
    """(conv_id, summary): the newest lines that fit, in order of time. The break at the first overflow is a bound on a running sum."""
    line = F.concat(F.when(F.col("role") == "user", "사용자: ").otherwise("어시스턴트: "), F.col("text"))
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text").rowsBetween(W.unboundedPreceding, 0)
    kept = messages.withColumn("line", line).withColumn("used", F.sum(F.length("line") + 1).over(newest) - 1).where(F.col("used") <= max_chars)
    rows = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("rows"))
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("summary"))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """User messages with the assistant's next one; without one the answer is null, answers without a question are dropped."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    after = messages.withColumn("next_role", F.lead("role").over(order)).withColumn("next_text", F.lead("text").over(order))
    return after.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"))


def preceding_question(messages: DataFrame) -> DataFrame:
    """Each answer with the message before it that isn't the assistant's; else the first message of the thread."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    asked = F.when(F.col("role") != "assistant", F.col("text"))
    before = F.last(asked, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    first = F.first("text").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return messages.withColumn("question", F.coalesce(before, first)).where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"), "question")


def feedback_stats(feedback: DataFrame, newest: int = DEFAULTS.feedback_window) -> DataFrame:
    """total, positive, negative and their ratio over the newest rows (rating, ts, id)."""
    seen = feedback.orderBy(F.desc("ts"), F.desc("id")).limit(newest)
    positive = F.count_if(F.col("rating") == "positive")
    return seen.agg(F.count("*").alias("total"), positive.alias("positive"), F.count_if(F.col("rating") == "negative").alias("negative"), F.coalesce(F.try_divide(positive, F.count("*")), F.lit(0.0)).alias("positive_ratio"))


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap_seconds: int = 10_800) -> DataFrame:
    """(key, start, end, n): a message within the gap of the one before re-arms the session."""
    order = W.partitionBy(key).orderBy(ts)
    fresh = F.when(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp")) <= gap_seconds * 1_000_000, 0).otherwise(1)
    numbered = events.withColumn("_new", fresh).withColumn("_session", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_session").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("n_events")).drop("_session")
