"""Queries of conversations, feedback and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import reaction_rating as rating_of
from ..operators import dialog as D
from ..operators import tables as B
from ..registry import query, table
from .scalars import RATING_SQL, REACTION_SQL, reactions

MESSAGES = "(SELECT * FROM conversations WHERE role IN ('user', 'assistant'))"


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")


@query(f"SELECT conv_id, turn, role FROM {MESSAGES} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def conversation_tail(spark, sf_dir):
    return D.tail(_messages(spark, sf_dir), 3).select("conv_id", "turn", "role")


@query(f"SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS summary FROM (SELECT conv_id, turn, line, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) - 1 AS used FROM (SELECT *, CASE WHEN role = 'user' THEN '사용자: ' ELSE '어시스턴트: ' END || text AS line FROM {MESSAGES})) WHERE used <= 2000 GROUP BY conv_id")
def conversation_summary(spark, sf_dir):
    return D.summary(_messages(spark, sf_dir))


@query(f"SELECT conv_id, turn, question, CASE WHEN next_role = 'assistant' THEN next_text END AS answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM {MESSAGES} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'")
def turn_pairs(spark, sf_dir):
    return D.turn_pairs(_messages(spark, sf_dir))


@query(f"SELECT conv_id, turn, text AS answer, coalesce(last_value(CASE WHEN role <> 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS question FROM {MESSAGES} QUALIFY role = 'assistant'")
def preceding_question(spark, sf_dir):
    return D.preceding_question(_messages(spark, sf_dir))


FEEDBACK = f"(SELECT event_id AS id, ts, user_id, {RATING_SQL} AS rating FROM (SELECT *, {REACTION_SQL} AS r FROM events) WHERE rating IS NOT NULL)"


def _feedback(spark, sf_dir):
    return reactions(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", "user_id", rating_of(F.col("reaction")).alias("rating")).where("rating is not null")


@query(f"SELECT count(*) AS total, count(*) FILTER (rating = 'positive') AS positive, count(*) FILTER (rating = 'negative') AS negative, coalesce(count(*) FILTER (rating = 'positive') / nullif(count(*), 0), 0)::DOUBLE AS positive_ratio FROM (SELECT * FROM {FEEDBACK} ORDER BY ts DESC, id DESC LIMIT 1000)")
def feedback_stats(spark, sf_dir):
    return D.feedback_stats(_feedback(spark, sf_dir))


@query(f"SELECT id, ts, rating FROM {FEEDBACK} ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 40")
def feedback_page(spark, sf_dir):
    return _feedback(spark, sf_dir).orderBy(F.desc("ts"), F.desc("id")).offset(40).limit(20).select("id", "ts", "rating")


@query(f"SELECT user_id, id, rating FROM {FEEDBACK} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) = 1")
def feedback_last_write(spark, sf_dir):
    return B.last_write(_feedback(spark, sf_dir), "user_id", [F.desc("ts"), F.desc("id")]).select("user_id", "id", "rating")


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM b GROUP BY user_id, s")
def sessions_3h(spark, sf_dir):
    return D.sessions(table(spark, sf_dir, "events"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    from ..streaming.events import tumbling

    return tumbling(table(spark, sf_dir, "events"))
