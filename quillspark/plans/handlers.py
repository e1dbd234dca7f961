"""Queries of the bot's events. The table ``events`` stands in: views are answers of the bot, clicks are reactions to an event before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming import handlers as H

KINDS = ["+1", "x", "eyes", "heart"]


def bot_events(events):
    """Rows of ``events`` as EVENTS. A click reacts to one of the five events before it, of a bot where the user's id isn't divisible by 3."""
    kind, user, eid = F.col("event_type"), F.col("user_id"), F.col("event_id")
    click = kind == "click"
    return events.select(
        eid.cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("at"), F.when(click, "reaction_added").when(kind == "signup", "app_mention").otherwise("message").alias("kind"),
        F.when(kind == "view", "BOT").otherwise(F.concat(F.lit("U"), user)).alias("user"), F.lit("D1").alias("channel"), F.concat(F.lit("<@BOT> "), kind, F.lit(" "), F.col("value").cast("string")).alias("text"),
        eid.cast("string").alias("message_ts"), F.when(eid % 2 == 0, F.concat(F.lit("t"), user)).alias("thread_ts"), F.when(kind == "view", "B1").alias("bot_id"), F.when(kind == "error", "changed").alias("subtype"), F.lit(0).alias("n_images"),
        F.when(click, F.element_at(F.array(*map(F.lit, KINDS)), (eid % 4 + 1).cast("int"))).alias("reaction"), F.when(click & (user % 3 != 0), "BOT").when(click, F.lit("U0")).alias("item_user"), F.when(click, (eid - 1 - eid % 5).cast("string")).alias("item_ts"),
    )


@query("""SELECT c.event_id::VARCHAR AS item_of, v.event_id::VARCHAR AS message_ts, coalesce(CASE WHEN v.event_id % 2 = 0 THEN 't' || v.user_id END, v.event_id::VARCHAR) AS thread, 'U' || c.user_id AS rater,
 CASE c.event_id % 4 WHEN 1 THEN 'negative' ELSE 'positive' END AS rating FROM events c JOIN events v ON v.event_id = c.event_id - 1 - c.event_id % 5
 WHERE c.event_type = 'click' AND v.event_type = 'view' AND c.user_id % 3 <> 0 AND c.event_id % 4 <> 2 AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 20 MINUTE""")
def rated_answers(spark, sf_dir):
    """Ratings of the bot's own messages within twenty minutes, events sent twice."""
    sent = bot_events(table(spark, sf_dir, "events"))
    events = H.once(sent.unionByName(sent))
    found = H.rated_answers(H.reactions(events, "BOT"), events.where("user = 'BOT'"), "20 minutes")
    item = events.where("kind = 'reaction_added'").select(F.col("event_id").alias("item_of"), F.col("at"), F.col("user"))
    return found.join(item, ["at", "user"]).select("item_of", "message_ts", "thread", F.col("user").alias("rater"), "rating")


@query("""SELECT kind, w AS window_start, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'reaction_added' WHEN 'signup' THEN 'app_mention' ELSE 'message' END AS kind,
 unnest([time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 90 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 60 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts)]) AS w FROM events) GROUP BY kind, w""")
def sliding_counts(spark, sf_dir):
    return H.sliding(bot_events(table(spark, sf_dir, "events")), "kind")


@query("""SELECT coalesce(CASE WHEN event_id % 2 = 0 THEN 't' || user_id END, event_id::VARCHAR) AS thread, count(*) AS n, sha256(string_agg(event_type || ' ' || event_id, ',' ORDER BY event_id)) AS sha FROM events
 WHERE event_type IN ('signup', 'purchase') GROUP BY 1""")
def bot_questions(spark, sf_dir):
    """What is asked in each thread: mentions and direct messages, none of bots, none that were changed."""
    events = bot_events(table(spark, sf_dir, "events")).withColumn("text", F.concat(F.lit("<@BOT> "), F.split("text", " ")[1], F.lit(" "), "event_id"))
    asked = H.questions(events).select("thread", "question", F.substring_index("question", " ", -1).cast("long").alias("nth"))
    lists = asked.groupBy("thread").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("nth", "question"))).alias("q"))
    return lists.select("thread", "n", F.sha2(F.array_join(F.transform("q", lambda x: x["question"]), ","), 256).alias("sha"))
