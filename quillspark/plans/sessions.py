"""Queries of sessions, messages, events and a turn of a dialog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import model_json as M
from ..operators import sessions as S
from ..registry import query, table

COLUMNS = ["conv_id", "turn", "role", "text"]


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(COLUMNS)


#: New messages: a turn of each conversation, one of a session that isn't known, one role that isn't allowed.
NEW = "(SELECT conv_id * 2 AS conv_id, 1000 + turn AS turn, CASE WHEN turn % 3 = 2 THEN 'tool' ELSE role END AS role, text FROM conversations)"


@query(f"SELECT conv_id, turn, role, length(text)::BIGINT AS chars FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM {NEW} WHERE role IN ('user', 'assistant') AND conv_id IN (SELECT conv_id FROM conversations))")
def messages_appended(spark, sf_dir):
    known = _messages(spark, sf_dir)
    role = F.when(F.col("turn") % 3 == 2, "tool").otherwise(F.col("role"))
    new = known.select((F.col("conv_id") * 2).alias("conv_id"), (F.col("turn") + 1000).alias("turn"), role.alias("role"), "text")
    return S.append_messages(known, new, known).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("SELECT conv_id, turn, role, sha256(text) AS sha FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') UNION ALL SELECT item_id + 1000000000, 0, 'user', sha256(text) FROM benchmark UNION ALL SELECT item_id + 1000000000, 1, 'assistant', sha256('answer ' || item_id) FROM benchmark")
def session_saved_and_cleared(spark, sf_dir):
    """Sessions with a system message are cleared; pairs of a question and an answer are saved as new ones."""
    left = S.clear_sessions(_messages(spark, sf_dir), _messages(spark, sf_dir).where("role = 'system'").select("conv_id").distinct())
    pairs = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.col("text").alias("question"), F.concat(F.lit("answer "), "item_id").alias("answer"))
    return left.unionByName(S.save_pairs(pairs)).select("conv_id", "turn", "role", F.sha2("text", 256).alias("sha"))


@query("SELECT s.conv_id, count(c.turn) AS n_messages, min(c.turn) AS first_turn, max(c.turn) AS last_turn FROM (SELECT DISTINCT conv_id FROM conversations UNION SELECT n_nationkey + 1000000000 FROM nation) s LEFT JOIN conversations c ON c.conv_id = s.conv_id GROUP BY s.conv_id")
def sessions_with_messages(spark, sf_dir):
    known = _messages(spark, sf_dir)
    empty = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1_000_000_000).cast("long").alias("conv_id"))
    return S.with_messages(known.select("conv_id").unionByName(empty), known)


@query("SELECT 'feedback:' || e.event_id AS key, e.ts AS at, l.quality FROM events e JOIN labels l ON l.doc_id = e.event_id")
def indexed_feedback(spark, sf_dir):
    """The index of times names more records than there are."""
    index = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("at"))
    return S.fetch(index, table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select(S.key_of("feedback", F.col("doc_id").cast("string")).alias("key"), "at", "quality")


@query("SELECT conv_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS history FROM conversations GROUP BY conv_id")
def history_flat(spark, sf_dir):
    known = _messages(spark, sf_dir)
    return S.flat_history(known).join(known.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id").select("conv_id", "n", "history")


PAIRED = "(SELECT conv_id, turn // 2 AS turn, max(text) FILTER (role = 'user') AS u, max(text) FILTER (role = 'assistant' AND turn % 4 <> 3) AS a FROM conversations GROUP BY conv_id, turn // 2)"


@query(f"SELECT conv_id, sum((coalesce(u, '') <> '')::INT + (coalesce(a, '') <> '')::INT)::BIGINT AS n, sha256(coalesce(string_agg(concat_ws(chr(10), 'user:' || nullif(u, ''), 'assistant:' || nullif(a, '')), chr(10) ORDER BY turn) FILTER (coalesce(u, '') <> '' OR coalesce(a, '') <> ''), '')) AS sha FROM {PAIRED} GROUP BY conv_id")
def history_list(spark, sf_dir):
    """The history as a list of messages; of some pairs the answer is missing."""
    both = _messages(spark, sf_dir).groupBy("conv_id", F.floor(F.col("turn") / 2).alias("turn")).agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_message"), F.max(F.when((F.col("role") == "assistant") & (F.col("turn") % 4 != 3), F.col("text"))).alias("assistant_message"))
    said = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return S.history_messages(both).select("conv_id", F.size("history").cast("long").alias("n"), F.sha2(said, 256).alias("sha"))


@query("SELECT conv_id, count(*) AS n, sha256(string_agg(role || chr(10) || text, chr(10) ORDER BY turn, role, text)) AS sha FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def model_messages(spark, sf_dir):
    """The messages in the format of a model, read back from their JSON."""
    read = S.model_messages(_messages(spark, sf_dir)).withColumn("m", F.from_json("messages", "array<struct<role:string,content:string>>"))
    said = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("\n"), x["content"])), "\n")
    return read.select("conv_id", F.size("m").cast("long").alias("n"), F.sha2(said, 256).alias("sha"))


LAST = "(SELECT conv_id, max(turn) + 1 AS turn FROM conversations GROUP BY conv_id)"
RECENT = "(SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) WHERE n <= 10 GROUP BY conv_id)"


@query(f"SELECT l.conv_id, l.turn, 'user' AS role, 'Question ' || l.conv_id AS text FROM {LAST} l UNION ALL SELECT l.conv_id, l.turn + 1, 'assistant', CASE WHEN l.conv_id % 5 = 0 THEN '{S.NO_ANSWER}' ELSE 'Seen ' || length(r.history) END FROM {LAST} l JOIN {RECENT} r ON r.conv_id = l.conv_id")
def dialog_turn(spark, sf_dir):
    """A turn of every conversation; the stand-in for the model answers with the history's length, and now and then nothing."""
    known = _messages(spark, sf_dir)
    asked = known.select("conv_id").distinct().select("conv_id", F.concat(F.lit("Question "), "conv_id").alias("question"))
    answer = lambda question, history: F.when(F.substring_index(question, " ", -1).cast("long") % 5 != 0, F.concat(F.lit("Seen "), F.length(history)))
    return S.next_turn(known, asked, answer)


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, ''), event_id::VARCHAR) AS thread, channel, channel LIKE 'D%' AS is_dm FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'D' ELSE 'C' END || user_id AS channel FROM events) WHERE channel LIKE 'D%' AND event_type NOT IN ('error', 'signup')")
def direct_messages(spark, sf_dir):
    """Messages to the bot in private: none of a bot (here errors) and none of a subtype (here signups)."""
    channel = F.concat(F.when(F.col("user_id") % 2 == 0, "D").otherwise("C"), F.col("user_id"))
    thread = F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("")
    seen = table(spark, sf_dir, "events").select("event_id", channel.alias("channel"), thread.alias("thread_ts"), F.when(F.col("event_type") == "error", "B1").alias("bot_id"), F.when(F.col("event_type") == "signup", "joined").alias("subtype"))
    kept = S.to_bot(seen)
    return kept.select("event_id", S.thread_of(F.col("thread_ts"), F.col("event_id").cast("string")).alias("thread"), "channel", S.is_private(F.col("channel")).alias("is_dm"))


@query("SELECT conv_id, turn FROM conversations WHERE trim(CASE WHEN turn % 4 = 1 THEN '  ' ELSE text END) <> '' OR conv_id % 3 = 0")
def messages_worth_an_answer(spark, sf_dir):
    text, images = F.when(F.col("turn") % 4 == 1, "  ").otherwise(F.col("text")), F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0)
    return _messages(spark, sf_dir).select("conv_id", "turn", text.alias("text"), images.alias("n_images")).where(S.has_content(F.col("text"), F.col("n_images"))).select("conv_id", "turn")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, event_type, value FROM events")
def json_records(spark, sf_dir):
    """Events as JSON and back."""
    packed = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", M.iso_time(F.col("ts")).alias("at"), "event_type", "value")).alias("record"))
    return packed.select(F.from_json("record", "event_id long, at string, event_type string, value double").alias("r")).select("r.*")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 4 <> 0 THEN lang END, 'general') AS content_type, least(doc_id % 9, 5)::BIGINT AS n_topics, CASE WHEN doc_id % 4 = 0 THEN '' ELSE substr(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g'), 1, 500) END AS summary FROM (SELECT doc_id, lang, text FROM documents) WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'general', 0, '' FROM documents WHERE doc_id % 4 = 0")
def model_metadata(spark, sf_dir):
    """Metadata from what a model says: fenced JSON with too many topics and too long a summary, or no JSON at all."""
    said = F.to_json(F.struct(F.col("lang").alias("content_type"), F.slice(F.array(*[F.lit(f"t{i}") for i in range(9)]), 1, (F.col("doc_id") % 9).cast("int")).alias("topics"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]", "").alias("summary")))
    answer = F.when(F.col("doc_id") % 4 == 0, "no idea").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), said, F.lit("\n```\nDone"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("```"), said, F.lit("```"))).otherwise(said)
    found = table(spark, sf_dir, "documents").select("doc_id", M.metadata(answer).alias("m"))
    return found.select("doc_id", F.col("m.content_type").alias("content_type"), F.size("m.topics").cast("long").alias("n_topics"), F.col("m.summary").alias("summary"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Name ' || page_id WHEN 1 THEN 'Own ' || page_id WHEN 2 THEN 'First ' || page_id ELSE '제목 없음' END AS title, CASE WHEN page_id % 2 = 0 THEN '★' ELSE url END AS icon FROM pages")
def page_titles(spark, sf_dir):
    """Titles under a known name, under another, under two, and none."""
    item = lambda words: F.array(F.struct(F.lit(words).alias("plain_text")), F.struct(F.col("page_id").cast("string").alias("plain_text")))
    prop = lambda kind, words: F.struct(F.lit(kind).alias("type"), item(words).alias("title"))
    k = F.col("page_id") % 4
    properties = F.when(k == 0, F.create_map(F.lit("Status"), prop("select", "x"), F.lit("Name"), prop("title", "Name "))).when(k == 1, F.create_map(F.lit("Heading"), prop("title", "Own "))).when(k == 2, F.create_map(F.lit("name"), prop("title", "second "), F.lit("Title"), prop("title", "First "))).otherwise(F.create_map(F.lit("Name"), prop("select", "y")))
    icon = F.struct(F.when(F.col("page_id") % 2 == 0, "emoji").otherwise("external").alias("type"), F.lit("★").alias("emoji"), F.struct("url").alias("external"))
    return table(spark, sf_dir, "pages").select("page_id", M.page_title(properties).alias("title"), M.page_icon(icon).alias("icon"))
