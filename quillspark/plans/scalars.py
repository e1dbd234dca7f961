"""Queries of the scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, regexp_replace(substr(sha256(doc_id || ':0'), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS chunk_id FROM documents")
def chunk_id(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.chunk_id(F.col("doc_id"), F.lit(0)).alias("chunk_id"))


@query(r"SELECT doc_id, CASE WHEN coalesce(len(regexp_extract_all(text, '[\x{ac00}-\x{d7a3}]')) / nullif(len(regexp_extract_all(text, '[a-zA-Z\x{ac00}-\x{d7a3}]')), 0), 0) > 0.3 THEN 'ko' ELSE 'en' END AS language FROM documents")
def detect_language(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query("SELECT doc_id, (length(text) // 3)::BIGINT AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.estimate_tokens(F.col("text")).alias("n_tokens"))


def _sql_pattern(p: str) -> str:
    return p.replace("'", "''")


NAMES_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{_sql_pattern(p)}') THEN '{n}' END" for n, p, _ in T.PII_PATTERNS) + ")"
_last = "SELECT doc_id, text, text AS m0 FROM documents"
for _i, (_n, _p, _r) in enumerate(T.PII_PATTERNS):
    _last = f"SELECT doc_id, text, CASE WHEN regexp_matches(text, '{_sql_pattern(_p)}') THEN regexp_replace(m{_i}, '{_sql_pattern(_p)}', '{_r}', 'g') ELSE m{_i} END AS m{_i + 1} FROM ({_last})"


@query(f"SELECT doc_id, {NAMES_SQL} AS patterns FROM documents")
def pii_detect(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.pii_names(F.col("text")), ",").alias("patterns"))


@query(f"SELECT doc_id, m{len(T.PII_PATTERNS)} AS masked FROM ({_last})")
def pii_mask(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.pii_mask(F.col("text")).alias("masked"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("normal"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS short FROM documents")
def truncate_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.truncate(F.col("text"), 200, "...").alias("short"))


@query(r"SELECT conv_id, turn, coalesce(nullif(trim(regexp_replace('<@U01ABC> ' || text, '<@[A-Z0-9]+>', '', 'g')), ''), trim('<@U01ABC> ' || text)) AS cleaned FROM conversations")
def strip_mentions(spark, sf_dir):
    said = F.concat(F.lit("<@U01ABC> "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_mentions(said).alias("cleaned"))


REACTION_SQL = "CASE event_type WHEN 'click' THEN 'thumbsup' WHEN 'view' THEN '+1' WHEN 'purchase' THEN 'heart' WHEN 'error' THEN 'x' ELSE event_type END"
RATING_SQL = "CASE WHEN r IN (" + ", ".join(f"'{x}'" for x in T.POSITIVE_REACTIONS) + ") THEN 'positive' WHEN r IN (" + ", ".join(f"'{x}'" for x in T.NEGATIVE_REACTIONS) + ") THEN 'negative' END"


def reactions(spark, sf_dir):
    """Event types stand in for reactions."""
    kind = F.col("event_type")
    name = F.when(kind == "click", "thumbsup").when(kind == "view", "+1").when(kind == "purchase", "heart").when(kind == "error", "x").otherwise(kind)
    return table(spark, sf_dir, "events").withColumn("reaction", name)


@query(f"SELECT r AS reaction, {RATING_SQL} AS rating, count(*) AS n FROM (SELECT {REACTION_SQL} AS r FROM events) GROUP BY 1, 2")
def reaction_rating(spark, sf_dir):
    return reactions(spark, sf_dir).groupBy("reaction", T.reaction_rating(F.col("reaction")).alias("rating")).agg(F.count("*").alias("n"))


DOUBT_SQL = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in T.SQL_DOUBT) + ")"
CHAT_SQL = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in T.CHAT_DOUBT) + ")"


@query(f"SELECT conv_id, turn, greatest(0.5, least(1, 0.9 - CASE WHEN len(regexp_extract_all(text, 'JOIN')) > 3 THEN 0.1 ELSE 0 END - CASE WHEN {DOUBT_SQL} THEN 0.2 ELSE 0 END))::DOUBLE AS confidence FROM conversations")
def sql_confidence(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sql_confidence(F.col("text"), F.col("text")).cast("double").alias("confidence"))


@query(f"SELECT conv_id, turn, greatest(0.3, least(1, 0.8 - CASE WHEN length(text) < 50 THEN 0.1 ELSE 0 END - CASE WHEN {CHAT_SQL} THEN 0.2 ELSE 0 END))::DOUBLE AS confidence FROM conversations")
def chat_confidence(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.chat_confidence(F.col("text")).cast("double").alias("confidence"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'sql') THEN 'text_to_sql' WHEN contains(lower(text), 'knowledge') OR contains(lower(text), 'document') THEN 'knowledge' ELSE 'assistant' END AS intent FROM documents")
def intent(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.intent(F.col("text")).alias("intent"))


@query("SELECT doc_id, (length(text) - length(replace(text, ' ', '')))::BIGINT AS spaces, sha256('passage: ' || text) AS passage_sha256, sha256('query: ' || text) AS query_sha256 FROM documents")
def embedding_inputs(spark, sf_dir):
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" ")))
    prefixed = [F.sha2(F.concat(F.lit(f"{p}: "), "text"), 256).alias(f"{p}_sha256") for p in ("passage", "query")]
    return _docs(spark, sf_dir).select("doc_id", spaces.cast("long").alias("spaces"), *prefixed)


@query("SELECT doc_id, substr(sha256('Document ' || doc_id || ':' || substr(text, 1, 5000)), 1, 16) AS cache_key FROM documents")
def cache_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.substring(F.sha2(F.concat(F.lit("Document "), F.col("doc_id"), F.lit(":"), F.substring("text", 1, 5000)), 256), 1, 16).alias("cache_key"))


@query("SELECT doc_id, replace(regexp_replace(regexp_replace(text, '[0-9]{3,}', '<digits>', 'g'), '(?i)token', '<t>', 'g'), ' ', '_') AS masked FROM documents")
def pii_mask_own(spark, sf_dir):
    """Patterns of one's own, and a filter after them."""
    patterns = [("digits", "[0-9]{3,}", "<digits>"), ("token", "(?i)token", "[t]")]
    masked = T.pii_mask(F.col("text"), {"token": "<t>"}, patterns, (lambda c: F.replace(c, F.lit(" "), F.lit("_")),))
    return table(spark, sf_dir, "documents").select("doc_id", masked.alias("masked"))
