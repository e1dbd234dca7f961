"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

# Sensitive patterns in their order, and what replaces them.
PII_PATTERNS = [
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[이메일]"),
    ("phone_kr", r"01[0-9]-?\d{3,4}-?\d{4}", "[전화번호]"),
    ("phone_landline", r"0\d{1,2}-?\d{3,4}-?\d{4}", "[전화번호]"),
    ("resident_id", r"\d{6}-?[1-4]\d{6}", "[주민번호]"),
    ("credit_card", r"\d{4}-?\d{4}-?\d{4}-?\d{4}", "[카드번호]"),
    ("api_key", r"(sk-|xoxb-|xapp-|Bearer\s+)[a-zA-Z0-9_-]{20,}", "[API키]"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP주소]"),
    ("password_pattern", r"(?i)(password|passwd|pwd|비밀번호|패스워드)\s*[:=]\s*\S+", "[비밀번호]"),
]
# Reactions by rating.
POSITIVE_REACTIONS = ["+1", "thumbsup", "white_check_mark", "heavy_check_mark", "heart", "star", "clap", "tada", "100"]
NEGATIVE_REACTIONS = ["-1", "thumbsdown", "x", "no_entry", "no_entry_sign", "disappointed"]
# Words of doubt of SQL answers and of chat answers; statements that aren't read-only.
SQL_DOUBT = ["might", "maybe", "possibly", "uncertain"]
CHAT_DOUBT = ["잘 모르겠", "확실하지 않", "아마도", "possibly", "maybe", "might", "uncertain"]
WRITE_WORDS = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "CREATE"]
HANGUL, LETTERS = r"[가-힣]", r"[a-zA-Z가-힣]"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(*parts: Column) -> Column:
    """A UUID of the first 16 bytes of the SHA-256 of the parts joined by colons."""
    key = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.regexp_replace(F.substring(F.sha2(key, 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def detect_language(text: Column) -> Column:
    """ko if over 0.3 of the Latin and Hangul letters are Hangul, else en."""
    total = F.regexp_count(text, F.lit(LETTERS))
    ratio = F.regexp_count(text, F.lit(HANGUL)) / F.nullif(total, F.lit(0))
    return F.when(F.coalesce(ratio, F.lit(0.0)) > 0.3, "ko").otherwise("en")


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 3).cast("long")


Patterns = list[tuple[str, str, str]]


def pii_names(text: Column, patterns: Patterns = PII_PATTERNS) -> Column:
    """Names of the sensitive patterns found, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p, _ in patterns]))


def pii_mask(text: Column, own: dict[str, str] | None = None, patterns: Patterns = PII_PATTERNS, filters: tuple[Callable[[Column], Column], ...] = ()) -> Column:
    """Replaces pattern after pattern; a pattern counts if it is in the original text.

    ``own``: other replacements by name; ``patterns``: others than the usual ones (name, expression, replacement);
    ``filters``: functions of the masked text that are applied after them, in order.
    """
    masked = lambda c, p: let(c, lambda x: F.when(text.rlike(p[1]), F.regexp_replace(x, p[1], (own or {}).get(p[0], p[2]))).otherwise(x))
    return reduce(lambda c, f: f(c), filters, reduce(masked, patterns, text))


def strip_mentions(text: Column) -> Column:
    """Without mention tags; a text of nothing else stays."""
    cleaned = F.trim(F.regexp_replace(text, "<@[A-Z0-9]+>", ""))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.trim(text))


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, size: int, mark: str = "") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def reaction_rating(reaction: Column) -> Column:
    return F.when(reaction.isin(POSITIVE_REACTIONS), "positive").when(reaction.isin(NEGATIVE_REACTIONS), "negative")


def _any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in words])


def _decimal(x: str) -> Column:
    return F.lit(x).cast("decimal(3,2)")


def sql_confidence(sql: Column, answer: Column) -> Column:
    base = _decimal("0.9") - F.when(F.regexp_count(sql, F.lit("JOIN")) > 3, _decimal("0.1")).otherwise(_decimal("0")) - F.when(_any_word(answer, SQL_DOUBT), _decimal("0.2")).otherwise(_decimal("0"))
    return F.greatest(_decimal("0.5"), F.least(_decimal("1"), base.cast("decimal(3,2)")))


def chat_confidence(answer: Column) -> Column:
    base = _decimal("0.8") - F.when(F.length(answer) < 50, _decimal("0.1")).otherwise(_decimal("0")) - F.when(_any_word(answer, CHAT_DOUBT), _decimal("0.2")).otherwise(_decimal("0"))
    return F.greatest(_decimal("0.3"), F.least(_decimal("1"), base.cast("decimal(3,2)")))


def intent(answer: Column) -> Column:
    said = F.lower(F.trim(answer))
    return F.when(said.contains("sql"), "text_to_sql").when(said.contains("knowledge") | said.contains("document"), "knowledge").otherwise("assistant")


def extract_sql(answer: Column) -> Column:
    """The fenced block, else the SELECT at the end (with its semicolon), else the whole answer."""
    fenced = F.regexp_extract(answer, r"(?is)```sql\s*(.*?)\s*```", 1)
    select = F.trim(F.regexp_extract(answer, r"(?is)(SELECT\s+.*?;?)\s*$", 1))
    ended = F.when(select.endswith(";"), select).otherwise(F.concat(select, F.lit(";")))
    return F.when(answer.rlike(r"(?is)```sql\s*(.*?)\s*```"), F.trim(fenced)).when(select != "", ended).otherwise(F.trim(answer))


def sql_problem(sql: Column) -> Column:
    """Why a statement is refused; null if it may run."""
    found = [F.when(F.upper(sql).rlike(rf"\b{w}\b"), F.lit(f"Dangerous operation detected: {w}")) for w in WRITE_WORDS]
    empty = F.when(F.coalesce(sql, F.lit("")) == "", "SQL query is empty")
    return F.coalesce(empty, F.when(~F.upper(F.trim(sql)).startswith("SELECT"), "Only SELECT statements are allowed"), *found)


def tokens(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda t: t != "")


def retryable(status: Column, code: Column) -> Column:
    """Whether a failed call may be tried again: too many requests, server errors, and codes that say so."""
    return F.coalesce((status == 429) | (status >= 500) | code.isin("rate_limited", "internal_server_error", "service_unavailable"), F.lit(False))


def nfc(text: Column) -> Column:
    """Composed characters (NFC), for which Spark has no function; ASCII texts are passed through by the JVM."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFC")

    return F.when(text.rlike(r"[^\x00-\x7F]"), composed(text)).otherwise(text)
