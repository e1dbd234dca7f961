"""Payloads of points, fields of results, validation of rows and completeness of columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a document that its chunks' payloads take over, and fields that a result has outside its metadata.
PROMOTED = [
    "notion_page_id", "notion_parent_id", "notion_database_id", "notion_last_edited_time",
    "api_endpoint", "http_method", "api_version", "operation_id", "tags",
    "content_type", "author", "category",
    "ai_content_type", "ai_topics", "ai_difficulty", "ai_has_code_samples", "ai_key_entities", "ai_summary",
]
RESULT_FIELDS = ["text", "content", "source_type", "source_id", "title", "url"]


def _or_empty(fields: Column) -> Column:
    return F.coalesce(fields, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def payload(base: Column, chunk: Column, document: Column, promoted: Iterable[str] = PROMOTED) -> Column:
    """One string map: ``base``, the chunk's fields that are not null and not in it, the document's promoted ones over both."""
    base, chunk, document = map(_or_empty, (base, chunk, document))
    over = F.map_filter(document, lambda k, v: k.isin(list(promoted)))
    own = F.map_concat(base, F.map_filter(chunk, lambda k, v: v.isNotNull() & ~F.map_contains_key(base, k)))
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(over, k)), over)


def result_fields(fields: Column) -> list[Column]:
    """content, source_type, source_id, source_title, source_url and metadata of a payload, with defaults for what is missing."""
    get = lambda *names: F.coalesce(*[F.try_element_at(fields, F.lit(n)) for n in names])
    return [
        F.coalesce(get("text", "content"), F.lit("")).alias("content"),
        F.coalesce(get("source_type"), F.lit("notion")).alias("source_type"),
        F.coalesce(get("source_id"), F.lit("")).alias("source_id"),
        F.coalesce(get("title", "source_title"), F.lit("Unknown")).alias("source_title"),
        get("url", "source_url").alias("source_url"),
        F.map_filter(fields, lambda k, v: ~k.isin(RESULT_FIELDS)).alias("metadata"),
    ]


def entries(fields: Column) -> Column:
    """A map as sorted key=value pairs; pairs without a value are left out."""
    return F.array_join(F.array_sort(F.array_compact(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), e["value"])))), ",")


def problems(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in their order; a rule that is null is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that keep all rules, and the others with the rules they break (column problems)."""
    valid = reduce(lambda a, b: a & b, [F.coalesce(ok, F.lit(False)) for ok in rules.values()], F.lit(True))
    return df.where(valid), df.where(~valid).withColumn("problems", problems(rules))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_rows, and the share of rows in which each column has a value; of an empty table null."""
    rows = F.count("*")
    return df.agg(rows.alias("n_rows"), *[F.round(F.try_divide(F.count(c), rows), 6).alias(c) for c in columns])


def keyword_route(question: Column) -> Column:
    """The chain that a question goes to, by the words in it; the first that fits."""
    has = lambda *words: reduce(lambda a, b: a | b, [F.coalesce(question.contains(w), F.lit(False)) for w in words])
    explain = has("설명해줘") & F.coalesce(question.rlike(r"(?i)\bselect\b"), F.lit(False))
    return F.when(has("테이블", "칼럼"), "data_discovery").when(has("문서", "Wiki"), "knowledge_discovery").when(explain, "query_assistant").otherwise("text_to_sql")
