"""What a model says as JSON, with defaults; records as JSON; titles and metadata of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

METADATA = "struct<content_type:string,topics:array<string>,difficulty:string,has_code_samples:boolean,key_entities:array<string>,summary:string>"
# Property names in which a page's title is looked for, in this order, and the title of a page without one.
TITLE_NAMES = ["title", "Title", "Name", "name", "이름"]
UNTITLED = "제목 없음"


def fenced_json(answer: Column) -> Column:
    """What stands in the first code block, one marked as JSON before others; else the whole answer, trimmed."""
    after = lambda a, mark: F.get(F.split(a, mark, 2), F.lit(1))
    return let(answer, lambda a: F.trim(F.coalesce(F.substring_index(F.coalesce(after(a, "```json"), after(a, "```")), "```", 1), a)))


def metadata(answer: Column) -> Column:
    """METADATA of an answer: five topics, ten entities and 500 characters at most; defaults for what is missing or can't be read."""
    none = F.array().cast("array<string>")
    fields = lambda found: F.struct(
        F.coalesce(found["content_type"], F.lit("general")).alias("content_type"),
        F.slice(F.coalesce(found["topics"], none), 1, 5).alias("topics"),
        F.coalesce(found["difficulty"], F.lit("intermediate")).alias("difficulty"),
        F.coalesce(found["has_code_samples"], F.lit(False)).alias("has_code_samples"),
        F.slice(F.coalesce(found["key_entities"], none), 1, 10).alias("key_entities"),
        F.substring(F.coalesce(found["summary"], F.lit("")), 1, 500).alias("summary"),
    )
    return let(F.from_json(fenced_json(answer), METADATA), fields)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def rich_text(items: Column) -> Column:
    """The texts of array<struct<plain_text>> joined."""
    return F.array_join(F.transform(items, lambda x: F.coalesce(x["plain_text"], F.lit(""))), "")


def page_title(properties: Column) -> Column:
    """The title of map<string, struct<type, title>>: of the known names first, then of any property that is a title."""
    use = lambda p: F.when((p["type"] == "title") & (F.size(p["title"]) > 0), rich_text(p["title"]))
    named = [use(F.try_element_at(properties, F.lit(n))) for n in TITLE_NAMES]
    rest = F.filter(F.transform(F.map_values(properties), use), lambda t: t.isNotNull())
    return F.coalesce(*named, F.get(rest, F.lit(0)), F.lit(UNTITLED))


def page_icon(icon: Column) -> Column:
    """The emoji or address of struct<type, emoji, external: struct<url>>."""
    return F.when(icon["type"] == "emoji", icon["emoji"]).when(icon["type"] == "external", icon["external"]["url"])


def schema_prompt(tables: list[str], columns: Column) -> Column:
    """Tables of a map<string, array<string>> with their columns, an empty line after each."""
    part = lambda t: F.concat(F.lit(f"Table: {t}\n"), F.array_join(F.transform(columns[t], lambda c: F.concat(F.lit("  - "), c)), "\n"), F.lit("\n"))
    return reduce(lambda a, b: F.concat(a, F.lit("\n"), b), [part(t) for t in tables])
