"""Records of pages whose properties have any shape, as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model_json import TITLE_NAMES, UNTITLED


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "string")


def _rich(items: Column) -> Column:
    """The texts of a list of rich text joined; null where it isn't a list or is empty."""
    parts = F.try_variant_get(items, "$", "array<variant>")
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda p: F.coalesce(_text(p, "$.plain_text"), F.lit(""))), ""))


def title(record: Column) -> Column:
    """The title of a page: of the known names first, then of any property of type title, by name."""
    properties = F.try_variant_get(record, "$.properties", "map<string,variant>")
    use = lambda p: F.when(_text(p, "$.type") == "title", _rich(F.try_variant_get(p, "$.title", "variant")))
    named = [use(F.try_element_at(properties, F.lit(n))) for n in TITLE_NAMES]
    rest = F.array_sort(F.filter(F.transform(F.map_entries(properties), lambda e: F.struct(e["key"].alias("name"), use(e["value"]).alias("title"))), lambda t: t["title"].isNotNull()))
    return F.coalesce(*named, F.get(rest, F.lit(0))["title"], F.lit(UNTITLED))


def icon(record: Column) -> Column:
    """The emoji, or the address of an outside image; null for other kinds and none."""
    kind = _text(record, "$.icon.type")
    return F.when(kind == "emoji", _text(record, "$.icon.emoji")).when(kind == "external", _text(record, "$.icon.external.url"))


def page_rows(records: DataFrame, record: str = "record") -> DataFrame:
    """id, title, url, created_time, last_edited_time, created_by, last_edited_by, archived and icon of records as JSON.

    Properties may be of any type and number, as they are looked up in the record itself. A field that is missing or of
    another type is null, archived false, the title a fixed one; text that isn't JSON is a record without fields.
    """
    v = records.select("*", F.try_parse_json(record).alias("_v"))
    fields = {
        "id": _text(F.col("_v"), "$.id"), "title": title(F.col("_v")), "url": _text(F.col("_v"), "$.url"),
        **{c: _text(F.col("_v"), f"$.{c}") for c in ("created_time", "last_edited_time")},
        **{c: _text(F.col("_v"), f"$.{c}.id") for c in ("created_by", "last_edited_by")},
        "archived": F.coalesce(F.try_variant_get("_v", "$.archived", "boolean"), F.lit(False)), "icon": icon(F.col("_v")),
    }
    return v.select(*[c.alias(n) for n, c in fields.items()])
