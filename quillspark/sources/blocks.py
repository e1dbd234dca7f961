"""Block trees of pages as rows in reading order, and as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import shared_folder

#: Most levels of a tree.
LEVELS = 100

BLOCKS = "page_id string, block_id string, parent_id string, position int, type string, text string, caption string, url string, language string, icon string, name string, checked boolean, cells array<string>"


def in_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` (BLOCKS) with depth and path, whose order is the pre-order of the trees.

    One join a level, each of which is written once, so that the number of rows has no limit. What hangs on no top block (null
    parent) is left out. Trees of more than LEVELS levels fail, rather than lose a part: their ids go round in a circle.
    """
    spark, base, walked = blocks.sparkSession, shared_folder(blocks.sparkSession, "blocks"), []
    step = F.lpad(F.col("position").cast("string"), 8, "0")
    level = blocks.where("parent_id IS NULL").select("page_id", "block_id", F.lit(0).alias("depth"), step.alias("path"))
    while True:
        level.write.parquet(f"{base}/{len(walked)}")
        level = spark.read.schema(level.schema).parquet(f"{base}/{len(walked)}")
        if walked and level.isEmpty():
            break
        walked.append(level)
        if len(walked) > LEVELS:
            raise ValueError(f"blocks of more than {LEVELS} levels")
        up = level.select("page_id", F.col("block_id").alias("parent_id"), "depth", F.col("path").alias("above"))
        below = blocks.select("page_id", "block_id", "parent_id", "position").join(up, ["page_id", "parent_id"])
        level = below.select("page_id", "block_id", (F.col("depth") + 1).alias("depth"), F.concat("above", F.lit("/"), step).alias("path"))
    return blocks.join(reduce(DataFrame.unionByName, walked), ["page_id", "block_id"]).select(*blocks.columns, "depth", "path")


def _labelled(label: Column) -> Column:
    caption = F.coalesce("caption", F.lit(""))
    return F.concat(F.lit("["), label, F.when(caption != "", F.concat(F.lit(": "), caption)).otherwise(""), F.lit("]"))


def line(own: dict[str, Column] | None = None) -> Column:
    """The text of a block by its type; types without text of their own are empty. ``own`` texts stand in for those of some types, or add types."""
    text, url = F.coalesce("text", F.lit("")), F.coalesce("url", F.lit(""))
    title = F.coalesce("text", F.lit("제목 없음"))
    by_type = {
        **dict.fromkeys(("paragraph", "toggle", "template", "equation"), text),
        **{f"heading_{k}": F.concat(F.lit("#" * k + " "), text) for k in (1, 2, 3)},
        **dict.fromkeys(("bulleted_list_item", "numbered_list_item"), F.concat(F.lit("• "), text)),
        "to_do": F.concat(F.when(F.coalesce("checked", F.lit(False)), "[x] ").otherwise("[ ] "), text),
        "code": F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), text, F.lit("\n```")),
        "quote": F.concat(F.lit("> "), text),
        "callout": F.when(F.coalesce("icon", F.lit("")) != "", F.concat("icon", F.lit(" "), text)).otherwise(text),
        "divider": F.lit("---"),
        "table_row": F.array_join(F.coalesce("cells", F.array().cast("array<string>")), " | "),
        "bookmark": F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("["), "caption", F.lit("]("), url, F.lit(")"))).otherwise(url),
        **dict.fromkeys(("embed", "link_preview"), url),
        "image": _labelled(F.lit("이미지")),
        "video": _labelled(F.lit("비디오")),
        "pdf": _labelled(F.lit("PDF")),
        "file": _labelled(F.coalesce("name", F.lit("파일"))),
        "child_page": F.concat(F.lit("[하위 페이지: "), title, F.lit("]")),
        "child_database": F.concat(F.lit("[하위 데이터베이스: "), title, F.lit("]")),
    }
    by_type |= own or {}
    return reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), by_type.items(), F.when(F.lit(False), "")).otherwise("")


def page_texts(blocks: DataFrame, own: dict[str, Column] | None = None) -> DataFrame:
    """(page_id, content): the lines of each page that aren't blank, in reading order, with a blank line between; ``own`` as for ``line``."""
    lines = in_order(blocks).select("page_id", "path", line(own).alias("line")).where(F.trim("line") != "")
    whole = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("lines"))
    return whole.select("page_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("content"))
