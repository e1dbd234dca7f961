"""Trees of blocks beyond the limits of a recursive query."""

import pytest

from quillspark.sources import blocks as B


def test_levels_have_no_limit_of_rows(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        rows = [(f"p{p}", f"b{i}", f"b{i - 1}" if i else None, 0, "paragraph", f"{p}-{i}") for p in range(40) for i in range(4)] + [("p0", "lost", "nowhere", 0, "paragraph", "x")]
        frame = spark.createDataFrame(rows, "page_id string, block_id string, parent_id string, position int, type string, text string")
        for c, t in (("caption", "string"), ("url", "string"), ("language", "string"), ("icon", "string"), ("name", "string"), ("checked", "boolean"), ("cells", "array<string>")):
            frame = frame.selectExpr("*", f"CAST(NULL AS {t}) AS {c}")
        got = {r.page_id: r.content for r in B.page_texts(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {f"p{p}": "\n\n".join(f"{p}-{i}" for i in range(4)) for p in range(40)}


def test_a_circle_fails(spark, monkeypatch):
    monkeypatch.setattr(B, "LEVELS", 4)
    frame = spark.createDataFrame([("p", "a", None, 0), ("p", "a", "b", 0), ("p", "b", "a", 0)], "page_id string, block_id string, parent_id string, position int")
    with pytest.raises(ValueError, match="levels"):
        B.in_order(frame)
