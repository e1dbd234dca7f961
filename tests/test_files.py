"""Files as rows, bounds of a search, NFC, and a stream merged into snapshots."""

import base64
import datetime
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import nfc
from quillspark.operators import indexing, retrieval
from quillspark.sources import files
from quillspark.streaming import events

SF = "/root/testdata/sf0.001"


def test_images_are_read_by_type_and_size(spark, tmp_path):
    for name, data in {"a.PNG": b"x" * 10, "b.txt": b"x", "c.jpeg": b"y" * 500, "d.webp": b"z"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: (r.mimetype, r.size, base64.b64decode(r.data)) for r in files.images(spark, str(tmp_path), 100).collect()}
    assert got == {"a.PNG": ("image/png", 10, b"x" * 10), "d.webp": ("image/webp", 1, b"z")}


def test_specifications_are_json_or_yaml_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"openapi": "3.0.0"}, indent=1))
    assert [json.loads(r.value) for r in files.specifications(spark, str(tmp_path)).collect()] == [{"openapi": "3.0.0"}]
    yaml = pytest.importorskip("yaml")
    spec = {"openapi": "3.0.0", "paths": {"/a": {"get": {"responses": {"200": {"description": "ü"}}}}}}
    (tmp_path / "two.yaml").write_text(yaml.safe_dump(spec) + "info:\n  version: 2024-01-01\n")
    (tmp_path / "three.YML").write_text("paths: {/b: {get: {responses: {200: {description: number}}}}}")
    found = [json.loads(r.value) for r in files.specifications(spark, str(tmp_path)).collect()]
    assert {"openapi": "3.0.0"} in found and spec | {"info": {"version": "2024-01-01"}} in found
    assert {"paths": {"/b": {"get": {"responses": {"200": {"description": "number"}}}}}} in found
    (tmp_path / "four.txt").write_text("openapi: 3.0.0")
    with pytest.raises(Exception, match="neither JSON nor YAML"):
        files.specifications(spark, str(tmp_path)).collect()


def test_search_has_bounds(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    for limit, threshold in ((0, 0.5), (101, 0.5), (5, -0.1), (5, 1.1)):
        with pytest.raises(ValueError, match="between"):
            retrieval.search(table, table, limit=limit, threshold=threshold)


def test_nfc(spark):
    rows = spark.createDataFrame([("e\u0301",), ("plain",), (None,)], "t string").select(nfc(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["\xe9", "plain", None]


def test_models_get_no_blank_texts(spark):
    def load():
        def model(texts):
            assert all(t.strip() for t in texts) and len(texts) <= 2
            return [[float(len(t))] for t in texts]

        return model

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", None, " ", "bb", "ccc", "dddd"])], "i int, text string")
    got = {r.i: r.embedding for r in indexing.embedded(rows, load, batch=2).collect()}
    assert got == {0: [1.0], 1: None, 2: None, 3: [2.0], 4: [3.0], 5: [4.0]}


def test_stream_is_merged_into_snapshots(spark, tmp_path):
    """Two runs over what there is; the last write of a user wins, whichever batch it came in."""
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    for n, rows in enumerate([[(1, at(5), 7, "a"), (2, at(1), 8, "b")], [(3, at(3), 7, "late"), (4, at(9), 8, "c")]]):
        spark.createDataFrame([(i, t, u, e, 0.0, None) for i, t, u, e in rows], events.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        events.upsert_stream(events.event_stream(spark, str(source)), out, f"file://{tmp_path}/state", "user_id", ["ts", "event_id"]).awaitTermination()
        want = {7: "a", 8: "b"} if n == 0 else {7: "a", 8: "c"}
        assert {r.user_id: r.event_type for r in events.newest_snapshot(spark, out).collect()} == want
