"""Splitters, collections, loaders and streams beside their batch twins."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import dialog as D
from quillspark.operators import messages as M
from quillspark.sources import collections as C
from quillspark.streaming import events as E


def test_message_parts_keep_words_and_fences():
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice(["word ", "more. ", "end\n", "\n\n", "longer" * 9 + " "]) for _ in range(rng.randint(0, 400)))
        parts = list(M.parts_of(text, 200))
        assert "".join("".join(parts).split()) == "".join(text.split())
        assert all(len(p) <= 200 for p in parts)
    code = "intro\n```python\n" + "x = 1\n" * 100 + "```\nout"
    parts = list(M.parts_of(code, 200))
    assert len(parts) > 2 and all(p.count("```") % 2 == 0 for p in parts)
    assert parts[0].endswith(M.FENCE_CONTINUED) and parts[1].startswith("```python\n")
    assert list(M.parts_of("", 10)) == [""] and list(M.parts_of(None, 10)) == [""]
    assert sum(p.count("y") for p in M.parts_of("```" + "y" * 500, 20)) == 500


def test_response_parts(spark):
    df = spark.createDataFrame([("a" * 300, "src"), ("short", None), (None, "s")], "t string, s string")
    got = [r[0] for r in df.select(M.response_parts(F.col("t"), F.col("s"), 100)).collect()]
    assert "".join(p.removesuffix(M.CONTINUED) for p in got[0]) == "a" * 300 + "src" and all(len(p) <= 100 for p in got[0])
    assert got[1:] == [["short"], ["s"]]


def test_collections(spark, tmp_path):
    path = f"{tmp_path}/points"
    assert C.ensure(spark, path) and not C.ensure(spark, path)
    C.append(spark.createDataFrame([("a", [1.0, 2.0], {"k": "v"}), (None, [0.0, 1.0], None)], C.POINTS), path, dimension=2)
    assert C.info(spark, path).first() == (2, 2) and spark.read.parquet(path).where("id is null").count() == 0
    with pytest.raises(Exception, match="expected 2 dimensions"):
        C.append(spark.createDataFrame([("b", [1.0], None)], C.POINTS), path, dimension=2)
    assert C.info(spark, path).first() == (2, 2)
    assert C.drop(spark, path) and not C.drop(spark, path)


def test_loaders(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"text": "one", "metadata": {"k": "v"}}, {"text": "two"}]))
    assert [(r.text, r.metadata) for r in C.json_documents(spark, f"{tmp_path}/d.json").collect()] == [("one", {"k": "v"}), ("two", None)]
    (tmp_path / "d.csv").write_text('text,a,b\n"x, ""y""",1,\nz,,2\n')
    assert [(r.text, r.metadata) for r in C.csv_documents(spark, f"{tmp_path}/d.csv").collect()] == [('x, "y"', {"a": "1"}), ("z", {"b": "2"})]
    (tmp_path / "e.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="column text"):
        C.csv_documents(spark, f"{tmp_path}/e.csv")
    assert C.read_or_empty(spark, f"{tmp_path}/none.json", "a int").count() == 0
    C.export_feedback(spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id int, ts int"), f"{tmp_path}/out", newest=2)
    assert sorted(r.id for r in C.read_or_empty(spark, f"{tmp_path}/out", "id int, ts int").collect()) == [2, 3]


def test_only_selects_run(spark):
    assert C.select_only(spark, "SELECT id FROM range(5) WHERE id > :least", {"least": 2}).count() == 2
    for sql in ("DROP TABLE t", "", "SELECT 1; DELETE FROM t"):
        with pytest.raises(ValueError):
            C.select_only(spark, sql)


def test_stream_matches_table(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = E.tumbling(E.event_stream(spark, f"{tmp_path}/in"), lateness="1000 days")
    query = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(str, spark.table("tumbled").collect())) == sorted(map(str, E.tumbling(rows).collect()))


def test_conversation_state_keeps_the_tail(spark, tmp_path):
    said = [(t, "user" if i % 2 else "assistant", f"m{i}", i) for t in ("a", "b") for i in range(7)]
    df = spark.createDataFrame(said, "thread string, role string, text string, i int").withColumn("at", F.timestamp_seconds(F.col("i") + 1_000_000))
    df.drop("i").where("i < 4").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.drop("i").where("i >= 4").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("thread string, role string, text string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = E.conversation_state(stream, keep=3).writeStream.format("memory").queryName("talks").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    twin = D.tail(df.withColumnRenamed("thread", "conv_id").withColumn("turn", F.col("i")), 3)
    want = sorted((r.conv_id, r.text) for r in twin.collect())
    got = sorted((r.thread, r.text) for r in spark.table("talks").collect())
    assert all(x in got for x in want)
