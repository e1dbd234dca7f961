"""Paged sources as a table and as a stream that stops and goes on; page records of odd shapes."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions.page_records import page_rows
from quillspark.sources import paged

FETCH = "quillspark.sources.paged:folder_pages"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(c, i, json.dumps({"id": f"{c}{i}", "ü": "x" * i})) for c, n in (("a", 23), ("b", 4), ("c", 1)) for i in range(n)]
    path = str(tmp_path / "pages")
    assert paged.write_pages(spark.createDataFrame(rows, "collection string, position int, record string"), path, 4) == ["a", "b", "c"]
    return path


def ids(df):
    return sorted(r[0] for r in df.select(F.get_json_object("record", "$.id")).collect())


WANT = sorted([f"a{i}" for i in range(23)] + [f"b{i}" for i in range(4)] + ["c0"])


def test_every_record_once(spark, folder):
    found = paged.read_paged(spark, FETCH, ["a", "b", "c"], folder, 4)
    assert ids(found) == WANT and found.rdd.getNumPartitions() == 3
    assert ids(paged.read_paged(spark, FETCH, ["b"], folder, 4)) == [f"b{i}" for i in range(4)]
    with pytest.raises(Exception, match="collection=zz"):
        paged.read_paged(spark, FETCH, ["zz"], folder, 4).collect()


def test_a_stream_goes_on_where_it_stopped(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(batches):
        seen = []

        def keep(batch, number):
            batch.write.mode("append").parquet(out)
            seen.append(number)
            if len(seen) == batches:
                raise RuntimeError("stopped on purpose")

        stream = paged.stream_paged(spark, FETCH, ["a", "b", "c"], folder, 4, pages_per_trigger=2).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()
        try:
            stream.processAllAvailable()
        except Exception:  # the one on purpose
            assert len(seen) == batches
        finally:
            stream.stop()
        return seen

    first = run(2)  # the second batch fails after its write: it is done again under the same number
    again = run(99)
    assert first == [0, 1] and again[0] == 1
    found = spark.read.parquet(out)
    assert sorted(set(ids(found))) == WANT
    assert ids(found.dropDuplicates(["collection", "cursor", "position"])) == WANT


def test_cursors_that_run_in_a_circle_fail():
    with pytest.raises(ValueError, match="circle"):
        list(paged._pages(lambda c, cursor, n: {"results": [], "has_more": True, "next_cursor": {"1": "2", "2": "1"}.get(cursor, "1")}, "a", None, 10))
    assert len(list(paged._pages(lambda c, cursor, n: {"results": []}, "a", None, 10))) == 1


def test_page_records_of_odd_shapes(spark):
    odd = [
        '{"id":"1","properties":{"Name":{"type":"title","title":"not a list"}},"icon":"x","archived":null,"created_by":null}',
        '{"id":2,"properties":[],"archived":true}', "not json", None, "{}", "[]",
        '{"id":"7","properties":{"B":{"type":"title","title":[{"plain_text":"b"}]},"A":{"type":"title","title":[{"plain_text":"a"},{},{"plain_text":null},{"plain_text":"!"}]},"Name":{"type":"title","title":[]}}}',
    ]
    got = page_rows(spark.createDataFrame([(x,) for x in odd], "record string")).collect()
    assert [(r.id, r.title, r.archived, r.icon) for r in got] == [
        ("1", "제목 없음", False, None), ("2", "제목 없음", True, None), (None, "제목 없음", False, None), (None, "제목 없음", False, None),
        (None, "제목 없음", False, None), (None, "제목 없음", False, None), ("7", "a!", False, None),
    ]
