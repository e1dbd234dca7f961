"""The command line over a home folder: sources, synchronisation, history, search, exit codes."""

import json

import pytest

from quillspark.cli import Exit, main


@pytest.fixture
def call(spark, tmp_path, capsys):
    def run(*args):
        code = main(["--home", f"{tmp_path}/home", *args], spark)
        return code, capsys.readouterr().out

    return run


def test_from_a_source_to_an_answer(spark, tmp_path, call):
    docs = spark.createDataFrame([(1, "the harbour has berths"), (2, "ships wait outside")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    (tmp_path / "spec").mkdir()
    spec = {"openapi": "3.0.0", "info": {"title": "Port"}, "paths": {"/berths": {"get": {"summary": "List berths", "responses": {"200": {"description": "ok"}}}}}}
    (tmp_path / "spec" / "port.json").write_text(json.dumps(spec))
    assert call("source", "list") == (Exit.SUCCESS, "")
    assert call("source", "add", "-n", "notes", "-t", "documents", "-l", f"{tmp_path}/docs")[0] == Exit.SUCCESS
    assert call("source", "add", "-n", "port", "-t", "swagger", "-l", f"{tmp_path}/spec")[0] == Exit.SUCCESS
    assert call("source", "add", "-n", "port", "-t", "swagger", "-l", "x")[0] == Exit.INPUT_ERROR
    code, said = call("sync", "run")
    assert code == Exit.SUCCESS and "notes completed created=2" in said and "port completed created=1" in said
    code, said = call("search", "berths", "--limit", "3")
    assert code == Exit.SUCCESS and {line.split("\t")[2] for line in said.splitlines()} == {"notes", "port"}
    docs.limit(1).unionByName(spark.createDataFrame([(None, "lost")], docs.schema)).write.parquet(f"{tmp_path}/more")
    assert call("source", "add", "-n", "odd", "-t", "documents", "-l", f"{tmp_path}/more")[0] == Exit.SUCCESS
    code, said = call("sync", "run", "odd")
    assert code == Exit.SYNC_ERROR and "odd partial created=1" in said and "errors=1" in said
    assert call("source", "remove", "odd") == (Exit.SUCCESS, "odd\n")
    assert [line.split("\t")[:2] for line in call("status")[1].splitlines()] == [["notes", "2"], ["port", "1"]]
    assert len(call("sync", "history")[1].splitlines()) == 3 and len(call("source", "list")[1].splitlines()) == 2
    assert "notes" in call("source", "show", "notes")[1]


def test_a_source_that_fails_fails_alone(spark, tmp_path, call):
    spark.createDataFrame([(1, "a word")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    call("source", "add", "-n", "a", "-t", "documents", "-l", f"{tmp_path}/nowhere")
    call("source", "add", "-n", "b", "-t", "documents", "-l", f"{tmp_path}/docs")
    code, said = call("sync", "run")
    assert code == Exit.SYNC_ERROR and "a failed" in said and "b completed created=1" in said


@pytest.mark.parametrize("args", [("source", "add", "-n", "x", "-t", "odd", "-l", "y"), ("source", "add", "-n", "x", "-t", "swagger"), ("source", "show", "none"), ("source", "remove", "none"), ("sync", "run", "none"), ("search", "a", "--limit", "0"), ("nonsense",), ()])
def test_wrong_input_is_told(call, args):
    assert call(*args)[0] == Exit.INPUT_ERROR
