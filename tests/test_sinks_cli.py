import io
import json
import os

import pytest

from pipewright import cli
from pipewright.errors import QueryError, WriteError
from pipewright.sinks.render import float_json, float_text


@pytest.fixture
def at(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,age,ok\nAl,30,true\nBø,,false\n,2,\n")
    (tmp_path / "n.jsonl").write_text('{"b":1.0,"a":"<x>","r":{"z":[1,"q",null],"y":null}}\n{"b":2.5,"a":null,"r":{"z":[],"y":3}}\n')

    def run(text, stdin=None):
        out = io.BytesIO()
        cli.execute(spark, text, out, stdin, base=str(tmp_path))
        return out.getvalue().decode()

    run.path = tmp_path
    return run


def test_table(at):
    assert at("a.csv") == "name | age  | ok   \n-----+------+------\nAl   | 30   | true \nBø  | null | false\nnull | 2    | null \n"
    lines = ["r", "-" * 24, "{y:null, z:[1, q, null]}", "{y:3, z:[]}"]
    assert at("n.jsonl | select r") == "".join(x.ljust(24) + "\n" for x in lines)
    assert at("a.csv | remove name, age, ok") == ""


def test_csv(at):
    assert at("a.csv | csv") == "name,age,ok\nAl,30,true\nBø,,false\n,2,\n"
    assert at("n.jsonl | select a, r | csv") == 'a,r\n<x>,"{y:null, z:[1, q, null]}"\n,"{y:3, z:[]}"\n'


def test_json(at):
    got = at("n.jsonl | json")
    assert json.loads(got) == [{"a": "<x>", "b": 1, "r": {"y": None, "z": [1, "q", None]}}, {"a": None, "b": 2.5, "r": {"y": 3, "z": []}}]
    assert got.startswith('[\n  {\n    "a": "\\u003cx\\u003e",\n    "b": 1,\n    "r": {')
    assert at("a.csv | filter { false } | json") == "[]\n"
    assert at("n.jsonl | select b, a | jsonl") == '{"a":"\\u003cx\\u003e","b":1}\n{"a":null,"b":2.5}\n'


def test_floats():
    shown = {1.0: "1", 0.1: "0.1", -2.5: "-2.5", 100000.0: "100000", 1e6: "1e+06", 1234567.5: "1.2345675e+06", 1e20: "1e+20", 1.5e-7: "1.5e-07", 0.0001: "0.0001", 0.00001: "1e-05", -0.0: "-0", 1e300: "1e+300", float("inf"): "+Inf", 5e-324: "5e-324"}
    assert {x: float_text(x) for x in shown} == shown
    written = {1.0: "1", 1234567.5: "1234567.5", 1e20: "100000000000000000000", 1e21: "1e+21", 1.2e23: "1.2e+23", 0.000001: "0.000001", 1.5e-7: "1.5e-7", 1e-10: "1e-10", -0.0: "-0"}
    assert {x: float_json(x) for x in written} == written


def test_json_has_no_nan(at):
    with pytest.raises(WriteError, match="NaN"):
        at("- with format=csv | json", io.BytesIO(b"a\nnan\n"))
    assert at("- with format=csv | csv", io.BytesIO(b"a\nnan\n-inf\n")) == "a\nNaN\n-Inf\n"


@pytest.mark.parametrize("form", ["parquet", "avro"])
def test_binary_round_trip(at, form):
    at(f"a.csv | transform l = list(struct(a = age, b = name)), f = age / 4, t = \"x\" | {form} to out.{form}")
    assert at(f"out.{form} | json") == at("a.csv | transform l = list(struct(a = age, b = name)), f = age / 4, t = \"x\" | json")
    assert "list<record<a:int?, b:string?>" in at(f"out.{form} | describe")
    at(f"a.csv | filter {{ false }} | {form} to empty.{form}")
    assert at(f"empty.{form} | describe | select column, type | csv") == "column,type\nname,string\nage,int\nok,bool\n"
    for bad in ("remove name, age, ok", ):
        with pytest.raises(WriteError):
            at(f"a.csv | {bad} | {form} to none.{form}")
    with pytest.raises(WriteError):
        at(f"n.jsonl | {form} to mixed.{form}")
    assert not os.path.exists(at.path / f"mixed.{form}")


def test_avro_names(at):
    with pytest.raises(WriteError, match="field name"):
        at("a.csv | rename name = `a b` | avro to x.avro")


def test_paths(at):
    for text, made in [("csv to sub/x", "sub/x.csv"), ("json to d/", "d/output.json"), ("table to d/", "d/output.txt"), ("jsonl to y.jsonl", "y.jsonl"), ("csv to {n}.csv", "{n}.csv")]:
        at("a.csv | " + text)
        assert (at.path / made).exists(), made
    for bad in ("x.json", "odd.name"):
        with pytest.raises(WriteError):
            at(f"a.csv | csv to {bad}")


def test_overwrite(at):
    at("a.csv | csv to x.csv")
    with pytest.raises(WriteError, match="exists"):
        at("a.csv | head 1 | csv to x.csv")
    assert at("x.csv | count | csv") == "count\n3\n"
    at("a.csv | head 1 | csv with overwrite=true to x.csv")
    assert at("x.csv | count | csv") == "count\n1\n"
    with pytest.raises(Exception):
        at("a.csv | transform y = year(name) | csv with overwrite=true to x.csv")
    assert at("x.csv | count | csv") == "count\n1\n" and not [f for f in os.listdir(at.path) if f.startswith(".staged")]


def test_split(at):
    at("a.csv | csv with split_rows=2 to parts/")
    assert sorted(os.listdir(at.path / "parts")) == ["output-1.csv", "output-2.csv"] and at("parts/*.csv | count | csv") == "count\n3\n"
    at("a.csv | jsonl with split_rows=1 to p/x-{n}.jsonl")
    assert sorted(os.listdir(at.path / "p")) == ["x-1.jsonl", "x-2.jsonl", "x-3.jsonl"]
    at("a.csv | head 1 | jsonl with split_rows=1, overwrite=true to p/x-{n}.jsonl")
    assert os.listdir(at.path / "p") == ["x-1.jsonl"]
    at("a.csv | head 0 | csv with split_rows=5 to z/")
    assert os.listdir(at.path / "z") == ["output-1.csv"]
    at("a.csv | csv with split_rows=2 to m/{n}/part-{n}.csv")
    assert sorted(os.listdir(at.path / "m")) == ["1", "2"] and os.listdir(at.path / "m/2") == ["part-2.csv"]
    with pytest.raises(QueryError):
        at("a.csv | csv with split_rows=2 to q.csv")


def test_stdin(at):
    assert at("- with format=csv | filter { a > 1 } | csv", io.BytesIO(b"a,b\n1,x\n2,y\n")) == "a,b\n2,y\n"
    assert at("- with format=json | count | csv", io.BytesIO(b'[{"a":1}]')) == "count\n1\n"
    with pytest.raises(QueryError):
        at("- with format=csv")


def test_agent_server(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.csv").write_text("x\n1\n2\n")
    ask = [
        {"id": 1, "method": "initialize", "params": {"protocolVersion": "2025-01-01"}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "query", "arguments": {"query": "a.csv | count | csv"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "query", "arguments": {"query": "a.csv | select y"}}}, {"id": 5, "method": "tools/call", "params": {"name": "query", "arguments": {"query": "- with format=csv"}}}, {"id": 6, "method": "nope"},
        {"id": 7, "method": "resources/read", "params": {"uri": cli.GUIDE_URI}}, {"id": 8, "method": "tools/call", "params": {"name": "other"}}, {"id": 9, "method": "ping"},
    ]
    out = io.StringIO()
    cli.serve(spark, [*map(json.dumps, ask), "", "{broken"], out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert got[1]["result"]["protocolVersion"] == "2025-01-01" and got[2]["result"]["tools"][0]["name"] == "query"
    assert got[3]["result"] == {"content": [{"type": "text", "text": "count\n2\n"}], "isError": False}
    assert got[4]["result"]["isError"] and "y" in got[4]["result"]["content"][0]["text"] and got[5]["result"]["isError"]
    assert got[6]["error"]["code"] == -32601 and "describe" in got[7]["result"]["contents"][0]["text"] and got[8]["error"]["code"] == -32602 and got[9]["result"] == {} and got[None]["error"]["code"] == -32700
    assert len(got) == 10


def test_main(spark, tmp_path, monkeypatch, capfdbinary):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.csv").write_text("x\n1\n2\n")
    assert cli.main(["--version"]) == 0 and cli.main(["-h"]) == 0 and cli.main(["--guide"]) == 0 and cli.main([]) == 2
    assert cli.main(["a.csv", "|", "filter { x > 1 }", "|", "csv"]) == 0
    assert cli.main(["--", "a.csv | nope"]) == 1
    out, err = capfdbinary.readouterr()
    assert out.endswith(b"x\n2\n") and b"error: unknown operation 'nope'" in err


@pytest.mark.parametrize("form", ["csv", "json", "jsonl", "avro", "parquet"])
def test_executors_write_parts_in_order(spark, data, tmp_path, form):
    from pipewright.api import run

    for place in (str(tmp_path), tmp_path.as_uri()):  # by path, and as to a store
        text = f"{data}/orders.parquet | select o_orderkey, o_orderstatus, o_totalprice | sort -o_totalprice, o_orderkey | {form} with split_rows=300, overwrite=true to {place}/"
        cli.execute(spark, text, None)
        cli.execute(spark, text, None)
        count = -(-spark.read.parquet(f"{data}/orders.parquet").count() // 300)
        assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"output-{i + 1}.{form}" for i in range(count))
        want = [r[0] for r in run(spark, f"{data}/orders.parquet | sort -o_totalprice, o_orderkey | select o_orderkey", ordered=True).collect()]
        got = [r[0] for i in range(count) for r in run(spark, f"{place}/output-{i + 1}.{form} | select o_orderkey", ordered=True).collect()]
        assert got == want
        with pytest.raises(WriteError, match="exists"):
            cli.execute(spark, f"{data}/nation.parquet | {form} to {place}/output-1.{form}", None)
        cli.execute(spark, f"{data}/nation.parquet | head 0 | {form} with split_rows=3 to {place}/empty-{{n}}", None)
        assert (tmp_path / f"empty-1.{form}").exists()
        (tmp_path / f"empty-1.{form}").unlink()


def test_the_driver_gets_no_rows(spark, data, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    cli.execute(spark, f"{data}/lineitem.parquet | parquet to {tmp_path}/l", None)
    assert spark.read.parquet(f"{tmp_path}/l.parquet").count() == spark.read.parquet(f"{data}/lineitem.parquet").count()
