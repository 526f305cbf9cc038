"""Files that tasks write side by side, and large files that are read in pieces."""

import io
import json
import random
from itertools import chain

import pytest
from pyspark.sql import DataFrame

from pipewright.api import plan, run
from pipewright.sinks import distributed
from pipewright.sinks.writers import WRITERS


@pytest.mark.parametrize("form", ["csv", "json", "jsonl", "parquet", "avro"])
def test_one_file_is_written_by_many_tasks(spark, tmp_path, form):
    made = spark.range(0, 1000, 1, 4).selectExpr("id", "if(id % 7 = 0, null, concat('q\"\n', id)) as s", "id / 8 as f", "named_struct('a', array(id)) as r")
    made.write.parquet(str(tmp_path / "in.parquet"))
    bound = plan(spark, f"{tmp_path}/in.parquet | sort -id" + (" | remove r" if form == "csv" else ""))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = distributed.one_file(bound.state(ordered=True), bound.schema, form, str(tmp_path))
        parts = [x for x in tmp_path.iterdir() if x.is_file()]
        assert len(parts) > 1  # before any task has the whole file
        [(_, path)] = joined.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = bound.dataframe(ordered=True).collect()
    if form in ("csv", "json", "jsonl"):
        alone = io.BytesIO()
        WRITERS[form](iter(rows), bound.schema, alone)
        assert open(path, "rb").read() == alone.getvalue()
    else:
        target = tmp_path / f"x.{form}"
        target.write_bytes(open(path, "rb").read())
        assert run(spark, str(target), ordered=True).collect() == rows


#: Queries that write files, one line for each finding about rows that went through the driver.
THROUGH_THE_DRIVER = [
    "parquet_round_trip", "csv_glob", "parquet_parts", "json_glob", "csv_nulls_and_quotes", "avro_glob", "jsonl_nulls", "jsonl_round_trip",
]


@pytest.mark.parametrize("name", THROUGH_THE_DRIVER)
def test_no_row_goes_through_the_driver(spark, data, tmp_path, monkeypatch, name):
    """On a cluster, in the folder that executors share with the driver."""
    from pipewright import queries

    def through(self, *_):
        raise AssertionError("rows are sent to the driver")

    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    monkeypatch.setattr(distributed, "has_shared_folder", lambda _: True)
    monkeypatch.setattr(distributed, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(queries, "scratch_file", lambda _, n: str(tmp_path / n))
    monkeypatch.setattr(DataFrame, "toLocalIterator", through)
    assert not distributed.reachable(spark, f"{tmp_path}-other/x.csv")
    assert not distributed.reachable(spark, "../x.csv", str(tmp_path))
    assert distributed.reachable(spark, "x.csv", str(tmp_path))
    assert queries.QUERIES[name](spark, data).count() > 0


def test_array_in_pieces():
    """Cut at its braces, an array has the elements that it has as a whole, or is as wrong; each comes as soon as it is whole."""
    from pipewright.errors import LoadError
    from pipewright.sources import json as source

    def result(f):
        try:
            return list(f())
        except LoadError:
            return None

    dice = random.Random(1)

    def value(depth=0):
        return dice.choice([lambda: 7, lambda: None, lambda: dice.choice(['}', '{"', "\\", "],[", "é"]), lambda: [value(depth + 1) for _ in range(dice.randrange(max(1, 3 - depth)))], lambda: {dice.choice('ab}"'): value(depth + 1) for _ in range(dice.randrange(max(1, 4 - depth)))}])()

    for i in range(4000):
        text = json.dumps([value() for _ in range(dice.randrange(5))], indent=dice.choice([None, 2]))
        if i % 2:
            k = dice.randrange(len(text) + 1)
            text = text[:k] + dice.choice('[]{},"\\ 1') + text[k:] if i % 4 == 1 else text[:k] + text[k + 1 :]
        if not text.endswith("}"):
            source.CHUNK, kept = dice.choice([1, 30]), source.CHUNK
            try:
                assert result(lambda: source.elements(text.split("}"), "f")) == result(lambda: source.JsonSource.array(text, "f")), text
            finally:
                source.CHUNK = kept

    def endless():
        raise AssertionError("read to its end")
        yield

    pieces = chain(['[{"a": [{"b": 1', "]"], [', {"a": "' + "x" * 50_000 + '"'] * 8, endless())
    assert next(source.elements(pieces, "f")) == {"a": [{"b": 1}]}


def test_large_array_is_read_in_pieces(spark, tmp_path, monkeypatch):
    from pipewright.errors import LoadError
    from pipewright.sources import json as source

    monkeypatch.setattr(source, "WHOLE", 0)
    rows = [{"a": i, "s": f'}}"{{\\ {i}', "r": {"x": [{"y": i}]}} for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:2500]))
    (tmp_path / "b.json").write_text(json.dumps(rows[2500:], indent=1))
    for options in ("", " with infer_rows=-1", " with infer_rows=5"):
        got = run(spark, f"{tmp_path}/*.json{options} | select a, s", ordered=True).collect()
        assert [tuple(r) for r in got] == [(r["a"], r["s"]) for r in rows]
    (tmp_path / "b.json").write_text(json.dumps(rows) + "}")
    with pytest.raises(LoadError, match="not one array"):
        run(spark, f"{tmp_path}/*.json with infer_rows=5 | count").collect()


@pytest.mark.parametrize("form", ["json", "avro", "csv"])
def test_many_files_are_read_by_some_tasks(spark, tmp_path, monkeypatch, form):
    """As many small files as there are, tasks are some for each core; first bytes of local files need no JVM."""
    from pipewright.cli import execute
    from pipewright.sources import files

    rows = [(i, f"t{i}") for i in range(400)]
    spark.createDataFrame(rows, "a long, s string").coalesce(1).write.parquet(str(tmp_path / "in.parquet"))
    execute(spark, f"{tmp_path}/in.parquet | {form} with split_rows=4 to {tmp_path}/x-{{n}}.{form}", None)
    inside = files.beginning

    def look(spark, path, n):
        assert form == "json", "read through the JVM"
        return inside(spark, path, n)

    monkeypatch.setattr(files, "beginning", look)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        options = " with infer_rows=-1" if form != "avro" else ""
        df = run(spark, f"{tmp_path}/*.{form}{options}")
        assert df.rdd.getNumPartitions() <= files.TASKS * spark.sparkContext.defaultParallelism < 100
        assert sorted(tuple(r) for r in df.collect()) == rows
        names = sorted(range(1, 101), key=str)  # files in order of their names, each in its own
        got = run(spark, f"{tmp_path}/*.{form}{options}", ordered=True).collect()
        assert [r["a"] for r in got] == [4 * (n - 1) + k for n in sorted(names, key=lambda n: f"x-{n}.") for k in range(4)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_text_of_many_rows():
    from pipewright.sinks.render import dump, json_row, json_text
    from pipewright.types import LType, list_of

    schema = [("b", LType("int", True)), ("a<", LType("string", True)), ("f", LType("float", True)), ("l", list_of(LType("int"))), ("t", LType("bool", True)), ("é", LType("record", fields=(("x", LType("float", True)),)))]
    rows = [
        (1, 'q"<\u2028\n\\&é\x01\x7f', 0.1, [1, 2], True, {"x": 1e30}), (None, None, None, [], None, {"x": None}), (-(2**63), "", -0.0, [3], False, {"x": 2.0}),
        (7, "\U0001f600", 1e21, [], True, {"x": 1e-7}),
    ]
    for width in range(len(schema) + 1):
        for how in ((), ("  ", 1)):
            text = json_text(schema[:width], *how)
            assert [text(r) for r in rows] == [dump(json_row(r, schema[:width]), *how) for r in rows]


def test_types_of_all_records(spark, tmp_path):
    """Records of a shape that is known still count where the type has changed in between."""
    lines = ['{"a": 1}', '{"a": 1}', '{"a": 2}', '{"a": 1.5, "b": null}', '{"a": 3}', '{"b": "x"}', '{"b": "y"}', '{"a": 4}', '{"a": 4, "c": [1]}', '{"c": []}']
    for k in range(len(lines)):
        (tmp_path / f"{k}.jsonl").write_text("\n".join(lines[k:] + lines[:k]) + "\n")
        schema = dict(plan(spark, f"{tmp_path}/{k}.jsonl with infer_rows=-1").schema)
        assert {n: str(t) for n, t in schema.items()} == {"a": "float?", "b": "string?", "c": "list<int>?"}, k


def test_rows_of_a_file_are_cut_from_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(len(n))), "n": pa.array(n, pa.int64())}) for n in ([1, 1, 2], [], [2, 3, 3, 3], [5])]
    assert [(n, b.column(0).to_pylist()) for n, b in distributed.runs(iter(batches), 1)] == [(1, [0, 1]), (2, [2]), (2, [0]), (3, [1, 2, 3]), (5, [0])]


def test_line_ends_in_cells_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """However a file is cut, its records are those that one task finds; and files that can't be cut are left to one task."""
    from pipewright.sources import csv as source
    from pipewright.sources import records

    dice = random.Random(3)

    def made(rows, odd=""):
        cell = lambda: dice.choice(["", "a", " b ", "7", "null", '""', '"x\ny"', '"\n"', '"q"",\n""\n"', '"é\n\n, "', '"' + "long\n" * dice.randrange(40) + '"'])
        lines = [",".join([str(i), cell(), cell()]) + "\n" * dice.choice([1, 1, 1, 2]) for i in range(rows)]
        return 'n,"b\nb",c\n' + "".join(lines[: rows // 2]) + odd + "".join(lines[rows // 2 :])

    def read(path, options, **how):
        before = len(calls)
        rows = run(spark, f"{tmp_path}/{path} with infer_rows=0{options}", **how).collect()
        return rows, len(calls) > before

    calls, inside = [], source.read_cut
    monkeypatch.setattr(source, "read_cut", lambda *a: calls.append(df := inside(*a)) or df)
    (tmp_path / "a-1.csv").write_text(made(150))
    (tmp_path / "a-2.csv").write_text(made(60).removesuffix("\n"))
    (tmp_path / "a-3.csv").write_text("n,\"b\nb\",c\n1,2,3\n")
    uneven = {"short.csv": made(60, '7,"\n"\n'), "wide.csv": made(60, '7,"\n",8,9\n')}
    irregular = {"stray.csv": '7,5" x\n,8\n', "open.csv": '7,"\n', "return.csv": '7,"\r\n",8\n', "spaces.csv": '  \n7,"\n",8\n', "after.csv": '7,"\n" ,8\n', "long.csv": f'7,"{"x" * 9000}\n",8\n'}
    for name, odd in irregular.items():
        (tmp_path / name).write_text(made(40, odd))
    for name, text in uneven.items():
        (tmp_path / name).write_text(text)
    jagged = ", allow_jagged_rows=true, ignore_unknown_values=true"
    monkeypatch.setattr(records, "LONG", 1 << 13)

    def everything():
        out = {p: read(p, "", ordered=True) for p in ("a-1.csv", "a-*.csv")}
        out |= {p: read(p, jagged, ordered=True) for p in [*uneven, *irregular]}
        out["rows"] = read("a-1.csv", ", header=false", ordered=True)
        for p, option in (("short.csv", ", ignore_unknown_values=true"), ("wide.csv", ", allow_jagged_rows=true")):
            with pytest.raises(Exception, match="does not have 3 cells"):
                read(p, option)
        return out

    spark.conf.set("spark.sql.files.maxPartitionBytes", "1200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        cut = everything()
        with monkeypatch.context() as m:
            m.setattr(source.CsvSource, "survey", lambda self, shards: None)
            whole = everything()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {k: v[0] for k, v in cut.items()} == {k: v[0] for k, v in whole.items()}
    assert len(cut["a-1.csv"][0]) == 150 and len(cut["rows"][0]) == 151
    assert {k: v[1] for k, v in cut.items()} == {k: k not in irregular for k in cut}
    assert not any(v[1] for v in whole.values()) and min(df.rdd.getNumPartitions() for df in calls) > 2


def test_a_split_inside_one_cell():
    """Splits without any record's end, and one that looks right either way."""
    import pyarrow as pa

    from pipewright.sources import records

    text = '1,"a\nb\nc\nd"\n2,"\n,\n"\n3,x\n'.removesuffix("\n").split("\n")
    for size in range(1, len(text) + 1):
        batches = [pa.RecordBatch.from_pydict({"file": ["f"], "start": [i - i % size], "row": [i], "value": [x]}) for i, x in enumerate(text)]
        rows = sorted((r for b in records.survey(",")(iter(batches)) for r in b.to_pylist()), key=lambda r: (r["start"], r["state"]))
        rows[0]["whole"] = 1
        states, between = records.follow("f", rows)
        assert states is not None and set(states) == {("f", i) for i in range(0, len(text), size)}
        inside = [0, 1, 1, 1, 0, 1, 1, 0]
        assert all(inside[i] == s for (_, i), s in states.items())
        starts = {0: 1, 4: 2, 7: 3}
        ends = {0: 3, 4: 6, 7: 7}
        assert [(r, t[0]) for _, r, t in between] == [(i, str(n)) for i, n in starts.items() if i // size != ends[i] // size]


@pytest.mark.parametrize("form", ["csv", "jsonl"])
@pytest.mark.parametrize("size", [1, 1 << 26])
def test_text_of_batches_is_that_of_rows(monkeypatch, form, size):
    import datetime

    import pyarrow as pa

    from pipewright.sinks import writers
    from pipewright.types import LType, list_of

    monkeypatch.setattr(writers, "TEXT_BYTES", size)
    made = {
        "i": (LType("int", True), pa.int32(), [None, -5, 7]), "f": (LType("float", True), pa.float64(), [0.0, -0.0, None, 1e21, 1e-7, 0.1, 2.0]),
        "s": (LType("string", True), pa.string(), ["", None, "a", '"', "a,b", "x\ny", "\r", "é<&>\u2028", " a", "null", "\x01"]),
        "b": (LType("bool", True), pa.bool_(), [True, None, False]), "d": (LType("date", True), pa.date32(), [datetime.date(2020, 1, 2), None]),
        "<l": (list_of(LType("int")), pa.list_(pa.int64()), [[], [1, 2], None]),
    }
    for names in (list(made), *([n] for n in made)):
        schema = [(n, made[n][0]) for n in names]
        batches = [pa.RecordBatch.from_arrays([pa.array([made[n][2][k % len(made[n][2])] for k in range(rows)], made[n][1]) for n in names], names=names) for rows in (40, 0, 3)]
        rows, together = io.BytesIO(), io.BytesIO()
        {"csv": writers.csv_body, "jsonl": writers.write_jsonl}[form](distributed.tuples(iter(batches), len(names)), schema, rows)

        def unused(_):
            raise AssertionError("written row by row")

        writers.write_part(iter(batches), unused, form, schema, together, b"")
        assert together.getvalue() == rows.getvalue()


def test_plain_records_are_parsed_together(spark, tmp_path):
    """As ``fitted`` has them, or left to it."""
    import math

    import pyarrow as pa

    from pipewright.sources import json as source
    from pipewright.types import LType

    schema = [("a", LType("int", True)), ("f", LType("float", True)), ("s", LType("string", True)), ("b", LType("bool", True)), ("é", LType("int"))]
    plain = [
        '{"a": 1, "f": 2, "s": "x", "b": true, "é": 0}', ' {"é":-9223372036854775808,"f":-0.0}\t', '{"\\u0061":7,"é":1,"s":"\\u00e9\\n\\/\\u0000é\U0001f600"}',
        '{"é":1,"f":1e400,"b":null}', '{"é":1,"f":123456789012345678901234567890}', '{"é":1,"f":0.1000000000000000055511151231257827}', '{"é":1,"s":"2024-01-01 00:00:00"}',
    ]
    found = source.columns(pa.array(plain), schema, True)
    if found is None:  # where a library doesn't take a number, the rest do
        plain.pop(3)
        found = source.columns(pa.array(plain), schema, True)
    for i, line in enumerate(plain):
        value = json.loads(line, parse_int=source.whole)
        for c, (n, t) in zip(found, schema, strict=True):
            want, got = source.fitted(value.get(n), t, n), c[i].as_py()
            assert got == want and type(got) is type(want) and (not isinstance(got, float) or math.copysign(1, got) == math.copysign(1, want)), line
    left = [
        "", "7", '{"a":1}', '{"é":1,"a":1.0}', '{"é":1,"a":9223372036854775808}', '{"é":1,"f":-0}', '{"é":1,"f":NaN}', '{"é":1,"f":01}', '{"é":1,"s":"\t"}', '{"é":1,"s":"\\ud83d"}', '{"é":1,"s":1}',
        '{"é":1,"b":"true"}', '{"é":1,"more":1}', '{"é":1,"é":2}', '{"é":1}{"é":2}', '{"é":1', '{"é":1,"s":[]}', '{"é":null}', None,
    ]
    for line in left:
        assert source.columns(pa.array([plain[0], line]), schema, True) is None, line
    assert source.columns(pa.array(['{"é":1,"more":"x"}']), schema, False)[4].to_pylist() == [1]
    rows = [{"a": i, "f": i / 7, "s": f'"{i}'} for i in range(30)]
    text = "\n".join(map(json.dumps, rows))
    (tmp_path / "x.jsonl").write_text(text + '\n\n{"a": 30, "f": -0, "s": "\\ud83d\\ude00"}\n')
    got = run(spark, f"{tmp_path}/x.jsonl", ordered=True).collect()
    assert [r.asDict() for r in got] == [*rows, {"a": 30, "f": 0.0, "s": "\U0001f600"}]
    (tmp_path / "x.jsonl").write_text(text + '\n{"a": 1.5, "f": 1, "s": ""}\n')
    with pytest.raises(Exception, match="is not int"):
        run(spark, f"{tmp_path}/x.jsonl with infer_rows=20").collect()
