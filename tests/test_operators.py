import math

import pytest
from pyspark.errors import PySparkException

from pipewright.api import pipe
from pipewright.errors import PlanError
from pipewright.lang.parser import parse_pipe
from pipewright.plans.planner import bind_operations
from pipewright.sources import FrameSource

PEOPLE = [("Al", 30, "NY", 1.5), ("Bo", 25, "LA", 2.0), ("Cy", 35, "NY", None), ("Di", 28, None, 4.0), ("Ed", None, "LA", 2.5), ("Fo", 40, "NY", 0.5), ("Gu", 25, None, 3.0)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "name string, age long, city string, score double").repartition(1).cache()


def rows(df, text):
    return [tuple(r) for r in pipe(df, text, ordered=True).collect()]


def schema(df, text):
    return [(n, str(t)) for n, t in bind_operations(FrameSource(df), parse_pipe(text), None).schema]


def names(df, text):
    return [r[0] for r in rows(df, text)]


def test_head_and_tail(people):
    assert names(people, "head 2") == ["Al", "Bo"] and names(people, "tail 2") == ["Fo", "Gu"]
    assert len(rows(people, "head")) == 7 and names(people, "head 0") == [] and names(people, "tail 0") == []
    assert names(people, "tail 4 | head 2") == ["Di", "Ed"] and names(people, "filter { age > 26 } | head 2 | tail 1") == ["Cy"]


def test_select_flattens_and_numbers(spark, people):
    assert schema(people, "select name, name, age, name") == [("name", "string?"), ("name_2", "string?"), ("age", "int?"), ("name_3", "string?")]
    df = spark.createDataFrame([((1, (2,)), 3)], "a struct<b: long, c: struct<d: long>>, a_b long")
    got = pipe(df, "select a.b, a_b, a.c.d")
    assert got.columns == ["a_b", "a_b_2", "a_c_d"] and tuple(got.first()) == (1, 3, 2)


def test_remove_rename_transform(people):
    assert pipe(people, "remove age, name").columns == ["city", "score"]
    assert pipe(people, "remove name, age, city, score").columns == [] and rows(people, "remove name, age, city, score | count") == [(7,)]
    assert rows(people, "rename name = age, age = name | head 1") == [(  "Al", 30, "NY", 1.5)] and pipe(people, "rename name = age, age = name").columns == ["age", "name", "city", "score"]
    assert rows(people, "transform age = age + 1, old = age, z = 1 | select age, old, z | head 1") == [(31, 30, 1)]
    assert pipe(people, "transform z = 1, name = 2").columns == ["name", "age", "city", "score", "z"]


def test_sort(people):
    assert names(people, "sort age") == ["Bo", "Gu", "Di", "Al", "Cy", "Fo", "Ed"]
    assert names(people, "sort -age") == ["Fo", "Cy", "Al", "Di", "Bo", "Gu", "Ed"]  # stable, nulls last
    assert names(people, "sort city, -age") == ["Bo", "Ed", "Fo", "Cy", "Al", "Di", "Gu"]
    assert names(people, "sort name | sort city | head 3") == ["Bo", "Ed", "Al"]
    assert names(people, "sort -name | distinct city | head 3") == [None, "NY", "LA"]


def test_sort_nan(spark):
    df = spark.createDataFrame([(1, 2.0), (2, math.nan), (3, None), (4, -math.inf)], "i long, f double").repartition(1)
    assert names(df, "sort f") == [4, 1, 2, 3] and names(df, "sort -f") == [2, 1, 4, 3]


def test_distinct(people):
    assert rows(people, "distinct city") == [("NY",), ("LA",), (None,)]
    assert rows(people, "select city, age | transform age = age > 26 | distinct") == [("NY", True), ("LA", False), (None, True), ("LA", None), (None, False)]
    assert rows(people, "sort -age | distinct city") == [("NY",), (None,), ("LA",)]


def test_group_nests_rows_in_order(people):
    got = rows(people, "group city")
    assert [r[0] for r in got] == ["NY", "LA", None]
    assert [x["name"] for x in got[0][1]] == ["Al", "Cy", "Fo"] and got[1][1][1].asDict() == {"name": "Ed", "age": None, "city": "LA", "score": 2.5}
    assert schema(people, "group city as g")[1] == ("g", "list<record<age:int?, city:string?, name:string?, score:float?>>")
    assert [x["name"] for x in rows(people, "sort -age | group city")[0][1]] == ["Fo", "Cy", "Al"]


ALL = "n = count(), s = sum(age), a = avg(age), lo = min(age), hi = max(age), f = first(age), l = last(age), t = min(name), x = sum(score), k = max(score), r = sum(age) / count() + 1, z = min(age) is null"
NY = (3, 105, 35.0, 30, 40, 30, 40, "Al", 2.0, 1.5, 36.0, False)
LA = (2, 25, 25.0, 25, 25, 25, None, "Bo", 4.5, 2.5, 13.5, False)


@pytest.mark.parametrize("between", ["", "transform u = 1 | remove u | "])
def test_reduce_fused_and_not(people, between):
    got = rows(people, f"group city | {between}reduce {ALL} | remove grouped")
    assert got[0] == ("NY", *NY) and got[1] == ("LA", *LA)


def test_reduce_keeps_rows_and_may_replace_them(people):
    got = rows(people, "group city as g | reduce g n = count() | filter { n > 2 }")
    assert got[0][2] == 3 and len(got[0][1]) == 3
    assert rows(people, "group city | reduce grouped = count(), city = first(name)") == [("Al", 3), ("Bo", 2), ("Di", 2)]
    assert rows(people, "group city | reduce n = count() | select n") == [(3,), (2,), (2,)]
    assert rows(people, "group city | reduce n = count() | select city") == [("NY",), ("LA",), (None,)]


def test_reduce_over_a_loaded_list(spark):
    df = spark.createDataFrame([(1, [(1, 2.0), (None, 3.0)]), (2, [])], "i long, xs array<struct<a: long, b: double>>")
    assert sorted(rows(df, "reduce xs n = count(), s = sum(a), m = avg(b), f = first(a), l = last(a), h = max(b) | remove xs")) == [(1, 2, 1, 2.5, 1, None, 3.0), (2, 0, None, None, None, None, None)]
    null = spark.createDataFrame([(1, None)], "i long, xs array<struct<a: long>>")
    with pytest.raises(PySparkException):
        rows(null, "reduce xs n = count()")
    assert rows(null, "reduce xs n = count() | select i") == [(1,)]  # nobody asks


@pytest.mark.parametrize("between", ["", "transform u = 1 | "])
def test_nan_neither_replaces_nor_is_replaced(spark, between):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("a", 0.5), ("b", None), ("b", math.nan), ("b", 1.0), ("c", None)], "k string, v double").repartition(1)
    got = {r[0]: r[1:] for r in rows(df, f"group k | {between}reduce lo = min(v), hi = max(v) | select k, lo, hi")}
    assert got["a"] == (0.5, 1.0) and got["c"] == (None, None) and all(map(math.isnan, got["b"]))


def test_sum_overflows(spark):
    df = spark.createDataFrame([(1, 2**62), (1, 2**62)], "k long, v long")
    for between in ("", "transform u = 1 | "):
        with pytest.raises(PySparkException):
            rows(df, f"group k | {between}reduce s = sum(v) | select s")


def test_count_and_describe(people):
    assert rows(people, "count") == [(7,)] and rows(people, "filter { false } | count") == [(0,)]
    assert rows(people, "select name, age | transform ok = age > 1, one = 1 | describe") == [("name", "string", 7, "string?"), ("age", "int", 7, "int?"), ("ok", "bool", 7, "bool?"), ("one", "int", 7, "int")]
    assert rows(people, "filter { false } | group city | describe | select column, row_count") == [("city", 0), ("grouped", 0)]
    assert rows(people, "remove name, age, city, score | describe") == []


BAD = [
    "select nope", "select name.x", "remove nope", "rename nope = a", "rename name = age", "rename name = a, name = b", "rename name = a, age = a", "filter { age }", "filter { nope > 1 }", "sort nope", "transform a = 1, b = a",
    "group nope", "group city as city", "transform grouped = 1 | group grouped", "reduce x = count()", "group city | reduce x = upper(name)", "group city | reduce x = name", "group city | reduce x = sum(name)", "group city | reduce x = sum(nope)",
    "group city | reduce x = sum(age + 1)", "group city | reduce x = list(count())", "group city | reduce x = struct(a = count())", "group city | reduce g x = count()", "group city | select name", "group city | sort grouped", "distinct city | select age",
    "reduce name x = count()", "count | select name", "filter { false } | transform x = upper(age)", "group city | reduce n = count() | select missing", "transform b = true | sort b",
]


@pytest.mark.parametrize("text", BAD)
def test_rejected_before_rows(people, text):
    with pytest.raises(PlanError):
        schema(people, text)


def test_errors_come_only_from_what_is_read(people):
    assert rows(people, "transform y = year(name) | select age | count") == [(7,)]
    assert rows(people, "head 0 | transform y = year(name) | select y") == []
    assert rows(people, "transform y = if(name == \"Al\", 1, year(name)) | head 1 | select y") == [(1,)]
    with pytest.raises(PySparkException):
        rows(people, "transform y = year(name)")


def test_empty_input_keeps_schema(people):
    for text in ("group city | reduce n = count()", "sort age | distinct city", "tail 2", "transform x = age + 1 | select x"):
        assert rows(people, "filter { false } | " + text) == []
        assert schema(people, "filter { false } | " + text) == schema(people, text)


def test_struct_and_list_keys(spark):
    df = spark.createDataFrame([((1, None), [1, None]), ((1, None), [1, None]), ((None, 2), [1]), (None, None)], "r struct<a: long, b: long>, xs array<long>").repartition(1)
    assert [len(r[1]) for r in rows(df, "group r")] == [2, 1, 1] and [r[1] for r in rows(df, "group xs | reduce n = count() | remove grouped")] == [2, 1, 1]
    assert rows(df, "distinct r.a") == [(1,), (None,)] and len(rows(df, "distinct")) == 3
