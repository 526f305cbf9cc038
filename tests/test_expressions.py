import math

import pytest
from pyspark.errors import PySparkException

from pipewright.api import pipe
from pipewright.errors import PlanError
from pipewright.lang.parser import parse_pipe
from pipewright.plans.planner import bind_operations
from pipewright.sources import FrameSource

SCHEMA = "i long, n long, f double, nan double, s string, ns string, b boolean, nb boolean, xs array<long>, ss array<string>, r struct<a: long, q: struct<z: string>>, big long"
ROW = [(7, None, 2.5, math.nan, "Héllo", None, True, None, [1, None, 3], ["a", "b"], (5, ("deep",)), 2**53 + 1)]


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame(ROW, SCHEMA).cache()


def value(df, text):
    return pipe(df, f"transform out = {text} | select out").first()[0]


def type_of(df, text):
    plan = bind_operations(FrameSource(df), parse_pipe(f"transform out = {text} | select out"), None)
    return str(plan.schema[0][1])


VALUES = {
    # arithmetic
    "i + 1": 8, "i - 10": -3, "i * 2": 14, "i * 2.0": 14.0, "-i": -7, "-f": -2.5, "i + n": None, "i / 2": 3.5, "i / 0": None, "f / 0.0": None, "i / -0.0": None, "s + \"!\"": "Héllo!", "s + ns": None,
    "1 - 2 - 3": -4, "2 + 3 * 4": 14, "(2 + 3) * 4": 20, "i -1": 6,
    # comparison
    "i == 7": True, "i == 7.0": True, "i != 7": False, "i > 6.5": True, "n == 1": None, "s == \"Héllo\"": True, "s < \"a\"": True, "b == true": True, "nan == nan": False, "nan != nan": True, "nan > 1": False, "nan < 1": False, "f >= 2.5": True,
    "big == 9007199254740992.0": False, "big > 9007199254740992.0": True, "9007199254740992.0 < big": True, "big <= 9007199254740992.0": False, "xs == list(1, null, 3)": True, "xs == list(1.0, null, 3.0)": True, "xs == list(1, 2, 3)": False,
    "r == struct(q = struct(z = \"deep\"), a = 5)": True, "r == struct(q = struct(z = \"deep\"), a = 5.0)": True, "struct(a = null) == struct(a = ns)": True,
    # logic
    "b and nb": None, "b or nb": True, "not nb": None, "false and nb": False, "nb or false": None, "not (i > 3)": False, "n is null": True, "n is not null": False, "i + 1 is null": False, "not n is null": False, "null and b": None,
    # strings
    "upper(s)": "HÉLLO", "lower(s)": "héllo", "trim(\" \\t x y\\n \")": "x y", "str_len(s)": 5, "str_len(\"日本\")": 2, "str_len(ns)": None,
    "substr(s, 0, 2)": "Hé", "substr(s, 1, 100)": "éllo", "substr(s, -3, 2)": "ll", "substr(s, -100, 3)": "Hél", "substr(s, 5, 1)": "", "substr(s, 100, 5)": "", "substr(s, 2, 0)": "", "substr(s, 1, 9223372036854775807)": "éllo", "substr(ns, 0, 1)": None, "substr(s, n, 1)": None,
    "str_contains(s, \"ll\")": True, "str_contains(s, \"\")": True, "starts_with(s, \"H\")": True, "ends_with(s, \"x\")": False, "starts_with(ns, \"a\")": None,
    "matches(s, \"l+\")": True, "matches(s, \"^l\")": False, "matches(\"a\\n\", \"a$\")": False, "matches(\"a\", \"^a$\")": True, "matches(\"x.y\", \"[.]\")": True, "matches(\"ab\", \"(?i)AB\")": True, "matches(s, ns)": None, "matches(\"a1\", \"[[:alpha:]][[:digit:]]\")": True,
    # dates
    "year(\"2024-02-29\")": 2024, "month(\"2024-02-29T23:59:59\")": 2, "day(\"2024-02-29T23:59:59.123+05:30\")": 29, "day(\"2024-12-31T23:59:59Z\")": 31, "year(\"2024-02-29 10:11:12\")": 2024, "month(\"02/29/2024\")": 2, "day(\"2/9/2024\")": 9, "year(\"2024/02/29\")": 2024, "year(ns)": None,
    # lists and choice
    "list_len(xs)": 3, "list_len(list())": 0, "list_contains(xs, 3)": True, "list_contains(xs, 3.0)": True, "list_contains(xs, 9)": False, "list_contains(xs, n)": None, "list_contains(list(1, \"a\"), \"a\")": True, "list_contains(list(1, \"a\"), 1.0)": True, "list_contains(list(1, \"1\"), \"1\")": True, "list_contains(list(1, true), \"true\")": False, "list_contains(list(list(1), list(2)), list(2))": True,
    "coalesce(n, i)": 7, "coalesce(n, 1.5)": 1.5, "coalesce(i, 1.5)": 7.0, "coalesce(ns, null)": None, "if(nb, 1, 2)": 2, "if(b, 1, 2.5)": 1.0, "if(i > 5, \"x\", null)": "x", "if(true, 1, i / 0)": 1.0, "coalesce(i, year(\"no date\"))": 7,
    "list(1, 2.5)": [1.0, 2.5], "r.q.z": "deep", "r.a + 1": 6,
}


def test_values(one):
    names = [f"out{i}" for i in range(len(VALUES))]
    row = pipe(one, "transform " + ", ".join(f"{n} = {t}" for n, t in zip(names, VALUES, strict=True)) + " | select " + ", ".join(names)).first()
    for text, got, want in zip(VALUES, row, VALUES.values(), strict=True):
        assert got == want and type(got) is type(want), f"{text}: {got!r}"


TYPES = {
    "i + 1": "int?", "1 + 1": "int", "1 + 2.0": "float", "1 / 2": "float", "1 / 0": "float?", "1 / i": "float?", "n + 1": "int?", "null": "string?", "null + 1": "int?", "1 == 2": "bool", "n == 1": "bool?", "n is null": "bool",
    "upper(\"x\")": "string", "str_len(ns)": "int?", "coalesce(n, 1)": "int", "coalesce(n, 1.0)": "float", "if(b, 1, null)": "int?", "list(1, null)": "list<int?>", "list(1, \"x\")": "list<mixed>", "list()": "list<string?>", "if(b, xs, list())": "list<int?>?",
    "struct(b = 1, a = null)": "record<a:string?, b:int>", "struct()": "record<>", "r.q": "record<z:string?>?", "list(struct(a = 1), struct(a = 2.0, b = 1))": "list<record<a:float, b:int?>>",
}


@pytest.mark.parametrize("text", TYPES)
def test_types(one, text):
    assert type_of(one, text) == TYPES[text]


BAD = [
    "missing", "r.nope", "i.x", "s + 1", "i + b", "-s", "not i", "b and 1", "s == 1", "b < true", "xs < xs", "xs == 1", "r == 1", "list(1, \"a\") == list(1, \"a\")", "upper(i)", "Upper(s)", "nope(1)", "count()", "sum(i)", "upper()", "upper(s, s)",
    "substr(s, 1)", "substr(s, \"1\", 2)", "str_len(xs)", "list_len(s)", "list_contains(xs, \"a\")", "coalesce()", "coalesce(1, \"a\")", "if(1, 2, 3)", "if(b, 1, \"a\")", "if(b, 1)", "year(i)", "matches(s, \"(\")", "matches(s, \"(?=a)\")", "matches(s, \"(a)\\\\1\")", "matches(s, 1)",
]


@pytest.mark.parametrize("text", BAD)
def test_rejected_in_planning(one, text):
    with pytest.raises(PlanError):
        type_of(one, text)


FAILING = ["9223372036854775807 + i", "-9223372036854775808 - i", "9223372036854775807 * i", "-(0 - 9223372036854775807 - 1)", "substr(s, 0, -1)", "year(s)", "year(\"2024-02-30\")", "year(\"2024-2-3\")", "year(\"13/01/2024\")", "day(\"2024-01-01T25:00:00\")", "year(\"2024-01-01x\")", "year(\"\")"]


@pytest.mark.parametrize("text", FAILING)
def test_fails_on_rows(one, text):
    with pytest.raises(PySparkException):
        value(one, text)


def test_names_are_case_sensitive(spark):
    df = spark.createDataFrame([(1, 2)], "a long, A long")
    pipe(df.limit(0), "head")  # configures the session
    assert pipe(df, "transform x = a * 10 + A | select x, A").first() == (12, 2)


def test_odd_names(spark):
    df = spark.createDataFrame([(1, (2,))], "`a.b` long, `c d` struct<`e f`: long>")
    assert pipe(df, "transform `x y` = `a.b` + `c d`.`e f` | select `x y`, `c d`.`e f`").first().asDict() == {"x y": 3, "c d_e f": 2}


def test_filter_drops_null(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "n string, f boolean")
    keep = lambda t: [r.n for r in pipe(df, f"filter {{ {t} }}", ordered=True).collect()]
    assert keep("f") == ["a"] and keep("not f") == ["b"] and keep("f is null") == ["c"] and keep("f or f is null") == ["a", "c"] and keep("null") == []
