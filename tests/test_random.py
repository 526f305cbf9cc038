"""Random pipelines against a plain evaluator of the language's row semantics, order included."""

import math
import random

import pytest

from pipewright.api import pipe

COLUMNS = ["a", "b", "f", "s", "t"]
SCHEMA = "a long, b long, f double, s string, t boolean"


def table(rng):
    pick = lambda *xs: rng.choice(xs)
    n = rng.choice([0, 1, 7, 25])
    return [(pick(None, 0, 1, 2, 3), rng.randrange(100), pick(None, 0.5, 1.0, 2.0, math.inf, math.nan), pick(None, "", "x", "Yz", "é"), pick(None, True, False)) for _ in range(n)]


def null(f):
    return lambda *xs: None if any(x is None for x in xs) else f(*xs)


def both(x, y):
    return False if x is False or y is False else None if x is None or y is None else True


#: Text, columns read, value.
EXPRESSIONS = [
    ("a + b", "ab", null(lambda a, b: a + b)), ("a * 2 - b", "ab", null(lambda a, b: a * 2 - b)), ("b / a", "ab", lambda a, b: None if a is None or b is None or a == 0 else b / a), ("f * 2", "f", null(lambda f: f * 2)),
    ("a == f", "af", null(lambda a, f: a == f)), ("a < f", "af", null(lambda a, f: a < f)), ("not (f > 1)", "f", null(lambda f: not f > 1)), ("f != f", "f", null(lambda f: f != f)), ("s < \"Z\"", "s", null(lambda s: s.encode() < b"Z")),
    ("t and a > 1", "ta", lambda t, a: both(t, None if a is None else a > 1)), ("t or a > 1", "ta", lambda t, a: (lambda x, y: True if x or y else None if x is None or y is None else False)(t, None if a is None else a > 1)),
    ("s is null", "s", lambda s: s is None), ("upper(s) + \"!\"", "s", null(lambda s: s.upper() + "!")), ("str_len(s)", "s", null(len)), ("substr(s, -1, 1)", "s", null(lambda s: s[-1:])),
    ("coalesce(a, b)", "ab", lambda a, b: b if a is None else a), ("coalesce(f, a)", "fa", lambda f, a: f if f is not None else None if a is None else float(a)), ("if(t, a, b)", "tab", lambda t, a, b: a if t else b),
    ("list_contains(list(a, 2), b)", "ab", lambda a, b: None if b is None else b == 2 or a == b), ("list_len(list(a, b))", "ab", lambda a, b: 2),
]
KINDS = {"+": "int"}


def key(v):
    return ("nan",) if isinstance(v, float) and math.isnan(v) else (v,)


def whole(row):
    return tuple(key(v) for v in row)


def sort_rows(rows, columns, name, down):
    i = columns.index(name)
    rank = lambda v: (math.isnan(v), 0 if math.isnan(v) else v) if isinstance(v, float) else v.encode() if isinstance(v, str) else v
    have = [r for r in rows if r[i] is not None]
    have.sort(key=lambda r: rank(r[i]), reverse=False)
    if down:
        groups: list = []
        for r in have:
            if groups and rank(groups[-1][0][i]) == rank(r[i]):
                groups[-1].append(r)
            else:
                groups.append([r])
        have = [r for g in reversed(groups) for r in g]
    return have + [r for r in rows if r[i] is None]


def least(values, pick):
    out = None
    for v in values:
        if v is None:
            continue
        if out is None or pick(v, out):
            out = v
    return out


AGGREGATES = {
    "count": lambda vs: len(vs), "first": lambda vs: vs[0], "last": lambda vs: vs[-1], "min": lambda vs: least(vs, lambda v, o: v < o), "max": lambda vs: least(vs, lambda v, o: v > o),
    "sum": lambda vs: sum(x) if (x := [v for v in vs if v is not None]) else None, "avg": lambda vs: math.fsum(x) / len(x) if (x := [v for v in vs if v is not None]) else None,
}


def stage(rng, rows, columns):
    """(text, rows, columns) of a random stage; the five columns stay, so that any may follow."""
    kind = rng.choice(["filter", "transform", "sort", "head", "tail", "distinct", "rename"])
    if kind == "filter":
        text, reads, f = rng.choice([e for e in EXPRESSIONS if any(x in e[0] for x in ("==", "<", ">", "!=", "is null", "contains", " and ", " or "))])
        return f"filter {{ {text} }}", [r for r in rows if f(*[r[columns.index(c)] for c in reads]) is True], columns
    if kind == "transform":
        text, reads, f = rng.choice([EXPRESSIONS[0], EXPRESSIONS[1], EXPRESSIONS[15], EXPRESSIONS[17]])
        i = columns.index("a")
        return f"transform a = {text}", [(*r[:i], f(*[r[columns.index(c)] for c in reads]), *r[i + 1 :]) for r in rows], columns
    if kind == "sort":
        name, down = rng.choice("abfs"), rng.random() < 0.5
        return f"sort {'-' * down}{name}", sort_rows(rows, columns, name, down), columns
    if kind in ("head", "tail"):
        n = rng.randrange(12)
        return f"{kind} {n}", rows[:n] if kind == "head" else rows[len(rows) - n :] if n < len(rows) else rows, columns
    if kind == "distinct":
        return "distinct", list({whole(r): r for r in reversed(rows)}.values())[::-1], columns
    return "rename a = b, b = a", rows, ["b" if c == "a" else "a" if c == "b" else c for c in columns]


def ending(rng, rows, columns):
    kind = rng.choice(["all", "values", "group", "group", "count", "distinct"])
    at = columns.index
    if kind == "all":
        return "", rows
    if kind == "count":
        return " | count", [(len(rows),)]
    if kind == "values":
        chosen = rng.sample(EXPRESSIONS, 4)
        names = [f"v{i}" for i in range(4)]
        text = f" | transform {', '.join(f'{n} = {e[0]}' for n, e in zip(names, chosen, strict=True))} | select {', '.join(names)}"
        return text, [tuple(f(*[r[at(c)] for c in reads]) for _, reads, f in chosen) for r in rows]
    keys = rng.sample("ast", rng.randrange(1, 3))
    groups: dict = {}
    for r in rows:
        groups.setdefault(tuple(r[at(k)] for k in keys), []).append(r)
    if kind == "distinct":
        return f" | distinct {', '.join(keys)}", list(groups)
    calls = [(n, c) for n in AGGREGATES for c in "bfs" if not (n in ("sum", "avg") and c in "fs")]
    chosen = rng.sample(calls, 4)
    between = rng.choice(["", "transform zz = 1 | remove zz | "])
    text = f" | group {', '.join(keys)} | {between}reduce {', '.join(f'v{i} = {n}({c if n != 'count' else ''})' for i, (n, c) in enumerate(chosen))} | remove grouped"
    out = [(*k, *[AGGREGATES[n]([r[at(c)] for r in rs]) for n, c in chosen]) for k, rs in groups.items()]
    return text, out


def close(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isfinite(a):
        return math.isclose(a, b, rel_tol=1e-12)
    return key(a) == key(b) and (type(a) is type(b) or {type(a), type(b)} <= {int, float})


@pytest.mark.parametrize("seed", range(40))
def test_pipelines(spark, seed):
    rng = random.Random(seed)
    rows, columns, texts = table(rng), COLUMNS, []
    df = spark.createDataFrame(rows, SCHEMA).repartition(1) if seed % 2 else spark.createDataFrame(rows, SCHEMA)
    for _ in range(rng.randrange(1, 5)):
        text, rows, columns = stage(rng, rows, columns)
        texts.append(text)
    last, want = ending(rng, rows, columns)
    text = " | ".join(texts) + last
    got = [tuple(r) for r in pipe(df, text, ordered=True).collect()]
    assert len(got) == len(want), text
    for g, w in zip(got, want, strict=True):
        assert len(g) == len(w) and all(map(close, g, w)), f"{text}\n{g}\n{w}"
