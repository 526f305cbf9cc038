"""Binding and type-checking of expressions against a schema."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions import aggregates
from ..functions.scalar import FUNCTIONS
from ..functions.values import compare, coerce, equal, null_of
from ..lang import ast
from ..types import BOOL, FLOAT, NULL, ORDERABLE, STRING, LType, Schema, TypeConflict, contains, finalised, is_kind, list_of, record, unify

Resolve = Callable[[str], Column]


@dataclass(frozen=True)
class Bound:
    """A typed expression: ``build`` makes its Column from those of the top-level columns that it reads."""

    type: LType
    build: Callable[[Resolve], Column]
    reads: frozenset[str] = frozenset()
    literal: object = None


@dataclass(frozen=True)
class Aggregate:
    """An aggregate call of a reduce expression: its name in the fold, and its argument."""

    name: str
    path: tuple[str, ...] | None
    type: LType | None
    slot: str


@dataclass
class Reduction:
    """The aggregates that a reduce stage's expressions call, each once."""

    nested: Schema
    calls: list[Aggregate] = field(default_factory=list)

    def slot(self, name: str, path: tuple[str, ...] | None, t: LType | None) -> str:
        for c in self.calls:
            if (c.name, c.path) == (name, path):
                return c.slot
        self.calls.append(Aggregate(name, path, t, f"__agg{len(self.calls)}"))
        return self.calls[-1].slot


def find(schema: Schema, name: str) -> LType:
    for n, t in schema:
        if n == name:
            return t
    names = [n for n, _ in schema]
    hint = difflib.get_close_matches(name, names, 1, 0.6)
    raise PlanError(f"column {name!r} not found; available columns: {', '.join(names)}" + (f"; did you mean {hint[0]!r}?" if hint else ""))


def path_type(schema: Schema, parts: tuple[str, ...]) -> LType:
    """A nested field may be null wherever a record on its way may be."""
    t = find(schema, parts[0])
    nullable = t.nullable
    for part in parts[1:]:
        if t.kind != "record":
            raise PlanError(f"cannot take field {part!r} of column {parts[0]!r}: {t} is not a record")
        inner = t.field(part)
        if inner is None:
            raise PlanError(f"field {part!r} not found in column {parts[0]!r} of type {t}")
        t, nullable = inner, nullable or inner.nullable
    return t.maybe(nullable)


def path_column(c: Column, parts: tuple[str, ...]) -> Column:
    for part in parts:
        c = c.getField(part)
    return c


def bind_path(schema: Schema, parts: tuple[str, ...]) -> Bound:
    return Bound(path_type(schema, parts), lambda resolve: path_column(resolve(parts[0]), parts[1:]), frozenset(parts[:1]))


def bind(e, schema: Schema, reduction: Reduction | None = None) -> Bound:
    """``reduction``: the expression folds a group, so columns stand only in aggregates."""
    again = lambda x: bind(x, schema, reduction)
    if isinstance(e, ast.Literal):
        t = NULL if e.kind == "null" else LType(e.kind)
        return Bound(t, lambda _: F.lit(e.value) if t.kind != "int" else F.lit(e.value).cast("long"), literal=e.value)
    if isinstance(e, ast.Path):
        if reduction is not None:
            raise PlanError(f"column {e} cannot stand alone in reduce; use an aggregate such as first({e})")
        return bind_path(schema, e.parts)
    if isinstance(e, ast.IsNull):
        x = again(e.operand)
        return Bound(BOOL, lambda r: x.build(r).isNotNull() if e.negated else x.build(r).isNull(), x.reads)
    if isinstance(e, ast.Unary):
        return bind_unary(e, again(e.operand))
    if isinstance(e, ast.Binary):
        return bind_binary(e, again(e.left), again(e.right))
    if isinstance(e, (ast.StructOf, ast.ListOf)) and reduction is not None:
        raise PlanError(f"{'struct' if isinstance(e, ast.StructOf) else 'list'}() cannot be used in reduce")
    if isinstance(e, ast.StructOf):
        fields = [(n, again(x)) for n, x in e.fields]
        order = sorted(fields, key=lambda f: f[0])

        def make(r: Resolve) -> Column:
            # a struct without fields cannot be stored, so it is a struct of one hidden field there
            return F.struct(*[_typed(x, r).alias(n) for n, x in order]) if order else F.struct(F.lit(None).cast("string").alias("__empty"))

        return Bound(record((n, finalised(x.type)) for n, x in fields), make, union(x for _, x in fields))
    if isinstance(e, ast.ListOf):
        return bind_list([again(x) for x in e.items])
    return bind_call(e, again, reduction)


def _typed(x: Bound, r: Resolve) -> Column:
    return null_of(finalised(x.type)) if x.type.kind == "null" else x.build(r)


def union(xs) -> frozenset[str]:
    return frozenset().union(*[x.reads for x in xs])


def bind_unary(e: ast.Unary, x: Bound) -> Bound:
    if e.op == "not":
        if not is_kind(x.type, "bool"):
            raise PlanError(f"'not' needs a boolean, got {x.type}")
        return Bound(BOOL.maybe(x.type.nullable), lambda r: ~x.build(r).cast("boolean"), x.reads)
    if x.type.kind == "null":
        return x
    if not x.type.numeric:
        raise PlanError(f"'-' needs a number, got {x.type}")
    return Bound(x.type, lambda r: -x.build(r), x.reads)


def bind_binary(e: ast.Binary, a: Bound, b: Bound) -> Bound:
    op, s, t = e.op, a.type, b.type
    nullable, reads = s.nullable or t.nullable, a.reads | b.reads
    if op in ("and", "or"):
        if not is_kind(s, "bool") or not is_kind(t, "bool"):
            raise PlanError(f"'{op}' needs booleans, got {s} and {t}")
        if op == "and":
            return Bound(BOOL.maybe(nullable), lambda r: a.build(r).cast("boolean") & b.build(r).cast("boolean"), reads)
        return Bound(BOOL.maybe(nullable), lambda r: a.build(r).cast("boolean") | b.build(r).cast("boolean"), reads)
    if op in ("==", "!=", "<", ">", "<=", ">="):
        if contains(s, "union") or contains(t, "union"):
            raise PlanError("union values cannot be compared")
        if op in ("==", "!="):
            if "null" in (s.kind, t.kind):
                raise PlanError(f"'{op}' with null; use is null or is not null")
            able = not contains(s, "mixed") and not contains(t, "mixed")
        else:
            able = s.kind in ORDERABLE | {"null"} and t.kind in ORDERABLE | {"null"}
        try:
            unify(s, t)
        except TypeConflict:
            able = False
        if not able:
            raise PlanError(f"cannot compare {s} with {t}")
        if "null" in (s.kind, t.kind):
            return Bound(BOOL.maybe(), lambda r: F.lit(None).cast("boolean"), reads)
        if op == "==":
            return Bound(BOOL.maybe(nullable), lambda r: equal(a.build(r), s, b.build(r), t), reads)
        if op == "!=":
            return Bound(BOOL.maybe(nullable), lambda r: ~equal(a.build(r), s, b.build(r), t), reads)
        return Bound(BOOL.maybe(nullable), lambda r: compare(op, a.build(r), s, b.build(r), t), reads)
    if op == "+" and is_kind(s, "string") and is_kind(t, "string") and "string" in (s.kind, t.kind):
        return Bound(STRING.maybe(nullable), lambda r: F.concat(a.build(r).cast("string"), b.build(r).cast("string")), reads)
    if not all(x.numeric or x.kind == "null" for x in (s, t)):
        wanted = "numbers or strings" if op == "+" else "numbers"
        raise PlanError(f"'{op}' needs {wanted}, got {s} and {t}")
    if op == "/":
        zero = b.literal is None or b.literal == 0
        return Bound(FLOAT.maybe(nullable or zero), lambda r: F.try_divide(a.build(r).cast("double"), b.build(r).cast("double")), reads)
    if s.kind == t.kind == "null":
        return Bound(NULL, lambda r: F.lit(None), reads)
    out = unify(s, t)

    def build(r: Resolve) -> Column:
        x, y = coerce(a.build(r), s, out), coerce(b.build(r), t, out)
        return x + y if op == "+" else x - y if op == "-" else x * y

    return Bound(out.maybe(nullable), build, reads)


def bind_list(items: list[Bound]) -> Bound:
    if not items:
        return Bound(LType("list", elem=NULL), lambda r: F.array().cast("array<string>"))
    elem = items[0].type
    for x in items[1:]:
        elem = unify(elem, x.type, in_list=True)
    elem = finalised(elem)
    if contains(elem, "union") and any(contains(x.type, "union") for x in items) and elem.kind == "mixed":
        raise PlanError("list() cannot mix union values with others")
    return Bound(list_of(elem), lambda r: F.array(*[coerce(x.build(r), x.type, elem) for x in items]), union(items))


def bind_call(e: ast.Call, again, reduction: Reduction | None) -> Bound:
    if e.name in aggregates.AGGREGATES:
        if reduction is None:
            raise PlanError(f"{e.name}() can only be used in reduce")
        return bind_aggregate(e, reduction)
    known = FUNCTIONS.get(e.name)
    if known is None:
        hint = difflib.get_close_matches(e.name.lower(), [*FUNCTIONS, *aggregates.AGGREGATES], 1, 0.6)
        raise PlanError(f"unknown function {e.name!r}" + (f"; did you mean {hint[0]!r}?" if hint else ""))
    if reduction is not None:
        raise PlanError(f"{e.name}() cannot be used in reduce; only {', '.join(aggregates.AGGREGATES)} can")
    least, most = known.arity
    if not least <= len(e.args) <= (most or len(e.args)):
        raise PlanError(f"{e.name}() takes {least if least == most else f'at least {least}'} argument{'s' * (least != 1)}, got {len(e.args)}")
    args = [again(x) for x in e.args]
    types = [x.type for x in args]
    literals = [x.literal for x in args]
    out = known.check(types)
    if e.name == "matches" and literals[1] is not None:
        known.build([F.lit(""), F.lit(literals[1])], types, literals)  # a bad pattern fails in planning

    def build(r: Resolve) -> Column:
        columns = []
        for x in args:
            c = x.build(r)
            columns.append(c.cast("string") if x.type.kind == "null" and e.name not in ("coalesce", "if", "list_contains", "list_len") else c)
        if e.name == "if":
            columns[0] = columns[0].cast("boolean")
        if e.name == "substr":
            columns[1:] = [c.cast("long") for c in columns[1:]]
        return known.build(columns, types, literals)

    return Bound(out, build, union(args))


def bind_aggregate(e: ast.Call, reduction: Reduction) -> Bound:
    if e.name == "count":
        if e.args:
            raise PlanError("count() is given arguments, but counts rows")
        slot = reduction.slot("count", None, None)
        return Bound(aggregates.check("count", None), lambda r: r(slot), frozenset([slot]))
    if len(e.args) != 1:
        raise PlanError(f"{e.name}() takes 1 argument, got {len(e.args)}")
    if not isinstance(e.args[0], ast.Path):
        raise PlanError(f"{e.name}() needs a column of the grouped rows")
    parts = e.args[0].parts
    try:
        t = path_type(reduction.nested, parts)
        out = aggregates.check(e.name, t)
    except PlanError as error:
        raise PlanError(f"{e.name}({e.args[0]}): {error}") from None
    slot = reduction.slot(e.name, parts, t)
    return Bound(out, lambda r: r(slot), frozenset([slot]))
