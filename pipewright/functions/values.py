"""Columns for values: coercion, literals, exact comparison, structural equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import LType, shape, spark_type


def null_of(t: LType) -> Column:
    return F.lit(None).cast(spark_type(t))


def field(c: Column, name: str) -> Column:
    return c.getField(name)


def as_json(c: Column, t: LType) -> Column:
    """A value as JSON text; floats keep a point, so that numbers keep their kind."""
    if t.kind == "mixed":
        return c
    whole = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def coerce(c: Column, have: LType, want: LType) -> Column:
    """Only int to float, null to anything, and anything to mixed are changes; the rest is looked through."""
    if have.kind == "null":
        return null_of(want)
    if want.kind == "mixed":
        return as_json(c, have)
    if have.kind == "int" and want.kind == "float":
        return c.cast("double")
    if want.kind == "union" and have.kind != "union":
        at = next(i for i, b in enumerate(want.branches) if b.kind == have.kind or b.numeric and have.numeric)
        members = [coerce(c, have, b) if i == at else null_of(b) for i, b in enumerate(want.branches)]
        return F.when(c.isNotNull(), F.struct(F.lit(at).alias("tag"), *[m.alias(f"m{i}") for i, m in enumerate(members)]))
    if shape(have) == shape(want):
        return c
    if want.kind == "list":
        return F.transform(c, lambda x: coerce(x, have.elem, want.elem))
    if want.kind == "record":
        fields = []
        for name, t in sorted(want.fields, key=lambda x: x[0]):
            own = have.field(name)
            fields.append((coerce(field(c, name), own, t) if own else null_of(t)).alias(name))
        return F.when(c.isNotNull(), F.struct(*fields))
    return c.cast(spark_type(want))


def order_exact(i: Column, f: Column) -> Column:
    """-1, 0 or 1 as the integer is less than, equal to or greater than the float, without rounding it; null for NaN or null."""
    floor = F.floor(f)
    whole = floor.cast("long")
    inside = F.when(i < whole, -1).when(i > whole, 1).when(f > floor.cast("double"), -1).otherwise(0)
    known = i.isNotNull() & f.isNotNull() & ~F.isnan(f)
    return F.when(known, F.when(f >= F.lit(2.0**63), -1).when(f < F.lit(-(2.0**63)), 1).otherwise(inside))


def both(left: Column, right: Column, test: Column) -> Column:
    return F.when(left.isNotNull() & right.isNotNull(), test)


def equal(a: Column, ta: LType, b: Column, tb: LType) -> Column:
    """Null if either is null; NaN equals nothing; inside lists and records, nulls equal nulls."""
    if {ta.kind, tb.kind} == {"int", "float"}:
        sign = order_exact(a, b) if ta.kind == "int" else order_exact(b, a)
        return both(a, b, F.coalesce(sign == 0, F.lit(False)))
    if ta.kind == "float":
        return both(a, b, (a == b) & ~F.isnan(a))
    if ta.kind in ("list", "record") and shape(ta) != shape(tb):
        return both(a, b, same(a, ta, b, tb))
    return a == b


def same(a: Column, ta: LType, b: Column, tb: LType) -> Column:
    """True or false: structural equality in which nulls equal nulls."""
    if ta.kind == "null" or tb.kind == "null":
        return a.isNull() & b.isNull()
    if ta.kind == tb.kind == "list":
        pairs = F.zip_with(a, b, lambda x, y: same(x, ta.elem, y, tb.elem))
        inside = (F.size(a) == F.size(b)) & F.forall(pairs, lambda x: x)
    elif ta.kind == tb.kind == "record":
        inside = F.lit(True)
        for name in sorted({n for n, _ in ta.fields} | {n for n, _ in tb.fields}):
            x, y = ta.field(name), tb.field(name)
            inside = inside & (same(field(a, name), x, field(b, name), y) if x and y else F.lit(False))
    else:
        inside = F.coalesce(equal(a, ta, b, tb), F.lit(False))
    return F.coalesce((a.isNull() & b.isNull()) | (a.isNotNull() & b.isNotNull() & inside), F.lit(False))


def compare(op: str, a: Column, ta: LType, b: Column, tb: LType) -> Column:
    """<, >, <=, >=; NaN is neither."""
    tests = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    if {ta.kind, tb.kind} == {"int", "float"}:
        sign = order_exact(a, b) if ta.kind == "int" else -order_exact(b, a)
        return both(a, b, F.coalesce(tests[op](sign, F.lit(0)), F.lit(False)))
    out = tests[op](a, b)
    nan = [F.isnan(c) for c, t in ((a, ta), (b, tb)) if t.kind == "float"]
    for n in nan:
        out = both(a, b, out & ~n)
    return out
