"""Logical types.

Spark's own nullability is lost at every file scan, and its coercions are looser than the language's, so each plan carries
these types beside its DataFrame. ``spark_type`` says how values are stored: records as structs with fields sorted by
name (equality is by name), unions as a tag and one member for each branch, mixed values as JSON text.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

SCALARS = {"int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType(), "timestamp": T.TimestampNTZType(), "date": T.DateType()}
#: Extensions (timestamp, date) order like the language's own orderable types.
ORDERABLE = {"int", "float", "string", "timestamp", "date"}


class TypeConflict(Exception):
    pass


@dataclass(frozen=True)
class LType:
    kind: str
    nullable: bool = False
    fields: tuple[tuple[str, LType], ...] = ()  # in display order
    elem: LType | None = None
    branches: tuple[LType, ...] = ()

    def __str__(self) -> str:
        if self.kind == "record":
            out = "record<" + ", ".join(f"{n}:{t}" for n, t in sorted(self.fields, key=lambda x: x[0])) + ">"
        elif self.kind == "list":
            out = f"list<{self.elem}>"
        elif self.kind == "union":
            out = "union<" + ",".join(map(str, self.branches)) + ">"
        else:
            out = self.kind
        return out + "?" * self.nullable

    def maybe(self, nullable: bool = True) -> LType:
        return replace(self, nullable=self.nullable or nullable)

    def plain(self) -> LType:
        return replace(self, nullable=False)

    def field(self, name: str) -> LType | None:
        return next((t for n, t in self.fields if n == name), None)

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float")


INT, FLOAT, STRING, BOOL = LType("int"), LType("float"), LType("string"), LType("bool")
NULL = LType("null", True)
MIXED = LType("mixed")

Schema = list[tuple[str, LType]]


def record(fields) -> LType:
    return LType("record", fields=tuple(fields))


def list_of(elem: LType) -> LType:
    return LType("list", elem=elem)


def is_kind(t: LType, kind: str) -> bool:
    """Of this kind, or a null that may become it."""
    return t.kind in (kind, "null")


def contains(t: LType, kind: str) -> bool:
    return t.kind == kind or any(contains(x, kind) for _, x in t.fields) or (t.elem is not None and contains(t.elem, kind)) or any(contains(b, kind) for b in t.branches)


def shape(t: LType) -> LType:
    """The type without nullability, fields by name: what keys of joins must share."""
    return LType(t.kind, False, tuple(sorted(((n, shape(x)) for n, x in t.fields), key=lambda x: x[0])), shape(t.elem) if t.elem else None, tuple(shape(b) for b in t.branches))


def unify(a: LType, b: LType, in_list: bool = False, permissive: bool = False) -> LType:
    """The type that holds both. ``in_list``: unlike kinds give mixed; ``permissive``: they give string; else TypeConflict."""
    nullable = a.nullable or b.nullable
    if a.kind == "null":
        return b.maybe()
    if b.kind == "null":
        return a.maybe()
    if "mixed" in (a.kind, b.kind) and (in_list or a.kind == b.kind):
        return LType("mixed", nullable)
    if "union" in (a.kind, b.kind):
        return unify_unions(a, b, nullable)
    if a.numeric and b.numeric:
        return LType("int" if a.kind == b.kind == "int" else "float", nullable)
    if a.kind != b.kind:
        if in_list:
            return LType("mixed", nullable)
        if permissive:
            return LType("string", nullable)
        raise TypeConflict(f"{a} and {b}")
    if a.kind == "record":
        names = list(dict.fromkeys([n for n, _ in a.fields] + [n for n, _ in b.fields]))
        out = []
        for n in names:
            x, y = a.field(n), b.field(n)
            out.append((n, unify(x, y, False, permissive) if x and y else (x or y).maybe()))
        return LType("record", nullable, tuple(out))
    if a.kind == "list":
        return LType("list", nullable, elem=unify(a.elem, b.elem, not permissive, permissive))
    return LType(a.kind, nullable)


def unify_unions(a: LType, b: LType, nullable: bool) -> LType:
    branches = list(a.branches if a.kind == "union" else (a.plain(),))
    for x in b.branches if b.kind == "union" else (b.plain(),):
        if x not in branches:
            if a.kind == b.kind == "union" or any(x.kind == y.kind or x.numeric and y.numeric for y in branches):
                branches = add_branch(branches, x)
            else:
                raise TypeConflict(f"{a} and {b}")
    return union_of(branches, nullable)


def add_branch(branches: list[LType], x: LType) -> list[LType]:
    for i, y in enumerate(branches):
        if y == x or y.numeric and x.numeric:
            return [*branches[:i], unify(y, x), *branches[i + 1 :]]
    return [*branches, x]


def union_of(branches, nullable: bool = False) -> LType:
    """A union of branches; one branch, or numbers only, is no union."""
    out: list[LType] = []
    for b in branches:
        if b.kind == "null":
            nullable = True
        else:
            nullable = nullable or b.nullable
            out = add_branch(out, b.plain())
    if not out:
        return NULL
    return out[0].maybe(nullable) if len(out) == 1 else LType("union", nullable, branches=tuple(out))


def finalised(t: LType) -> LType:
    """Positions that only ever held null become nullable strings."""
    if t.kind == "null":
        return STRING.maybe()
    return replace(t, fields=tuple((n, finalised(x)) for n, x in t.fields), elem=finalised(t.elem) if t.elem else None)


def spark_type(t: LType) -> T.DataType:
    if t.kind in SCALARS:
        return SCALARS[t.kind]
    if t.kind == "record":
        own = sorted(t.fields, key=lambda x: x[0]) or [("__empty", STRING)]  # an empty struct cannot be stored
        return T.StructType([T.StructField(n, spark_type(x)) for n, x in own])
    if t.kind == "list":
        return T.ArrayType(spark_type(t.elem))
    if t.kind == "union":
        return T.StructType([T.StructField("tag", T.IntegerType()), *[T.StructField(f"m{i}", spark_type(b)) for i, b in enumerate(t.branches)]])
    return T.StringType()  # mixed: JSON text; null


def from_spark(t: T.DataType, nullable: bool = True) -> LType:
    """The logical type of a DataFrame's column. Decimals read as float; maps and intervals have none."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return LType("int", nullable)
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return LType("float", nullable)
    if isinstance(t, (T.StringType, T.BinaryType, T.NullType)):
        return LType("string", nullable)
    if isinstance(t, T.BooleanType):
        return LType("bool", nullable)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return LType("timestamp", nullable)
    if isinstance(t, T.DateType):
        return LType("date", nullable)
    if isinstance(t, T.ArrayType):
        return LType("list", nullable, elem=from_spark(t.elementType, t.containsNull))
    if isinstance(t, T.StructType):
        return LType("record", nullable, tuple((f.name, from_spark(f.dataType, f.nullable)) for f in t.fields))
    raise TypeConflict(f"values of type {t.simpleString()} are not supported")
