"""Operations on single rows, and on the ends of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import null_of
from ..types import finalised
from .state import ORDER, State, quoted


def filter_rows(state: State, op) -> State:
    return state.with_columns(state.df.where(op.test.build(state.column).cast("boolean")), state.schema)


def project(state: State, op, needed) -> State:
    """One select, so that all right sides see the input; columns that nobody needs are left out."""
    live = [(n, b) for n, b in op.columns if needed is None or n in needed]
    columns = [(null_of(finalised(b.type)) if b.type.kind == "null" else b.build(state.column)).alias(n) for n, b in live]
    schema = [(n, t) for n, t in op.schema if needed is None or n in needed]
    return State(state.df.select(*columns, *state.hidden()), schema, state.order)


def head(state: State, op) -> State:
    return state.with_columns(state.sorted().limit(op.n), state.schema)


def tail(state: State, op) -> State:
    return state.with_columns(state.df.orderBy(*state.keys(backwards=True)).limit(op.n), state.schema)


def sort(state: State, op) -> State:
    """The keys become the order, the order before breaks ties. No row moves until someone needs them in order."""
    start = sum(n.startswith("__key") for n, _ in state.order)
    names = [f"__key{start + i}" for i in range(len(op.keys))]
    keys = [b.build(state.column).alias(n) for (b, _), n in zip(op.keys, names, strict=True)]
    schema = state.schema
    df = state.df.select(*[quoted(n) for n, _ in schema], *state.hidden(), *keys)
    order = [(n, down) for n, (_, down) in zip(names, op.keys, strict=True)] + state.order
    return State(df, schema, order)


def distinct(state: State, op, ordered: bool) -> State:
    """By the first occurrence if order matters; else as an aggregation that combines before its shuffle."""
    columns = [b.build(state.column).alias(n) for n, b in op.columns]
    if not columns:
        return state.with_columns(state.df.limit(1), op.schema)
    if not ordered:
        return State(state.df.select(*columns).distinct(), op.schema)
    state = state.numbered()
    df = state.df.select(*columns, quoted(ORDER)).groupBy(*[quoted(n) for n, _ in op.columns]).agg(F.min(ORDER).alias(ORDER))
    return State(df, op.schema, [(ORDER, False)])


def count(state: State, op) -> State:
    return State(state.df.agg(F.count(F.lit(1)).alias("count")), op.schema)


def describe(state: State, op) -> State:
    """One count, and a row for each column that planning knows already."""
    if not op.columns:
        df = state.df.agg(F.count(F.lit(1)).alias("row_count")).where(F.lit(False))
        return State(df.select(F.lit("").alias("column"), F.lit("").alias("type"), "row_count", F.lit("").alias("schema"), F.lit(0).cast("long").alias(ORDER)), op.schema, [(ORDER, False)])
    rows = [F.struct(F.lit(i).cast("long").alias("i"), F.lit(n).alias("column"), F.lit(t.kind).alias("type"), F.lit(str(t)).alias("schema")) for i, (n, t) in enumerate(op.columns)]
    df = state.df.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", F.explode(F.array(*rows)).alias("c"))
    df = df.select("c.column", "c.type", "row_count", "c.schema", F.col("c.i").alias(ORDER))
    return State(df, op.schema, [(ORDER, False)])
