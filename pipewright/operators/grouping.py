"""group, reduce, and both at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import aggregates
from ..functions.values import null_of
from ..plans.expressions import path_column
from ..types import Schema, finalised, spark_type
from .state import ORDER, State, quoted


def as_record(schema: Schema) -> Column:
    own = sorted(n for n, _ in schema)
    return F.struct(*[quoted(n).alias(n) for n in own]) if own else F.struct(F.lit(None).cast("string").alias("__empty"))


def nested_rows(schema: Schema) -> Column:
    """The group's rows in order; the order number is sorted by, then dropped."""
    pairs = F.array_sort(F.collect_list(F.struct(quoted(ORDER).alias("o"), as_record(schema).alias("r"))), lambda a, b: F.when(a.o < b.o, -1).when(a.o > b.o, 1).otherwise(0))
    return F.transform(pairs, lambda p: p.r)


def keyed(state: State, keys, extra: list[Column]) -> tuple[State, list[str]]:
    """Key columns under names of their own, beside the input's."""
    names = [f"__group{i}" for i in range(len(keys))]
    columns = [b.build(state.column).alias(n) for n, (_, b) in zip(names, keys, strict=True)]
    return State(state.df.select(*[quoted(n) for n, _ in state.schema], *state.hidden(), *columns, *extra), state.schema, state.order), names


def finish(df, names: list[str], keys, order: bool) -> list[Column]:
    return [quoted(n).alias(name) for n, (name, _) in zip(names, keys, strict=True)] + ([quoted(ORDER)] if order else [])


def group(state: State, op, needed, ordered: bool) -> State:
    nested = needed is None or op.nested in needed
    state = state.numbered()
    state, names = keyed(state, op.keys, [])
    aggs = [F.min(ORDER).alias(ORDER)] if state.order else []
    if nested:
        aggs.append(nested_rows(op.rows).alias("__rows"))
    if not aggs:
        aggs = [F.count(F.lit(1)).alias("__n")]
    df = state.df.groupBy(*names).agg(*aggs)
    columns = finish(df, names, op.keys, bool(state.order)) + ([quoted("__rows").alias(op.nested)] if nested else [])
    schema = op.schema if nested else op.schema[:-1]
    return State(df.select(*columns), schema, state.order)


def group_reduce(state: State, op, needed, ordered: bool) -> State:
    targets, calls, nested = op.live(needed)
    keys = op.group.keys
    state = state.numbered()
    state, names = keyed(state, keys, [])
    order = quoted(ORDER) if state.order else None
    aggs = [F.min(ORDER).alias(ORDER)] if state.order else []
    for c in calls:
        value = path_column(quoted(c.path[0]), c.path[1:]) if c.path else None
        aggs.append(aggregates.over_rows(c.name, value, c.type, order).alias(c.slot))
    if nested:
        aggs.append(nested_rows(op.group.rows).alias("__rows"))
    df = state.df.groupBy(*names).agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
    new = dict(targets)
    columns, schema = [], []
    for i, (n, t) in enumerate(op.schema):
        if n in new:
            b = new[n]
            columns.append((null_of(finalised(b.type)) if b.type.kind == "null" else b.build(quoted)).alias(n))
        elif i < len(keys):
            if needed is not None and n not in needed:
                continue
            columns.append(quoted(names[i]).alias(n))
        elif n == op.group.nested and nested:
            columns.append(quoted("__rows").alias(n))
        else:
            continue
        schema.append((n, t))
    return State(df.select(*columns, *([quoted(ORDER)] if state.order else [])), schema, state.order)


def reduce(state: State, op, needed) -> State:
    """Folds over a list column; a null list fails."""
    have = dict(state.schema)
    targets = [(n, b) for n, b in op.assignments if needed is None or n in needed]
    slots = set().union(*[b.reads for _, b in targets])
    rows = None
    if slots:
        bad = F.raise_error(F.lit(f"reduce: column {op.nested} is null")).cast(spark_type(have[op.nested]))
        rows = F.coalesce(quoted(op.nested), bad)
    folds = []
    for c in op.reduction.calls:
        if c.slot in slots:
            value = (lambda path: lambda x: path_column(x, path))(c.path) if c.path else None
            folds.append(aggregates.over_list(c.name, rows, value, c.type).alias(c.slot))
    df = state.df.select("*", *folds)
    new = dict(targets)
    columns, schema = [], []
    for n, t in op.schema:
        if n in new:
            b = new[n]
            columns.append((null_of(finalised(b.type)) if b.type.kind == "null" else b.build(quoted)).alias(n))
        elif n in have:
            columns.append(quoted(n))
        else:
            continue
        schema.append((n, t))
    return State(df.select(*columns, *state.hidden()), schema, state.order)
