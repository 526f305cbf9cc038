"""Equi-joins. Which side is broadcast, if any, is left to Spark's size estimates and to adaptive execution."""

from __future__ import annotations

from pyspark.sql import functions as F

from .state import State, quoted

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full"}


def join(state: State, op, needed, ordered: bool) -> State:
    right = op.right.load(op.side(needed, "right"), ordered)

    def renamed(side: State, mark: str, keys) -> tuple:
        names = {n: f"__{mark}{i}" for i, (n, _) in enumerate(side.schema)}
        order = [(f"__{mark}o{i}", down) for i, (_, down) in enumerate(side.order)]
        columns = [quoted(n).alias(x) for n, x in names.items()]
        columns += [quoted(n).alias(x) for (n, _), (x, _) in zip(side.order, order, strict=True)]
        columns += [b.build(side.column).alias(f"__{mark}k{i}") for i, b in enumerate(keys)]
        return side.df.select(*columns), names, order

    left_df, left_names, left_order = renamed(state, "l", [k for k, _ in op.keys])
    right_df, right_names, right_order = renamed(right, "r", [k for _, k in op.keys])
    test = F.lit(True)
    for i in range(len(op.keys)):
        test = test & (F.col(f"__lk{i}") == F.col(f"__rk{i}"))
    df = left_df.join(right_df, test, HOW[op.kind])
    columns, schema = [], []
    for (name, origin, what), (_, t) in zip(op.layout, op.schema, strict=True):
        if needed is not None and name not in needed:
            continue
        if origin == "key":
            c = F.coalesce(F.col(f"__lk{what}"), F.col(f"__rk{what}")) if op.kind in ("right", "full") else F.col(f"__lk{what}")
        else:
            c = F.col((left_names if origin == "left" else right_names)[what])
        columns.append(c.alias(name))
        schema.append((name, t))
    order = left_order + right_order if ordered else []
    # hidden order columns get names that later sorts don't use
    start = [(f"__join{i}", down) for i, (_, down) in enumerate(order)]
    columns += [F.col(n).alias(m) for (n, _), (m, _) in zip(order, start, strict=True)]
    return State(df.select(*columns), schema, start)
