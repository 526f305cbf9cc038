"""How each bound operation becomes DataFrame operations."""

from __future__ import annotations

from .state import State


def lower(state: State, op, needed, ordered: bool) -> State:
    """``needed``: the columns of the result that someone reads (None: all); ``ordered``: whether its order matters."""
    from ..plans import operations as o
    from . import grouping, joining, rows

    if isinstance(op, o.Tail):
        return rows.tail(state, op)
    if isinstance(op, o.Head):
        return rows.head(state, op)
    if isinstance(op, o.Filter):
        return rows.filter_rows(state, op)
    if isinstance(op, o.Project):
        return rows.project(state, op, needed)
    if isinstance(op, o.Sort):
        return rows.sort(state, op) if ordered else state
    if isinstance(op, o.Distinct):
        return rows.distinct(state, op, ordered)
    if isinstance(op, o.Group):
        return grouping.group(state, op, needed, ordered)
    if isinstance(op, o.GroupReduce):
        return grouping.group_reduce(state, op, needed, ordered)
    if isinstance(op, o.Reduce):
        return grouping.reduce(state, op, needed)
    if isinstance(op, o.Join):
        return joining.join(state, op, needed, ordered)
    if isinstance(op, o.Count):
        return rows.count(state, op)
    return rows.describe(state, op)
