"""The aggregates, each as a Spark aggregate over rows and as a fold over a list of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError
from ..types import FLOAT, INT, ORDERABLE, LType

AGGREGATES = ("count", "sum", "avg", "min", "max", "first", "last")
#: Those whose result may depend on the order of rows.
ORDERED = ("first", "last")


def check(name: str, t: LType | None) -> LType:
    """The result's type for an argument of type ``t`` (None: no argument)."""
    if name == "count":
        return INT
    if name in ("sum", "avg") and t.kind not in ("int", "float", "null"):
        raise PlanError(f"{name}() needs a numeric column, got {t}")
    if name in ("min", "max") and t.kind not in ORDERABLE | {"null"}:
        raise PlanError(f"{name}() needs an orderable column, got {t}")
    return FLOAT.maybe() if name == "avg" else t.maybe()


def needs_order(name: str, t: LType | None) -> bool:
    """min and max over floats ask which value came first, for NaN neither replaces nor is replaced."""
    return name in ORDERED or name in ("min", "max") and t.kind == "float"


def over_rows(name: str, value: Column | None, t: LType | None, order: Column | None) -> Column:
    """As an aggregate of a group; all but first and last combine before the shuffle."""
    if name == "count":
        return F.count(F.lit(1))
    if name == "sum":
        return F.sum(value)
    if name == "avg":
        return F.avg(value.cast("double"))
    if name in ("first", "last"):
        return (F.min_by if name == "first" else F.max_by)(value, order)  # also if it is null
    least = F.min if name == "min" else F.max
    if t.kind != "float":
        return least(value)
    leader = F.min_by(value, F.when(value.isNotNull(), order))
    return F.when(F.isnan(leader), leader).otherwise(least(F.when(~F.isnan(value), value)))


def over_list(name: str, rows: Column, value, t: LType | None) -> Column:
    """As a fold of a list; ``value`` gives the argument's Column for an element."""
    if name == "count":
        return F.size(rows).cast("long")
    if name == "first":
        return value(F.get(rows, F.lit(0)))
    if name == "last":
        return value(F.try_element_at(rows, F.lit(-1)))
    values = F.filter(F.transform(rows, value), lambda x: x.isNotNull())
    if name == "sum":
        zero = F.lit(0).cast("long") if t.kind == "int" else F.lit(0.0)
        return F.when(F.size(values) > 0, F.aggregate(values, zero, lambda a, x: a + x))
    if name == "avg":
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
        return F.when(F.size(values) > 0, total / F.size(values))
    least = F.array_min if name == "min" else F.array_max
    if t.kind != "float":
        return least(values)
    leader = F.get(values, F.lit(0))
    return F.when(F.isnan(leader), leader).otherwise(least(F.filter(values, lambda x: ~F.isnan(x))))
