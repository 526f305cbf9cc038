"""A DataFrame on its way through a plan, with the row order if someone asks for it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Schema

ORDER = "__ord"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class State:
    """``order``: hidden columns that give the order, and whether each goes down; none if it isn't known. Nulls come last."""

    df: DataFrame
    schema: Schema
    order: list[tuple[str, bool]] = field(default_factory=list)

    def column(self, name: str) -> Column:
        return quoted(name)

    def hidden(self) -> list[Column]:
        return [quoted(n) for n, _ in self.order]

    def keys(self, backwards: bool = False) -> list[Column]:
        return [
            (quoted(n).desc_nulls_first() if not down else quoted(n).asc_nulls_first())
            if backwards
            else (quoted(n).desc_nulls_last() if down else quoted(n).asc_nulls_last())
            for n, down in self.order
        ]

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.keys()) if self.order else self.df

    def numbered(self) -> State:
        """The same rows with one ascending number as their order: a range-partitioned sort, then ids that rise with the
        partitions. Nothing to do after a scan."""
        if not self.order or self.order == [(ORDER, False)]:
            return self
        df = self.sorted().select(*[quoted(n) for n, _ in self.schema], F.monotonically_increasing_id().alias(ORDER))
        return State(df, self.schema, [(ORDER, False)])

    def with_columns(self, df: DataFrame, schema: Schema) -> State:
        return State(df, schema, self.order)
