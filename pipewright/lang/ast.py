"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    kind: str  # int, float, string, bool, null
    value: object


@dataclass(frozen=True)
class Path:
    parts: tuple[str, ...]

    def __str__(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Unary:
    op: str
    operand: object


@dataclass(frozen=True)
class IsNull:
    operand: object
    negated: bool


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class StructOf:
    fields: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Source:
    path: str
    options: dict = field(default_factory=dict)
    stdin: bool = False


@dataclass(frozen=True)
class Op:
    """An operation: its keyword and what its grammar has."""

    name: str
    args: dict


@dataclass(frozen=True)
class Output:
    format: str = "table"
    split_rows: int | None = None
    overwrite: bool = False
    path: str | None = None


@dataclass(frozen=True)
class Query:
    source: Source
    ops: tuple[Op, ...]
    output: Output
