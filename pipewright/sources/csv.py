"""CSV. Cells are read as text by Spark's reader and converted by typed projections, so a bad cell is a bad row."""

from __future__ import annotations

import csv as pycsv
import io
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoadError
from ..operators.state import State, quoted
from ..types import LType, Schema
from . import Prepared
from .files import and_above, beginning, beginnings, decoded, location, named, origin, scan
from .records import read_cut, surveyed

BROKEN = "__broken"
LONGEST = 1 << 25  # bytes of a file that the driver looks at for its first row
INT = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
BOOL = r"^(?i:true|false)$"


def cell(c: Column) -> Column:
    """Trimmed text; empty and null in any case are null, quoted or not."""
    plain = F.trim(c, F.lit(" \t\n\x0b\f\r"))
    last = c.endswith("\x85") | c.endswith("\u2028") | c.endswith("\u2029")  # which the pattern takes for line ends
    t = F.when(last, F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(plain)
    return F.when((t != "") & ((F.octet_length(t) != 4) | (F.lower(t) != "null")), t)


def converted(t: Column, kind: str) -> Column:
    """The value, or null for text of another kind."""
    if kind == "int":
        return F.when(t.rlike(INT), t.try_cast("long"))
    if kind == "float":
        low = F.lower(F.ltrim(F.lit("+"), t))
        word = F.when(low.rlike("^inf"), F.lit(float("inf"))).when(low.rlike("^-inf"), F.lit(float("-inf"))).when(low.rlike("nan$"), F.lit(float("nan")))
        return F.when(t.rlike(FLOAT), F.coalesce(t.try_cast("double"), word))
    if kind == "bool":
        return F.when(t.rlike(BOOL), F.lower(t) == "true")
    return t


def widths(delim: str):
    """How many cells a line has, for lines that the reader found uneven; an Arrow-batched function."""
    @F.pandas_udf(T.IntegerType())
    def count(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: None if x is None else len(next(pycsv.reader([x], delimiter=delim, skipinitialspace=True), [])))

    return count


@dataclass
class Shard:
    """One file: its columns in their order, whether its first line is a header, and whether it is ``split`` between tasks at
    any line end (None: not known yet), or ``cut`` at those outside quotes."""

    path: str
    columns: list[str]
    header: bool
    split: bool | None = None
    cut: bool = False


class CsvSource(Prepared):
    def __init__(self, spark: SparkSession, paths: list[str], options):
        self.spark, self.options = spark, options
        self.shards, names = self.classify(paths)
        self.complete = True
        if options.infer_rows == 0:
            self.schema: Schema = [(n, LType("string", True)) for n in names]
        else:
            self.schema = self.inferred(names)

    def lines(self, path: str, n: int) -> list[list[str]]:
        """The first records of a file, parsed on the driver."""
        rows = self.spark.read.text(path).limit(n + 1).collect()
        text = "\n".join(r[0] for r in rows).removeprefix("﻿")
        return [r for r in pycsv.reader(io.StringIO(text), delimiter=self.options.delim, skipinitialspace=True) if r]

    def first_record(self, path: str, data: bytes, ended: bool) -> list[str]:
        """The cells of the first line that isn't empty, of a file that begins so."""
        while True:
            text = data.decode("utf-8", "replace").removeprefix("\ufeff")
            found = [r for r in pycsv.reader(io.StringIO(text, newline=""), delimiter=self.options.delim, skipinitialspace=True) if r][:2]
            if ended or len(found) > 1:
                return found[0] if found else []
            if len(data) >= LONGEST:
                raise LoadError(f"{path}: the first row does not end within {LONGEST} bytes")
            data, ended = beginning(self.spark, path, 8 * len(data))

    def classify(self, paths: list[str]) -> tuple[list[Shard], list[str]]:
        """The first file's header anchors. A later file whose first line repeats it, in any order or with more columns
        whose names look like names, has a header; else its rows go by position."""
        shards: list[Shard] = []
        names: list[str] = []
        extra: set[str] = set()
        for path, (data, ended) in zip(paths, beginnings(self.spark, paths), strict=True):
            line = [x.strip() for x in self.first_record(path, data, ended)]
            if not shards:
                names = line if self.options.header else [f"col{i + 1}" for i in range(len(line))]
                if twice := next((n for n in names if names.count(n) > 1), None):
                    raise LoadError(f"{path}: column {twice!r} is there twice")
                shards.append(Shard(path, names, self.options.header))
            elif not line:
                continue
            elif self.options.header and self.is_header(line, names):
                if twice := next((n for n in line if line.count(n) > 1), None):
                    raise LoadError(f"{path}: column {twice!r} is there twice")
                extra |= set(line) - set(names)
                shards.append(Shard(path, line, True))
            else:
                shards.append(Shard(path, names, False))
        return shards, names + sorted(extra)

    @staticmethod
    def is_header(line: list[str], names: list[str]) -> bool:
        """The same names in any order; or no numbers, a known name, and otherwise only lower-case identifiers."""
        if sorted(line) == sorted(names):
            return True
        fresh = [x for x in line if x not in names]
        numbers = any(kind_of(x) in ("int", "float") for x in line)
        named = all(x.isidentifier() and (x[0] == "_" or x[0].islower()) for x in fresh)
        return not numbers and named and len(fresh) < len(line)

    def groups(self) -> list[list[Shard]]:
        """Files that one scan can read: of the same columns, with or without a header, split or not."""
        if unknown := [s for s in self.shards if s.split is None]:
            # a line with an odd number of quotes: cells of that file hold line ends, so no task may begin inside it
            quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
            lines = scan(self.spark, lambda: self.spark.read.text([s.path for s in unknown]), location().alias("file"), (quotes % 2 == 1).alias("odd"))
            odd = {x for r in lines.where("odd").select("file").distinct().collect() for x in and_above(decoded(r[0]))}
            for s in unknown:
                s.split = not odd or named(self.spark, s.path) not in odd
            self.survey([s for s in unknown if not s.split])
        out: dict[tuple, list[Shard]] = {}
        for s in self.shards:
            out.setdefault((tuple(s.columns), s.header, s.split, s.cut), []).append(s)
        return list(out.values())

    def survey(self, shards: list[Shard]) -> None:
        """How files whose cells hold line ends can be cut between tasks, those that can."""
        delim = self.options.delim
        if not shards or not delim.isascii() or not delim.isprintable() and delim != "\t" or delim in '" ':
            return
        self.cut = surveyed(self.spark, [s.path for s in shards], delim)
        irregular = {x for f in self.cut.irregular for x in and_above(f)}
        for s in shards:
            s.cut = named(self.spark, s.path) not in irregular

    def read(self, shards: list[Shard], ordered: bool) -> DataFrame:
        """All cells as text, and the file and row they are from. A line of another width than the header's fails, unless an option allows it."""
        o, shard = self.options, shards[0]
        if shard.cut:
            return self.checked(self.read_cut(shards, ordered), shard)
        fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(shard.columns))]
        schema = T.StructType([*fields, T.StructField(BROKEN, T.StringType())])
        reader = self.spark.read.schema(schema).options(
            header=str(shard.header).lower(), sep=o.delim, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN,
            ignoreLeadingWhiteSpace="true", enforceSchema="true", columnPruning="false", multiLine=str(not shard.split).lower(),
        )
        df = scan(self.spark, lambda: reader.csv([s.path for s in shards]), "*", origin().alias("__file"), F.monotonically_increasing_id().alias("__row"))
        return self.checked(df, shard)

    def read_cut(self, shards: list[Shard], ordered: bool) -> DataFrame:
        own = {named(self.spark, s.path) for s in shards}
        files = {f for f, _ in self.cut.states if own & set(and_above(f))}
        width = len(shards[0].columns)
        return read_cut(self.cut, files, width, shards[0].header, self.options.delim, [*(f"c{i}" for i in range(width)), BROKEN, "__file", "__row"], ordered)

    def checked(self, df: DataFrame, shard: Shard) -> DataFrame:
        o = self.options
        if o.allow_jagged_rows and o.ignore_unknown_values:
            return df
        broken = F.col(BROKEN)
        if o.allow_jagged_rows or o.ignore_unknown_values:
            have, want = widths(o.delim)(broken), len(shard.columns)
            bad = have > want if o.allow_jagged_rows else have < want
        else:
            bad = broken.isNotNull()
        message = F.concat("__file", F.lit(f": a row does not have {len(shard.columns)} cells: "), F.substring(broken, 1, 200), F.substring(F.coalesce("c0", F.lit("")), 1, 0))
        # the check is part of a filter, so no projection can prune it; it names a cell, as Spark's reader demands
        return df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))

    def cells(self, shards: list[Shard], ordered: bool) -> DataFrame:
        df = self.read(shards, ordered)
        at = {n: i for i, n in enumerate(shards[0].columns)}
        names = [n for n, _ in self.schema] if hasattr(self, "schema") else list(at)
        columns = [cell(F.col(f"c{at[n]}")).alias(n) if n in at else F.lit(None).cast("string").alias(n) for n in names]
        return df.select(*columns, *([F.col("__file"), F.col("__row")] if ordered else []))

    def inferred(self, names: list[str]) -> Schema:
        """The narrowest kinds of a sample; of all rows if infer_rows is -1, by one aggregation."""
        limit = self.options.infer_rows
        if limit > 0:
            seen: dict[str, set[str]] = {n: set() for n in names}
            taken, reached_end = 0, True
            for shard in self.shards:
                rows = self.lines(shard.path, limit - taken + 1 + shard.header)[int(shard.header) :]
                if len(rows) > limit - taken:
                    reached_end = False
                    rows = rows[: limit - taken]
                taken += len(rows)
                for n in names:
                    if n not in shard.columns:
                        seen[n].add("null")
                for row in rows:
                    for n, text in zip(shard.columns, row, strict=False):
                        seen[n].add(kind_of(text))
                    for n in shard.columns[len(row) :]:
                        seen[n].add("null")
                if taken >= limit:
                    reached_end = reached_end and shard is self.shards[-1]
                    break
            return [(n, settled(seen[n]).maybe(not reached_end)) for n in names]
        found: dict[str, set[str]] = {n: set() for n in names}
        for shards in self.groups():
            df, shard = self.cells(shards, False), shards[0]
            for n in set(names) - set(shard.columns):
                found[n].add("null")
            aggs = []
            for j, n in enumerate(shard.columns):
                c = quoted(n)
                kind = F.when(c.isNull(), "null").when(c.rlike(BOOL), "bool").when(converted(c, "int").isNotNull(), "int").when(c.rlike(FLOAT), "float").otherwise("string")
                aggs.append(F.collect_set(kind).alias(f"k{j}"))
            row = df.agg(*aggs).first()
            for j, n in enumerate(shard.columns):
                found[n] |= set(row[j])
        return [(n, settled(found[n])) for n in names]

    def load(self, needed, ordered) -> State:
        kept = [(n, t) for n, t in self.schema if needed is None or n in needed]
        df = None
        for shards in self.groups():
            one = self.cells(shards, ordered)
            df = one if df is None else df.unionByName(one)
        values = {n: converted(quoted(n), t.kind) for n, t in kept}
        hidden = [F.col("__file"), F.col("__row")] if ordered else []
        bad = F.lit(False)
        for n, t in kept:
            if t.kind != "string":
                bad = bad | (quoted(n).isNotNull() & values[n].isNull())
        columns = []
        if self.options.max_bad_records:
            count = df.where(bad).limit(self.options.max_bad_records + 1).count()
            if count > self.options.max_bad_records:
                raise LoadError(f"more than {self.options.max_bad_records} bad records")
            df = df.where(~bad)
        for n, t in kept:
            value = values[n]
            if t.kind != "string" and not self.options.max_bad_records:
                wrong = F.raise_error(F.concat(F.lit(f"column {n}: "), quoted(n), F.lit(f" is not {t.kind}"))).cast(value_type(t))
                value = F.when(quoted(n).isNotNull(), F.coalesce(value, wrong))
            columns.append(value.alias(n))
        order = [("__file", False), ("__row", False)] if ordered else []
        return State(df.select(*columns, *hidden), kept, order)


def value_type(t: LType) -> str:
    return {"int": "long", "float": "double", "bool": "boolean"}[t.kind]


def kind_of(text: str) -> str:
    import re

    text = text.strip()
    if text == "" or text.lower() == "null":
        return "null"
    if re.match(BOOL, text):
        return "bool"
    if re.match(INT, text) and -(2**63) <= int(text) < 2**63:
        return "int"
    return "float" if re.match(FLOAT, text) else "string"


def settled(kinds: set[str]) -> LType:
    nullable = "null" in kinds
    kinds = kinds - {"null"}
    if not kinds:
        return LType("string", True)
    if kinds == {"int", "float"}:
        return LType("float", nullable)
    return LType(kinds.pop() if len(kinds) == 1 else "string", nullable)
