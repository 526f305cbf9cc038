"""Sources. ``prepare`` finds a source's files and schema; nothing but a sample or metadata is read before a plan runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LoadError, ParseError
from ..lang import ast
from ..operators.state import ORDER, State, quoted
from ..types import Schema, TypeConflict, from_spark
from . import options as opts
from .files import expand


class Prepared:
    """What every source has: a schema, and ``load`` of the needed columns (None: all), with the row order if asked."""

    schema: Schema

    def load(self, needed: set[str] | None, ordered: bool) -> State:
        raise NotImplementedError

    def first(self, n: int) -> Prepared:
        """A source that has the first ``n`` rows, and as few others as can be told without reading."""
        return self


class FrameSource(Prepared):
    """A DataFrame at hand. Its row order is that of its partitions."""

    def __init__(self, df: DataFrame):
        from .parquet import conform

        self.df, self.conform = df, conform
        try:
            self.schema = [(f.name, from_spark(f.dataType, f.nullable)) for f in df.schema.fields]
        except TypeConflict as e:
            raise LoadError(str(e)) from None
        names = [n for n, _ in self.schema]
        if twice := next((n for n in names if names.count(n) > 1), None):
            raise LoadError(f"column {twice!r} is there twice")

    def load(self, needed: set[str] | None, ordered: bool) -> State:
        kept = [(n, t) for n, t in self.schema if needed is None or n in needed]
        have = {f.name: f.dataType for f in self.df.schema.fields}
        columns = [self.conform(quoted(n), have[n], t).alias(n) for n, t in kept]
        order = [(ORDER, False)] if ordered else []
        return State(self.df.select(*columns, *([F.monotonically_increasing_id().alias(ORDER)] if ordered else [])), kept, order)


def prepare(spark: SparkSession, source: ast.Source, stdin=None, base: str | None = None) -> Prepared:
    from . import avro, csv, json, parquet

    if source.stdin:
        if stdin is None:
            raise LoadError("standard input is not available here")
        if isinstance(stdin, DataFrame):
            return FrameSource(stdin)
        if "format" not in source.options:
            raise ParseError("standard input needs 'with format=csv|json|jsonl'")
        chosen = opts.resolve("-", source.options)
        if chosen.format in ("avro", "parquet"):
            raise ParseError("standard input must be csv, json or jsonl")
        paths = [opts.spooled(spark, stdin, chosen)]
    else:
        paths = expand(spark, source.path, base)
        each = {opts.key(opts.resolve(p, source.options)) for p in paths}
        if len(each) > 1:
            raise LoadError(f"the files of {source.path} differ in format or compression")
        chosen = opts.resolve(paths[0], source.options)
        paths = opts.readable(spark, paths, chosen)
    kind = {"csv": csv.CsvSource, "json": json.JsonSource, "jsonl": json.JsonSource, "avro": avro.AvroSource, "parquet": parquet.ParquetSource}
    return kind[chosen.format](spark, paths, chosen)
