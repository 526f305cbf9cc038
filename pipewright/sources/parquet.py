"""Parquet: typed by the file's schema, pruned and filtered by Spark's own reader."""

from __future__ import annotations

from copy import copy

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoadError
from ..functions.values import null_of
from ..operators.state import ORDER, State, quoted
from ..types import LType, TypeConflict, from_spark, spark_type, unify
from . import Prepared
from .files import hadoop, is_directory


def conform(c: Column, have: T.DataType, want: LType) -> Column:
    """Widen numbers, and store records with sorted fields."""
    if want.kind == "list" and isinstance(have, T.ArrayType):
        plain = spark_type(want) == T.ArrayType(have.elementType)
        return c if plain else F.transform(c, lambda x: conform(x, have.elementType, want.elem))
    if want.kind == "record" and isinstance(have, T.StructType):
        types = {f.name: f.dataType for f in have.fields}
        fields = [(conform(c.getField(n), types[n], t) if n in types else null_of(t)).alias(n) for n, t in sorted(want.fields, key=lambda x: x[0])]
        return F.when(c.isNotNull(), F.struct(*fields))
    if want.kind == "string" and isinstance(have, (T.ArrayType, T.StructType)):
        return F.to_json(c)
    target = spark_type(want)
    return c if have == target else c.cast(target)


def footer(spark: SparkSession, path: str):
    p, _ = hadoop(spark, path)
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(p, spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return reader.getFooter()
    finally:
        reader.close()


def row_count(spark: SparkSession, path: str) -> int:
    return sum(b.getRowCount() for b in footer(spark, path).getBlocks())


def data_files(spark: SparkSession, folder: str) -> list[str] | None:
    """A data directory's files in order of their names; None if it has directories in it."""
    p, system = hadoop(spark, folder)
    found = [x for x in system.listStatus(p) if not x.getPath().getName().startswith(("_", "."))]
    return None if any(x.isDirectory() for x in found) else sorted(str(x.getPath()) for x in found)


def required(spark: SparkSession, path: str) -> set[str]:
    """Top-level columns that the file declares as never null; Spark's reader forgets that."""
    try:
        if is_directory(spark, path):
            return set()
        return {f.getName() for f in footer(spark, path).getFileMetaData().getSchema().getFields() if f.getRepetition().name() == "REQUIRED"}
    except Exception:  # metadata only refines nullability
        return set()


class ParquetSource(Prepared):
    #: Rows that are asked for, if only the first ones are.
    bound: int | None = None

    def __init__(self, spark: SparkSession, paths: list[str], options):
        self.spark, self.paths = spark, paths
        self.frames = []
        schemas = []
        for path in paths:
            frame = spark.read.option("recursiveFileLookup", "false").parquet(path)
            try:
                own = [(f.name, from_spark(f.dataType)) for f in frame.schema.fields]
            except TypeConflict as e:
                raise LoadError(f"{path}: {e}") from None
            never = required(spark, path)
            own = [(n, t.plain() if n in never else t) for n, t in own]
            self.frames.append(frame)
            schemas.append(own)
        self.schema = merged(schemas)
        names = [n for n, _ in self.schema]
        if twice := next((n for n in names if names.count(n) > 1), None):
            raise LoadError(f"column {twice!r} is there twice")

    def first(self, n: int) -> ParquetSource:
        """A source of the first files that hold ``n`` rows, by their footers, and of those rows only where one file is enough."""
        out = copy(self)
        out.bound = n
        if len(self.paths) == 1 and is_directory(self.spark, self.paths[0]):
            files = data_files(self.spark, self.paths[0])
        else:
            files = self.paths
        if not files or len(files) == 1 and files == self.paths:
            return out
        taken, rows = 0, 0
        while taken < len(files) and rows < n:
            rows += 0 if is_directory(self.spark, files[taken]) else row_count(self.spark, files[taken])
            taken += 1
        out.paths = files[: max(1, taken)]
        same = self.frames[0].schema
        out.frames = self.frames[: len(out.paths)] if files is self.paths else [self.spark.read.schema(same).parquet(p) for p in out.paths]
        return out

    def load(self, needed, ordered) -> State:
        kept = [(n, t) for n, t in self.schema if needed is None or n in needed]
        alike = all(f.schema == self.frames[0].schema for f in self.frames)
        # alike files are one scan; the schema at hand saves looking into them again
        frames = self.frames if len(self.paths) == 1 or not alike else [self.spark.read.schema(self.frames[0].schema).parquet(*self.paths)]
        single = len(self.paths) == 1 and not is_directory(self.spark, self.paths[0])
        out = None
        for number, frame in enumerate(frames):
            have = {f.name: f.dataType for f in frame.schema.fields}
            columns = [(conform(quoted(n), have[n], t) if n in have else null_of(t)).alias(n) for n, t in kept]
            if ordered and single:
                columns.append(F.col("_metadata.row_index").alias(ORDER))
                frame = frame if self.bound is None else frame.where(F.col("_metadata.row_index") < self.bound)
            elif ordered:
                columns += [F.lit(number).alias("__file"), F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row")]
            one = frame.select(*columns)
            out = one if out is None else out.unionByName(one)
        order = [] if not ordered else [(ORDER, False)] if single else [("__file", False), ("__path", False), ("__row", False)]
        return State(out, kept, order)


def merged(schemas: list) -> list:
    """Columns of several files: in the first file's order, then others by name; kinds that don't fit become strings; columns
    that a file lacks may be null."""
    first = [n for n, _ in schemas[0]]
    extra = sorted({n for s in schemas for n, _ in s} - set(first))
    out = []
    for name in first + extra:
        t, missing = None, False
        for s in schemas:
            own = dict(s).get(name)
            missing = missing or own is None
            if own is not None:
                t = own if t is None else unify(t, own, permissive=True)
        out.append((name, t.maybe(missing)))
    return out
