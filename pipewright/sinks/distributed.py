"""Output files that executors write: staged beside the target, then put in place by the driver, all or none."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain, groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import WriteError
from ..lang.ast import Output
from ..operators.state import State, quoted
from ..sources.files import hadoop, remote
from ..sources.options import has_shared_folder, shared_folder
from ..types import LType, Schema
from .files import existing_parts, parts_pattern, put_in_place, target
from .writers import WRITERS, avro_schema, check_binary, join_parts, parquet_body, write_part

MADE = "part long, path string"


def reachable(spark: SparkSession, path: str, base: str | None = None) -> bool:
    """Whether executors write where the path points: in a store with a URI, where all run on one machine, or in the folder
    that they share with the driver."""
    if remote(path) or spark.sparkContext.master.startswith("local"):
        return True
    shared = shared_folder(spark) if has_shared_folder(spark) else None
    if not shared or remote(shared):
        return False
    full, shared = os.path.realpath(os.path.join(base or os.getcwd(), path)), os.path.realpath(shared)
    return os.path.commonpath([full, shared]) == shared


def opened(path: str):
    if remote(path):
        system, name = fs.FileSystem.from_uri(path)
        return system.open_output_stream(name)
    return open(path, "wb")


def tuples(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(width)], strict=True) if width else [()] * batch.num_rows


def runs(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of rows that are alike in column ``at``, cut from batches."""
    for batch in batches:
        column = batch.column(at).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            if a < b:
                yield int(column[a]), batch.slice(a, b - a)


def read_back(path: str):
    if remote(path):
        system, name = fs.FileSystem.from_uri(path)
        return system.open_input_file(name)
    return open(path, "rb")


def one_file(state: State, schema: Schema, form: str, stage: str) -> DataFrame:
    """Each task of the sorted table writes its rows as a part; then one task puts the parts' bytes together (of Parquet, the
    row groups), so that only it sees the whole file, and no rows."""
    spark, sync = state.df.sparkSession, os.urandom(16)
    df = state.sorted().select(*[quoted(n).alias(f"c{i}") for i, (n, _) in enumerate(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        path = f"{stage}/{uuid.uuid4().hex}"
        with opened(path) as out:
            write_part(chain([first], batches), lambda some: tuples(some, len(schema)), form, schema, out, sync)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [path]})

    parts = [r["path"] for r in sorted(df.mapInArrow(run, MADE).collect())]  # a row for each task

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator:
            for part in parts:
                with read_back(part) as file:
                    yield file

        for _ in batches:
            path = f"{stage}/{uuid.uuid4().hex}"
            with opened(path) as out:
                join_parts(each(), form, schema, out, sync)
            yield pa.RecordBatch.from_pydict({"part": pa.array([1], pa.int64()), "path": [path]})

    return spark.range(0, min(1, len(parts)), 1, 1).mapInArrow(join, MADE)


def many_files(state: State, schema: Schema, form: str, stage: str, rows: int) -> DataFrame:
    """Files of ``rows`` rows each. The sorted table is written once; the sizes of its partitions number its rows, so each
    row's file is known and files are written side by side."""
    spark, width = state.df.sparkSession, len(schema)
    columns = [quoted(n).alias(f"c{i}") for i, (n, _) in enumerate(schema)]
    sorted_rows = state.sorted().select(*columns, F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"))
    place = f"{stage if remote(stage) else f'file://{os.path.abspath(stage)}'}/rows"  # Spark's default may be another file system
    sorted_rows.write.parquet(place)
    table = spark.read.schema(sorted_rows.schema).parquet(place)
    sizes = sorted((r["__p"], r["count"]) for r in table.groupBy("__p").count().collect())  # a row for each partition
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    known = spark.createDataFrame(offsets, "__p int, __before long")
    part = F.expr(f"(__i - shiftleft(cast(__p as long), 33) + __before) div {rows} + 1").alias("__part")
    table = table.join(F.broadcast(known), "__p").select(*[f"c{i}" for i in range(width)], part, "__i")
    table = table.repartition("__part").sortWithinPartitions("__part", "__i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in groupby(runs(batches, width), key=itemgetter(0)):
            path = f"{stage}/{uuid.uuid4().hex}"
            with opened(path) as out:
                if form == "parquet":
                    parquet_body((b for _, b in own), schema, out)
                else:
                    WRITERS[form](tuples((b for _, b in own), width), schema, out)
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int64()), "path": [path]})

    return table.mapInArrow(run, MADE)


def store_parts(spark: SparkSession, path: str) -> list[str]:
    """Files of an earlier run in a store."""
    p, system = hadoop(spark, path.replace("{n}", "*"))
    fits = parts_pattern(path.rpartition("://")[2].lstrip("/"))  # a store may spell the rest of a URI in another way
    return [f for f in (str(x.getPath()) for x in system.globStatus(p) or []) if (m := fits.search(f)) and len(set(m.groups())) <= 1]


def put_in_store(spark: SparkSession, staged: list[tuple[str, str]], old: list[str], stage: str) -> None:
    """Rename; on failure what was there is put back."""
    moved: list[tuple[str, str]] = []

    def move(a: str, b: str) -> None:
        (source, system), (goal, _) = hadoop(spark, a), hadoop(spark, b)
        system.mkdirs(goal.getParent())
        if not system.rename(source, goal):
            raise WriteError(f"cannot write {b}")
        moved.append((a, b))

    try:
        for i, f in enumerate(old):
            move(f, f"{stage}/old-{i}")
        for a, b in staged:
            move(a, b)
    except Exception:
        for a, b in reversed(moved):
            (source, system), (goal, _) = hadoop(spark, b), hadoop(spark, a)
            system.rename(source, goal)
        raise


def write_distributed(state: State, schema: Schema, output: Output, base: str | None = None) -> list[str]:
    """Write the rows in their order; the driver handles names only."""
    spark, path = state.df.sparkSession, target(output)
    store = remote(path)
    if not store:
        path = path if os.path.isabs(path) else os.path.join(base or os.getcwd(), path)
    if output.format in ("avro", "parquet"):
        check_binary(schema, output.format)
    if output.format == "avro":
        avro_schema(LType("record", fields=tuple(schema)), "row")  # names that Avro doesn't take
    folder = os.path.dirname(path.split("{n}")[0]) if output.split_rows else os.path.dirname(path)
    if store:
        p, system = hadoop(spark, path)
        old = store_parts(spark, path) if output.split_rows else [path] if system.exists(p) else []
    else:
        os.makedirs(folder, exist_ok=True)
        old = existing_parts(path) if output.split_rows else [path] if os.path.lexists(path) else []
        if bad := next((f for f in old if os.path.isdir(f)), None):
            raise WriteError(f"{bad} is a directory")
    if old and not output.overwrite:
        raise WriteError(f"{old[0]} exists; use 'with overwrite=true'")
    stage = f"{folder}/.staged-{uuid.uuid4().hex}"
    place, system = hadoop(spark, stage if store else f"file://{os.path.abspath(stage)}")
    system.mkdirs(place)
    try:
        files = many_files(state, schema, output.format, stage, output.split_rows) if output.split_rows else one_file(state, schema, output.format, stage)
        made = sorted((r["part"], r["path"]) for r in files.collect())  # a row for each file
        if not made:
            made = [(1, f"{stage}/empty")]
            with opened(made[0][1]) as out:
                WRITERS[output.format]([], schema, out)
        staged = [(f, path.replace("{n}", str(n)) if output.split_rows else path) for n, f in made]
        if store:
            put_in_store(spark, staged, old, stage)
        else:
            put_in_place(staged, old, stage, output.overwrite)
    except PythonException as e:
        if m := re.search(r"WriteError: (.*)", str(e)):
            raise WriteError(m[1]) from None
        raise
    finally:
        system.delete(place, True)
    return [final for _, final in staged]
