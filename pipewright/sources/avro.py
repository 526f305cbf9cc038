"""Avro object container files, decoded in Arrow batches on the executors; one task a file."""

from __future__ import annotations

import bz2
import json
import lzma
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoadError
from ..functions.values import coerce, null_of
from ..operators.state import State
from ..types import LType, list_of, record, spark_type, union_of
from . import Prepared
from .files import beginning, beginnings, scan
from .parquet import merged

MAGIC = b"Obj\x01"
PRIMITIVES = {"null": "null", "boolean": "bool", "int": "int", "long": "int", "float": "float", "double": "float", "string": "string", "bytes": "string"}


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise LoadError("the Avro file ends too soon")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def bytes(self) -> bytes:
        return self.take(self.long())

    def blocks(self, one) -> list:
        out = []
        while n := self.long():
            if n < 0:
                n = -n
                self.long()
            out += [one() for _ in range(n)]
        return out


def header(data: bytes) -> tuple[dict, Cursor]:
    """File metadata, and a cursor behind it."""
    cursor = Cursor(data)
    if cursor.take(4) != MAGIC:
        raise LoadError("not an Avro file")
    return dict(cursor.blocks(lambda: (cursor.bytes().decode(), cursor.bytes()))), cursor


class Reader:
    """Decodes values of one schema; names are resolved as they are met."""

    def __init__(self, schema):
        self.named: dict[str, object] = {}
        self.schema = schema
        self.type = self.logical(schema, ())

    def full(self, name: str, space: str | None) -> str:
        return name if "." in name or not space else f"{space}.{name}"

    def logical(self, s, path: tuple[str, ...], space: str | None = None) -> LType:
        if isinstance(s, list):
            return union_of([self.logical(x, path, space) for x in s])
        if isinstance(s, str):
            if s in PRIMITIVES:
                return LType(PRIMITIVES[s], s == "null")
            name = self.full(s, space)
            if name in path:
                raise LoadError(f"recursive Avro type {name} is not supported")
            if name not in self.named:
                raise LoadError(f"unknown Avro type {name}")
            return self.logical(self.named[name], path, space)
        kind = s["type"]
        if kind in ("record", "error"):
            name = self.full(s.get("name", ""), s.get("namespace", space))
            if name in path:
                raise LoadError(f"recursive Avro type {name} is not supported")
            self.named[name] = s
            inner = name.rpartition(".")[0] or None
            return record((f["name"], self.logical(f["type"], (*path, name), inner)) for f in s["fields"])
        if kind in ("enum", "fixed"):
            self.named[self.full(s["name"], s.get("namespace", space))] = s
            return LType("string")
        if kind == "array":
            return list_of(self.logical(s["items"], path, space))
        if kind == "map":
            raise LoadError("Avro maps are not supported")
        return self.logical(kind, path, space)

    def value(self, s, c: Cursor, want: LType, space: str | None = None):
        """A value as it is stored for the logical type ``want``."""
        if isinstance(s, list):
            branch = s[c.long()]
            if branch == "null":
                return None
            if want.kind != "union":
                return self.value(branch, c, want, space)
            own = self.logical(branch, (), space)
            at = next(i for i, b in enumerate(want.branches) if b == own.plain() or b.numeric and own.numeric)
            return {"tag": at, **{f"m{i}": None for i in range(len(want.branches))}, f"m{at}": self.value(branch, c, want.branches[at], space)}
        if isinstance(s, str) and s not in PRIMITIVES:
            return self.value(self.named[self.full(s, space)], c, want, space)
        kind = s if isinstance(s, str) else s["type"]
        if kind == "null":
            return None
        if kind == "boolean":
            return c.take(1) == b"\x01"
        if kind in ("int", "long"):
            return float(c.long()) if want.kind == "float" else c.long()
        if kind == "float":
            return struct.unpack("<f", c.take(4))[0]
        if kind == "double":
            return struct.unpack("<d", c.take(8))[0]
        if kind in ("string", "bytes"):
            return c.bytes().decode("utf-8", "replace")
        if kind == "fixed":
            return c.take(s["size"]).decode("utf-8", "replace")
        if kind == "enum":
            return s["symbols"][c.long()]
        if kind == "array":
            return c.blocks(lambda: self.value(s["items"], c, want.elem, space))
        if kind in ("record", "error"):
            inner = self.full(s.get("name", ""), s.get("namespace", space)).rpartition(".")[0] or None
            return {f["name"]: self.value(f["type"], c, want.field(f["name"]), inner) for f in s["fields"]}
        return self.value(kind, c, want, space)


def inflated(data: bytes, codec: str) -> bytes:
    if codec in ("null", ""):
        return data
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "bzip2":
        return bz2.decompress(data)
    if codec == "xz":
        return lzma.decompress(data)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "snappy":
        return bytes(pa.Codec("snappy").decompress(data[:-4], decompressed_size=snappy_size(data)))
    raise LoadError(f"Avro codec {codec} is not supported")


def snappy_size(data: bytes) -> int:
    size = shift = 0
    for b in data:
        size |= (b & 0x7F) << shift
        if b < 0x80:
            return size
        shift += 7
    return size


def rows(data: bytes) -> Iterator[dict]:
    meta, cursor = header(data)
    reader = Reader(json.loads(meta["avro.schema"]))
    sync = cursor.take(16)
    while cursor.at < len(data):
        count = cursor.long()
        block = Cursor(inflated(cursor.bytes(), meta.get("avro.codec", b"null").decode()))
        if cursor.take(16) != sync:
            raise LoadError("a block of the Avro file is damaged")
        for _ in range(count):
            yield reader.value(reader.schema, block, reader.type)


class AvroSource(Prepared):
    """All files are read by one scan; files of one schema share columns in it."""

    def __init__(self, spark: SparkSession, paths: list[str], options):
        self.spark, self.paths = spark, paths
        self.kinds: dict[bytes, list] = {}
        for path, (data, ended) in zip(paths, beginnings(spark, paths), strict=True):
            size = len(data)
            while True:  # metadata may be longer than a first look
                try:
                    meta, _ = header(data)
                    break
                except LoadError:
                    if ended or data[:4] != MAGIC:
                        raise
                    size *= 8
                    data, ended = beginning(spark, path, size)
            if meta["avro.schema"] in self.kinds:
                continue
            t = Reader(json.loads(meta["avro.schema"])).type
            if t.kind != "record":
                raise LoadError(f"{path}: rows are not records")
            self.kinds[meta["avro.schema"]] = list(t.fields)
        self.schema = merged(list(self.kinds.values()))

    def load(self, needed, ordered) -> State:
        from pyspark.sql.pandas.types import to_arrow_schema

        kept = [(n, t) for n, t in self.schema if needed is None or n in needed]
        own: list[dict] = [{n: (f"k{k}_{i}", t) for i, (n, t) in enumerate(fields) if needed is None or n in needed} for k, fields in enumerate(self.kinds.values())]
        places = {text: (k, [(n, c) for n, (c, _) in own[k].items()]) for k, text in enumerate(self.kinds)}
        cells = [T.StructField(c, spark_type(t)) for fields in own for c, t in fields.values()]
        schema = T.StructType([*cells, T.StructField("__kind", T.IntegerType()), T.StructField("__file", T.StringType()), T.StructField("__row", T.LongType())])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = data.as_py()
                    kind, names = places[header(data)[0]["avro.schema"]]
                    held = []
                    for i, row in enumerate(rows(data)):
                        held.append({**{c: row[n] for n, c in names}, "__kind": kind, "__file": path, "__row": i})
                        if len(held) == 8192:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)

        df = scan(self.spark, lambda: self.spark.read.format("binaryFile").load(self.paths), "path", "content").mapInArrow(run, schema)
        columns = []
        for n, t in kept:
            value = null_of(t)
            for k, fields in enumerate(own):
                if n in fields:
                    c, mine = fields[n]
                    value = F.when(F.col("__kind") == k, coerce(F.col(c), mine, t)).otherwise(value) if len(own) > 1 else coerce(F.col(c), mine, t)
            columns.append(value.alias(n))
        order = [("__file", False), ("__row", False)] if ordered else []
        return State(df.select(*columns, *[F.col(n) for n, _ in order]), kept, order)
