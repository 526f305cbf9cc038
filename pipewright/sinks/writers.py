"""One writer for each format: rows come from an iterator, so a large result streams through. A file can also be put together
from parts that several tasks wrote (``write_part``, ``join_parts``)."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import shutil
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from typing import BinaryIO

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq

from ..errors import WriteError
from ..types import LType, Schema, contains
from .render import display, float_text, json_text, json_texts

EXTENSION = {"table": "txt", "csv": "csv", "json": "json", "jsonl": "jsonl", "avro": "avro", "parquet": "parquet"}
BATCH = 4096
GROUP_ROWS, GROUP_BYTES = 1 << 17, 1 << 25


def write_table(rows: Iterable, schema: Schema, out: BinaryIO) -> None:
    if not schema:
        return
    cells = [[display(v, t) for v, (_, t) in zip(r, schema, strict=True)] for r in rows]
    size = lambda s: len(s.encode("utf-8", "surrogatepass"))
    width = [max([size(n), *(size(c[i]) for c in cells)]) for i, (n, _) in enumerate(schema)]
    line = lambda parts, mark=" | ": mark.join(p + " " * (w - size(p)) for p, w in zip(parts, width, strict=True)) + "\n"
    out.write(line([n for n, _ in schema]).encode())
    out.write(("-+-".join("-" * w for w in width) + "\n").encode())
    for c in cells:
        out.write(line(c).encode("utf-8", "surrogatepass"))


def csv_lines(lines: Iterable[list[str]], out: BinaryIO) -> None:
    lines = iter(lines)
    while some := list(islice(lines, BATCH)):
        text = io.StringIO(newline="")
        csv.writer(text, lineterminator="\n").writerows(some)
        out.write(text.getvalue().encode("utf-8", "surrogatepass"))


def csv_head(schema: Schema, out: BinaryIO) -> None:
    csv_lines([[n for n, _ in schema]], out)


def csv_cell(t: LType) -> Callable:
    """What shows a value of the type that isn't null."""
    return {"int": str, "string": str, "float": float_text}.get(t.kind, lambda v: display(v, t))


def csv_body(rows: Iterable, schema: Schema, out: BinaryIO) -> None:
    cells = [csv_cell(t) for _, t in schema]
    csv_lines((["" if v is None else f(v) for v, f in zip(r, cells, strict=True)] for r in rows), out)


def write_csv(rows: Iterable, schema: Schema, out: BinaryIO) -> None:
    csv_head(schema, out)
    csv_body(rows, schema, out)


def json_body(rows: Iterable, schema: Schema, out: BinaryIO) -> None:
    """An array without its brackets."""
    mark, text = "", json_text(schema, "  ", 1)
    for r in rows:
        out.write((mark + text(r)).encode("utf-8", "surrogatepass"))
        mark = ",\n  "


def write_json(rows: Iterable, schema: Schema, out: BinaryIO) -> None:
    first = list(islice(rows := iter(rows), 1))
    if not first:
        out.write(b"[]\n")
        return
    out.write(b"[\n  ")
    json_body(chain(first, rows), schema, out)
    out.write(b"\n]\n")


def write_jsonl(rows: Iterable, schema: Schema, out: BinaryIO) -> None:
    text = json_text(schema)
    for r in rows:
        out.write((text(r) + "\n").encode("utf-8", "surrogatepass"))


def check_binary(schema: Schema, form: str) -> None:
    if not schema:
        raise WriteError(f"{form} output needs at least one column")
    for n, t in schema:
        if contains(t, "union") or contains(t, "mixed"):
            raise WriteError(f"{form} output cannot hold column {n!r} of type {t}")


def arrow_type(t: LType) -> pa.DataType:
    if t.kind == "list":
        return pa.list_(pa.field("element", arrow_type(t.elem), t.elem.nullable))
    if t.kind == "record":
        return pa.struct([pa.field(n, arrow_type(x), x.nullable) for n, x in t.fields])
    return {"int": pa.int64(), "float": pa.float64(), "bool": pa.bool_(), "timestamp": pa.timestamp("us"), "date": pa.date32()}.get(t.kind, pa.string())


def as_python(v, t: LType):
    if v is None:
        return None
    if t.kind == "list":
        return [as_python(x, t.elem) for x in v]
    if t.kind == "record":
        return {n: as_python(v[n], x) for n, x in t.fields}
    return v


def write_parquet(rows: Iterable, schema: Schema, out: BinaryIO) -> None:
    check_binary(schema, "parquet")
    made = parquet_schema(schema)
    with pq.ParquetWriter(out, made) as writer:
        held: list[dict] = []
        for r in rows:
            held.append({n: as_python(v, t) for v, (n, t) in zip(r, schema, strict=True)})
            if len(held) == BATCH:
                writer.write_batch(pa.RecordBatch.from_pylist(held, schema=made))
                held = []
        if held:
            writer.write_batch(pa.RecordBatch.from_pylist(held, schema=made))


def arrow_column(c: pa.Array, t: LType) -> pa.Array:
    if t.kind in ("list", "record"):
        return pa.array([as_python(v, t) for v in c.to_pylist()], arrow_type(t))
    return c.cast(arrow_type(t))


def parquet_groups(tables: Iterable[pa.Table], made: pa.Schema, out: BinaryIO) -> None:
    """Tables of any sizes as row groups of ``GROUP_ROWS`` rows or ``GROUP_BYTES`` bytes."""
    with pq.ParquetWriter(out, made) as writer:
        held: list[pa.Table] = []

        def flush() -> None:
            if held:
                writer.write_table(pa.concat_tables(held))
                held.clear()

        for table in tables:
            held.append(table)
            if sum(x.num_rows for x in held) >= GROUP_ROWS or sum(x.nbytes for x in held) >= GROUP_BYTES:
                flush()
        flush()


def parquet_schema(schema: Schema) -> pa.Schema:
    return pa.schema([pa.field(n, arrow_type(t), t.nullable) for n, t in schema])


def parquet_body(batches: Iterable[pa.RecordBatch], schema: Schema, out: BinaryIO) -> None:
    made = parquet_schema(schema)
    parquet_groups((pa.Table.from_arrays([arrow_column(b.column(i), t) for i, (_, t) in enumerate(schema)], schema=made) for b in batches), made, out)


def parquet_joined(parts: Iterable[BinaryIO], schema: Schema, out: BinaryIO) -> None:
    def tables() -> Iterator[pa.Table]:
        for part in parts:
            file = pq.ParquetFile(part)
            for i in range(file.num_row_groups):
                yield file.read_row_group(i).cast(made)

    made = parquet_schema(schema)
    parquet_groups(tables(), made, out)


MAGIC = b"Obj\x01"
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def avro_schema(t: LType, path: str):
    out: object
    if t.kind == "record":
        for n, _ in t.fields:
            if not NAME.match(n):
                raise WriteError(f"avro output: {n!r} is not a field name")
        out = {"type": "record", "name": path, "fields": [{"name": n, "type": avro_schema(x, f"{path}_{n}")} for n, x in t.fields]}
    elif t.kind == "list":
        out = {"type": "array", "items": avro_schema(t.elem, f"{path}_item")}
    else:
        out = {"int": "long", "float": "double", "bool": "boolean"}.get(t.kind, "string")
    return ["null", out] if t.nullable else out


def long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def avro_value(v, t: LType, out: bytearray) -> None:
    if t.nullable:
        out += long(0 if v is None else 1)
        if v is None:
            return
    elif v is None:
        raise WriteError("avro output: null in a column that has none")
    if t.kind == "record":
        for n, x in t.fields:
            avro_value(v[n], x, out)
    elif t.kind == "list":
        if v:
            out += long(len(v))
            for x in v:
                avro_value(x, t.elem, out)
        out += long(0)
    elif t.kind == "int":
        out += long(v)
    elif t.kind == "float":
        out += struct.pack("<d", v)
    elif t.kind == "bool":
        out += b"\x01" if v else b"\x00"
    else:
        data = (v if isinstance(v, str) else v.isoformat()).encode("utf-8", "surrogatepass")
        out += long(len(data)) + data


def avro_head(schema: Schema, out: BinaryIO, sync: bytes) -> None:
    text = json.dumps(avro_schema(LType("record", fields=tuple(schema)), "row")).encode()
    meta = {b"avro.schema": text, b"avro.codec": b"deflate"}
    out.write(MAGIC + long(len(meta)) + b"".join(long(len(k)) + k + long(len(v)) + v for k, v in meta.items()) + long(0) + sync)


def avro_body(rows: Iterable, schema: Schema, out: BinaryIO, sync: bytes) -> None:
    t = LType("record", fields=tuple(schema))
    block, count = bytearray(), 0

    def flush() -> None:
        nonlocal block, count
        if count:
            tool = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = tool.compress(bytes(block)) + tool.flush()
            out.write(long(count) + long(len(data)) + data + sync)
        block, count = bytearray(), 0

    names = [n for n, _ in schema]
    for r in rows:
        avro_value(dict(zip(names, r, strict=True)), t, block)
        count += 1
        if count == BATCH:
            flush()
    flush()


def write_avro(rows: Iterable, schema: Schema, out: BinaryIO) -> None:
    check_binary(schema, "avro")
    sync = os.urandom(16)
    avro_head(schema, out, sync)
    avro_body(rows, schema, out, sync)


#: Rows of a batch become text together, of so many bytes at a time.
TEXT_BYTES = 1 << 26


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.nbytes > TEXT_BYTES and b.num_rows > 1:
            half = b.num_rows // 2
            yield from slices([b.slice(0, half), b.slice(half)])
        elif b.num_rows:
            yield b


def shown(c: pa.Array, t: LType, f: Callable) -> pa.Array:
    """``f`` of each value that isn't null, called once for equal ones."""
    if t.kind not in ("int", "float", "bool", "string"):
        return pa.array([None if v is None else f(v) for v in c.to_pylist()], pa.string())
    c = c.cast(arrow_type(t))
    if t.kind == "int":
        return c.cast(pa.string())
    bits = c.view(pa.int64()) if t.kind == "float" else c  # 0.0 and -0.0 are two texts
    coded = bits.dictionary_encode()
    values = coded.dictionary.view(pa.float64()) if t.kind == "float" else coded.dictionary
    return pa.array([f(v) for v in values.to_pylist()], pa.string()).take(coded.indices)


def write_lines(columns: list, out: BinaryIO) -> None:
    """Lines whose pieces are arrays and fixed texts between them."""
    lines = pc.binary_join_element_wise(*columns, "")
    out.write(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_buffer())
    out.write(b"\n")


class Written(list):
    write = list.append


def csv_quoted(f: Callable, alone: bool) -> Callable:
    """What the csv module writes for a value; an empty cell is another where it is ``alone`` in its row."""
    def text(v) -> str:
        line = Written()
        csv.writer(line, lineterminator="\n").writerow([f(v)] if alone else [f(v), ""])
        return line[0][: -1 if alone else -2]

    return text


def csv_batches(batches: Iterable[pa.RecordBatch], schema: Schema, out: BinaryIO) -> None:
    alone = len(schema) == 1
    cells = [csv_quoted(csv_cell(t), alone) for _, t in schema]
    empty = csv_quoted(str, alone)("")
    for b in slices(batches):
        columns: list = []
        for c, (_, t), f in zip(b.columns, schema, cells, strict=True):
            columns += [*([","] if columns else []), shown(c, t, f).fill_null(empty)]
        write_lines(columns, out)


def jsonl_batches(batches: Iterable[pa.RecordBatch], schema: Schema, out: BinaryIO) -> None:
    texts = json_texts(schema)
    for b in slices(batches):
        columns: list = []
        for name, i, f in texts:
            columns += [("," if columns else "{") + name, shown(b.column(i), schema[i][1], f).fill_null("null")]
        write_lines([*columns, "}"], out)


WRITERS = {"table": write_table, "csv": write_csv, "json": write_json, "jsonl": write_jsonl, "avro": write_avro, "parquet": write_parquet}


def write_part(batches: Iterable[pa.RecordBatch], rows: Callable, form: str, schema: Schema, out: BinaryIO, sync: bytes) -> None:
    """One part of a file; ``rows`` makes tuples of batches."""
    if form == "parquet":
        parquet_body(batches, schema, out)
    elif form == "avro":
        avro_body(rows(batches), schema, out, sync)
    elif form in ("csv", "jsonl") and schema:
        {"csv": csv_batches, "jsonl": jsonl_batches}[form](batches, schema, out)
    else:
        {"csv": csv_body, "json": json_body, "jsonl": write_jsonl}[form](rows(batches), schema, out)


def join_parts(parts: Iterable[BinaryIO], form: str, schema: Schema, out: BinaryIO, sync: bytes) -> None:
    """One file of its parts, in their order; at least one, and none without rows."""
    if form == "parquet":
        parquet_joined(parts, schema, out)
        return
    if form == "csv":
        csv_head(schema, out)
    elif form == "avro":
        avro_head(schema, out, sync)
    start, end = (b"[\n  ", b"\n]\n") if form == "json" else (b"", b"")
    for part in parts:
        out.write(start)
        shutil.copyfileobj(part, out, 1 << 22)
        start = b",\n  " if form == "json" else b""
    out.write(end)
