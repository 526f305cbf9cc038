"""JSON and JSON lines.

Spark's reader coerces silently (a number into a string field, a fraction into null), so records are parsed and checked
against the schema in Arrow batches on the executors.
"""

from __future__ import annotations

import json as pyjson
import pickle
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import json as pajson
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoadError
from ..operators.state import State
from ..types import BOOL, FLOAT, INT, NULL, STRING, LType, Schema, TypeConflict, finalised, list_of, record, spark_type, unify
from . import Prepared
from .files import beginning, last_byte, lengths, origin, scan


#: A JSON file of up to so many bytes is parsed as a whole; of a larger one, text of so many characters at a time.
WHOLE, CHUNK = 1 << 22, 1 << 16
END, SPACE = "}", " \t\n\r"
SCALARS = {"int": pa.int64(), "float": pa.float64(), "bool": pa.bool_(), "string": pa.string()}
SHAPES = 1000  # of records that inference knows at a time
TEXT = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
REST = re.compile(r'(?:[^"\\]|\\.)*+("?)', re.S)


class Bad(ValueError):
    """A record that isn't valid or doesn't fit the schema."""


def whole(text: str):
    n = int(text)
    return n if -(2**63) <= n < 2**63 else float(text)


def no_constant(text: str):
    raise Bad(f"{text} is not JSON")


def parse(text: str):
    try:
        return pyjson.loads(text, parse_int=whole, parse_constant=no_constant)
    except (ValueError, RecursionError) as e:
        raise Bad(str(e)) from None


def type_of(value) -> LType:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        return INT
    if isinstance(value, float):
        return FLOAT
    if isinstance(value, str):
        return STRING
    if isinstance(value, list):
        elem = NULL if not value else type_of(value[0])
        for x in value[1:]:
            elem = unify(elem, type_of(x), in_list=True)
        return list_of(elem if value else LType("null"))
    return record((k, type_of(value[k])) for k in sorted(value))


def merge(a: LType | None, b: LType) -> LType:
    """Strict, over records; kinds may only mix inside one list value."""
    if a is None:
        return b
    if a.kind == b.kind == "list":
        x, y = a.elem, b.elem
        if "null" in (x.kind, y.kind):
            out = y.maybe(x.nullable) if x.kind == "null" else x.maybe(y.nullable)
            return LType("list", a.nullable or b.nullable, elem=out)
        return LType("list", a.nullable or b.nullable, elem=merge(x, y))
    if a.kind == b.kind == "record":
        names = list(dict.fromkeys([n for n, _ in a.fields] + [n for n, _ in b.fields]))
        fields = []
        for n in names:
            x, y = a.field(n), b.field(n)
            fields.append((n, merge(x, y) if x and y else (x or y).maybe()))
        return LType("record", a.nullable or b.nullable, tuple(fields))
    if "mixed" in (a.kind, b.kind) and a.kind != b.kind and "null" not in (a.kind, b.kind):
        return LType("mixed", a.nullable or b.nullable)
    return unify(a, b)


def encoded(value) -> str | None:
    """An element of a mixed list as JSON text, keys sorted; floats keep a point."""
    return None if value is None else pyjson.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fitted(value, t: LType, path: str):
    """The value as it is stored, or Bad."""
    if value is None:
        if not t.nullable and t.kind != "mixed":
            raise Bad(f"{path} is null")
        return None
    if t.kind == "float" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if t.kind == "int" and isinstance(value, int) and not isinstance(value, bool):
        return value
    if t.kind == "string" and isinstance(value, str) or t.kind == "bool" and isinstance(value, bool):
        return value
    if t.kind == "list" and isinstance(value, list):
        return [encoded(x) for x in value] if t.elem.kind == "mixed" else [fitted(x, t.elem, path + "[]") for x in value]
    if t.kind == "record" and isinstance(value, dict):
        if fresh := set(value) - {n for n, _ in t.fields}:
            raise Bad(f"{path} has an unknown field {sorted(fresh)[0]!r}")
        return {n: fitted(value.get(n), x, f"{path}.{n}") for n, x in t.fields} or {"__empty": None}
    raise Bad(f"{path} is not {t}")


def loosened(t: LType) -> LType:
    return LType(t.kind, True, tuple((n, loosened(x)) for n, x in t.fields), loosened(t.elem) if t.elem else None)


#: A record of scalars whose text any JSON parser takes for the same values: no integer zero with a sign (0.0 or -0.0), no halves of
#: surrogate pairs.
QUOTED = r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u(?:[0-9abcefABCEF][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2}))*"'
NUMBER = r"(?:(?:-?[1-9][0-9]*|0)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|-0(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+))"
FIELD = rf"[ \t]*{QUOTED}[ \t]*:[ \t]*(?:{QUOTED}|{NUMBER}|true|false|null)[ \t]*"
FLAT = rf"\A[ \t]*\{{(?:{FIELD}(?:,{FIELD})*|[ \t]*)\}}[ \t]*\z"


def columns(lines: pa.Array, kept: Schema, strict: bool) -> list[pa.Array] | None:
    """The columns of records of scalars, parsed together; None if one isn't plain or doesn't fit, which ``fitted`` tells more of."""
    if lines.null_count or not pc.all(pc.match_substring_regex(lines, FLAT), min_count=0).as_py():
        return None
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_buffer()
    made = pa.schema([(n, SCALARS[t.kind]) for n, t in kept])
    how = pajson.ParseOptions(explicit_schema=made, unexpected_field_behavior="error" if strict else "ignore")
    try:
        table = pajson.read_json(pa.BufferReader(text), pajson.ReadOptions(use_threads=False, block_size=text.size + 1), how)
    except pa.ArrowInvalid:
        return None
    found = [table.column(n).combine_chunks() for n, _ in kept]
    if table.num_rows != len(lines) or any(c.null_count and not t.nullable for c, (_, t) in zip(found, kept, strict=True)):
        return None
    return found


class JsonSource(Prepared):
    def __init__(self, spark: SparkSession, paths: list[str], options):
        self.spark, self.paths, self.options = spark, paths, options
        self.lines = options.format == "jsonl"
        limit = options.infer_rows
        t, left, complete = None, limit, True
        bad = 0
        if limit == -1:
            t, bad = self.infer_all()
        else:
            for path in paths:
                for value in self.sample(path, left + 1):
                    if left == 0:
                        complete = False
                        break
                    left -= 1
                    try:
                        value = parse(value) if self.lines else value
                        if not isinstance(value, dict):
                            raise Bad("not an object")
                        t = merge(t, type_of(value))
                    except (Bad, TypeConflict) as e:
                        bad += 1
                        if bad > options.max_bad_records:
                            raise LoadError(f"{path}: bad record: {e}") from None
                if not complete:
                    break
        if bad > options.max_bad_records:
            raise LoadError("bad records: a value fits no schema")
        t = finalised(t or record([]))
        self.schema: Schema = [(n, x if complete else loosened(x)) for n, x in t.fields]

    def sample(self, path: str, n: int) -> list:
        if self.lines:
            data, ended = beginning(self.spark, path, 1 << 18)
            found = re.split("\r\n|\r|\n", data.decode("utf-8", "replace"))
            found = [x for x in (found if ended else found[:-1]) if x.strip(" ")]
            if ended or len(found) >= n:
                return found[:n]
            rows = self.spark.read.text(path).where(F.trim("value") != "").limit(n).collect()
            return [r[0] for r in rows]
        size = 1 << 18
        while True:
            data, ended = beginning(self.spark, path, size)
            text = data.decode("utf-8", "replace")
            if ended:
                return self.array(text, path)[:n]
            found = list(islice(elements(text.split(END)[:-1], path, False), n))
            if len(found) >= n:
                return found
            size = min(8, 1 + n // max(1, len(found))) * len(data)

    @staticmethod
    def array(text: str, path: str) -> list:
        try:
            value = parse(text)
        except Bad as e:
            raise LoadError(f"{path}: {e}") from None
        if not isinstance(value, list):
            raise LoadError(f"{path}: not one array of objects")
        return value

    def all_texts(self) -> list[tuple[DataFrame, bool]]:
        """Scans of (file, row, value), and whether values are whole: a record's text each, or a small file's array; or what
        ends at each closing brace of larger arrays, all of a file in one task, in order. Row numbers rise within a file."""
        def read(paths: list[str], **how) -> DataFrame:
            return scan(self.spark, lambda: self.spark.read.text(paths, **how), origin().alias("__file"), F.monotonically_increasing_id().alias("__row"), "value")

        if self.lines:
            return [(read(self.paths), True)]
        sizes = dict(zip(self.paths, lengths(self.spark, self.paths), strict=True))
        small = [p for p, n in sizes.items() if n is not None and n <= (WHOLE if p.lower().endswith(".json") else WHOLE // 64)]
        large = [p for p in sizes if p not in set(small)]
        out = [(read(small, wholetext=True), True)] if small else []
        for path in large:  # the reader leaves out a brace at the very end, which no array has
            if path.lower().endswith(".json") and sizes[path] and last_byte(self.spark, path, sizes[path]) == END.encode():
                raise LoadError(f"{path}: not one array of objects")
        if large:
            out.append((read(large, lineSep=END).repartition("__file").sortWithinPartitions("__file", "__row"), False))
        return out

    def infer_all(self) -> tuple[LType | None, int]:
        """A partial type from each file of each partition, merged on the driver in order."""
        lines = self.lines

        def run_of(whole: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                def part() -> pa.RecordBatch:
                    return pa.RecordBatch.from_pydict({"file": pa.array([at[0]], pa.string()), "row": [at[1]], "type": pa.array([cloudpickle.dumps(t)], pa.binary()), "bad": pa.array([bad], pa.int64())})

                t, bad, at = None, 0, None
                known: set[tuple] = set()  # shapes that leave the type as it is
                for file, row, value in values(batches, lines, whole):
                    if at and at[0] != file:
                        yield part()
                        t, bad, at = None, 0, None
                        known.clear()
                    at = at or (file, row)
                    try:
                        if isinstance(value, Bad):
                            raise value
                        kinds = tuple(map(type, value.values()))
                        shape = None if list in kinds or dict in kinds else (tuple(value), kinds)
                        if shape in known:
                            continue
                        before, t = t, merge(t, type_of(value))
                        if before != t:
                            known.clear()
                        elif shape is not None and len(known) < SHAPES:
                            known.add(shape)
                    except (Bad, TypeConflict):
                        bad += 1
                if at:
                    yield part()

            return run

        found = []
        for df, whole in self.all_texts():
            found += df.mapInArrow(run_of(whole), "file string, row long, type binary, bad long").collect()
        found.sort(key=lambda r: (r["file"].encode(), r["row"]))
        t, bad = None, sum(r["bad"] for r in found)
        for r in found:
            own = pickle.loads(bytes(r["type"]))
            try:
                t = t if own is None else merge(t, own)
            except TypeConflict as e:
                raise LoadError(f"records differ: {e}") from None
        return t, bad

    def load(self, needed, ordered) -> State:
        kept = [(n, t) for n, t in self.schema if needed is None or n in needed]
        budget, lines = self.options.max_bad_records, self.lines
        known = None if needed is not None and len(kept) < len(self.schema) else {n for n, _ in self.schema}
        fields = [T.StructField(n, spark_type(t)) for n, t in kept]
        schema = T.StructType([*fields, T.StructField("__file", T.StringType()), T.StructField("__row", T.LongType()), T.StructField("__bad", T.StringType())])
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        plain = lines and bool(kept) and all(t.kind in SCALARS for _, t in kept)

        def run_of(whole: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                if plain:
                    for batch in batches:
                        if (found := columns(batch.column(2), kept, known is not None)) is not None:
                            yield pa.RecordBatch.from_arrays([*found, batch.column(0), batch.column(1), pa.nulls(batch.num_rows, pa.string())], schema=arrow)
                        else:
                            yield from one_by_one(iter([batch]))
                else:
                    yield from one_by_one(batches)

            def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = []
                for file, row, value in values(batches, lines, whole):
                    made = {"__file": file, "__row": row, "__bad": None}
                    try:
                        if isinstance(value, Bad):
                            raise value
                        if known is not None and (fresh := set(value) - known):
                            raise Bad(f"unknown field {sorted(fresh)[0]!r}")
                        made |= {n: fitted(value.get(n), t, n) for n, t in kept}
                    except Bad as e:
                        made = {"__file": file, "__row": row, "__bad": str(e)[:200]}
                    out.append(made)
                    if len(out) >= 8192:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

            return run

        df = reduce(DataFrame.union, [texts.mapInArrow(run_of(whole), schema) for texts, whole in self.all_texts()])
        bad = F.col("__bad")
        if budget:
            if df.where(bad.isNotNull()).limit(budget + 1).count() > budget:
                raise LoadError(f"more than {budget} bad records")
            df = df.where(bad.isNull())
        else:
            message = F.concat(F.lit("bad record: "), bad)
            df = df.where(F.when(bad.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
        order = [("__file", False), ("__row", False)] if ordered else []
        from ..operators.state import quoted

        return State(df.select(*[quoted(n) for n, _ in kept], *[F.col(n) for n, _ in order]), kept, order)


def values(batches: Iterator[pa.RecordBatch], lines: bool, whole: bool) -> Iterator[tuple[str, int, object]]:
    """(file, row, object or Bad) of what ``all_texts`` gives."""
    rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    if whole:
        for file, row, text in rows:
            for i, value in enumerate(records(text, lines)):
                yield file, row + i, value
        return
    for file, own in groupby(rows, key=itemgetter(0)):
        for i, value in enumerate(elements((text for _, _, text in own), file)):
            yield file, i, value if isinstance(value, dict) else Bad("not an object")


def elements(pieces: Iterable[str], path: str, ended: bool = True) -> Iterator:
    """The elements of an array whose text comes cut at its closing braces, a few at a time. What lies between two elements
    of the array is parsed as an array of its own; nesting is counted only to tell where that may be. If the text has not
    ``ended``, elements that are not whole are left out."""
    held: list[str] = []
    size = depth = 0
    quoted = started = False

    def between(last: bool) -> list:
        nonlocal started
        text = "".join(held)
        if last and not started:
            return JsonSource.array(text, path)
        text = text.strip(SPACE)
        if last and text == "]":
            return []
        if text[:1] != (",", "[")[not started] or last and text[-1:] != "]":
            raise LoadError(f"{path}: not one array of objects")
        found = JsonSource.array("[" + text[1 : len(text) - last] + "]", path)
        if not found:
            raise LoadError(f"{path}: not one array of objects")
        started = True
        return found

    ahead = None
    for piece in pieces:
        if ahead is not None:
            held.append(ahead + END)
            size += len(ahead) + 1
            rest = ahead
            if quoted:
                m = REST.match(rest)
                rest, quoted = rest[m.end() :], not m[1]
            if not quoted:
                rest = TEXT.sub("", rest)
                if at := rest.count('"'):
                    rest, quoted = rest[: rest.index('"')], at > 0
                depth += rest.count("{") + rest.count("[") - rest.count("]") - (not quoted)
            if not quoted and depth == 1 and size >= CHUNK:
                yield from between(False)
                held, size = [], 0
        ahead = piece
    if not ended:
        if ahead is not None and not quoted and depth == 1 and held:
            yield from between(False)
        return
    held.append(ahead or "")
    yield from between(True)


def records(text: str, lines: bool) -> Iterator:
    """The objects of a line, or of an array; a Bad in place of one that isn't an object."""
    if lines:
        if text.strip():
            try:
                value = parse(text)
                yield value if isinstance(value, dict) else Bad("not an object")
            except Bad as e:
                yield e
        return
    for value in JsonSource.array(text, "input"):
        yield value if isinstance(value, dict) else Bad("not an object")
