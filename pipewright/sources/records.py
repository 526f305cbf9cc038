"""CSV files whose cells hold line ends, read by many tasks.

A task that begins inside a file doesn't know whether it begins inside quotes. The survey cuts each split both ways; the numbers of
quotes in the splits before tell on the driver which of the two is right. Only a file whose records all are regular is read
like this: cells with quotes are quoted as a whole, so that quotes always part inside from outside.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .files import decoded, location, scan

#: The driver sees the records that lie in two splits, each of so many bytes at most; a file with a longer one isn't regular.
LONG = 1 << 20
SURVEY = pa.schema({
    "file": pa.string(), "start": pa.int64(), "state": pa.int64(), "regular": pa.bool_(), "after": pa.int64(), "closed": pa.bool_(), "head": pa.string(),
    "tail": pa.string(), "row": pa.int64(), "whole": pa.int64(),
})


def regular(delim: str) -> str:
    """What matches a record in which quotes are where the grammar wants them, without other control characters than tabs and
    line ends, which readers treat in their own ways."""
    control = r"\x00-\x08\x0b-\x1f"
    cell = rf'(?:"(?:[^"{control}]|"")*"|[^"\n{re.escape(delim)}{control}]*)'
    return rf"\A(?:{cell}(?:{re.escape(delim)}{cell})*)\z"


#: What readers skip or strip.
ODD = r"\A(?:[ \t\n]+\z|\x{feff})"


def is_regular(records: pa.Array, delim: str) -> bool:
    fits = pc.and_not(pc.match_substring_regex(records, regular(delim)), pc.match_substring_regex(records, ODD))
    return pc.all(fits, min_count=0).as_py()


def texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with the split they are from. The splits of this frame stay as they are, whatever is set or lost later."""
    split = location().alias("file"), F.col("_metadata.file_block_start").alias("start")
    df = scan(spark, lambda: spark.read.option("lineSep", "\n").text(paths), *split, F.monotonically_increasing_id().alias("row"), "value")
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[pa.RecordBatch]]]:
    """The lines of each split."""
    def cut() -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
        for batch in batches:
            if batch.num_rows:
                file, start = (batch.column(i).dictionary_encode() for i in (0, 1))
                ids = file.indices.to_numpy().astype(np.int64) * len(start.dictionary) + start.indices.to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), batch.num_rows]
                for a, b in zip(edges, edges[1:], strict=False):
                    yield (decoded(batch.column(0)[a].as_py()), batch.column(1)[a].as_py()), batch.slice(a, b - a)

    for key, own in groupby(cut(), key=lambda x: x[0]):
        yield key, (b for _, b in own)


@dataclass
class Lines:
    """Lines of one split, cut into records as they come, ``inside`` quotes or not at first."""

    inside: int
    held: list[pa.Array] = field(default_factory=list)  # lines of a record that hasn't ended
    rows: list[pa.Array] = field(default_factory=list)
    closed: bool = False
    head: str | None = None
    long: bool = False

    def __post_init__(self) -> None:
        self.state = self.inside

    def text(self) -> str:
        return "\n".join(x for a in self.held for x in a.to_pylist())

    def add(self, lines: pa.Array, rows: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array] | None:
        """Lines of whole records, the first line of each and one more, and the numbers of all lines."""
        after = (self.state + np.cumsum(pc.count_substring(lines, '"').to_numpy())) & 1
        ends = np.flatnonzero(after == 0) + 1
        self.state = int(after[-1])
        if not len(ends):
            self.hold(lines, rows)
            return None
        first = 0
        if self.inside and not self.closed:
            first = int(ends[0])
            self.hold(lines[:first], rows[:first])
            self.head, self.held, self.rows = self.text(), [], []
            ends = ends[1:]
        self.closed = True
        before = sum(map(len, self.held))
        last = int(ends[-1]) if len(ends) else first
        whole = pa.concat_arrays([*self.held, lines[first:last]]), np.concatenate([[0], ends - first + before]), pa.concat_arrays([*self.rows, rows[first:last]])
        self.held, self.rows = [], []
        self.hold(lines[last:], rows[last:])
        return whole if len(ends) else None

    def hold(self, lines: pa.Array, rows: pa.Array) -> None:
        if len(lines):
            self.held.append(lines)
            self.rows.append(rows)
            if sum(a.nbytes for a in self.held) > LONG:
                self.long = True


def joined(lines: pa.Array, starts: np.ndarray) -> pa.Array:
    """The text of each record."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), lines), "\n")


def survey(delim: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), own in splits(batches):
            ways, good, whole = [Lines(0), Lines(1)], [True, True], [0, 0]
            for batch in own:
                for i, way in enumerate(ways):
                    if good[i]:
                        found = way.add(batch.column(3), batch.column(2))
                        if found:
                            records = joined(*found[:2])
                            whole[i] += pc.sum(pc.not_equal(records, ""), min_count=0).as_py()
                            good[i] = is_regular(records, delim)
                        good[i] = good[i] and not way.long
                if not any(good):
                    break  # no record is told from another then
            for i, way in enumerate(ways):
                opened = way.text() if good[i] and way.held else None
                through = bool(i) and not way.closed
                out = {
                    "file": file, "start": start, "state": i, "regular": good[i], "after": way.state, "closed": way.closed,
                    "head": (opened if through else way.head) if good[i] else None, "tail": None if through else opened,
                    "row": way.rows[0][0].as_py() if way.rows and not through else None, "whole": whole[i],
                }
                yield pa.RecordBatch.from_pylist([out], schema=SURVEY)

    return run


@dataclass
class Cut:
    """How files are cut: whether each split begins inside quotes, and the records that lie in several splits."""

    lines: DataFrame
    states: dict[tuple[str, int], int]
    between: list[tuple[str, int, str]]  # file, row, text
    irregular: set[str]


def surveyed(spark: SparkSession, paths: list[str], delim: str) -> Cut:
    cut = Cut(texts(spark, paths), {}, [], set())
    found = cut.lines.mapInArrow(survey(delim), from_arrow_schema(SURVEY)).collect()  # two rows for each split
    found.sort(key=lambda r: (r["file"], r["start"], r["state"]))
    for file, own in groupby(found, key=lambda r: r["file"]):
        rows = list(own)
        states, between = follow(file, rows)
        if states is None or not is_regular(pa.array([t for _, _, t in between], pa.string()), delim):
            cut.irregular.add(file)
        else:
            cut.states |= states
            cut.between += between
    return cut


def follow(file: str, rows: list) -> tuple[dict | None, list]:
    """From one split of a file to the next; None if it isn't regular."""
    states, between, state = {}, [], 0
    opened: list[str] = []
    row = None
    for pair in zip(rows[::2], rows[1::2], strict=True):
        r = pair[state]
        if not r["regular"] or not states and not r["whole"]:  # the first split has the header
            return None, []
        states[file, r["start"]] = state
        if state:
            opened.append(r["head"])
            if sum(map(len, opened)) > LONG:
                return None, []
            if r["closed"]:
                between.append((file, row, "\n".join(opened)))
                opened = []
        if r["tail"] is not None:
            opened, row = [r["tail"]], r["row"]
        state = r["after"]
    return (states, between) if state == 0 else (None, [])


def cells(records: Iterable[str], width: int, delim: str) -> list[list[str | None]]:
    """Cells of regular records, so many of each, and the text of a record that has more or fewer."""
    cell = re.compile(rf'(?:"((?:[^"]++|"")*+)"|([^"{re.escape(delim)}]*+)){re.escape(delim)}')
    out = []
    for text in records:
        found = [quoted.replace('""', '"') or plain for quoted, plain in cell.findall(text + delim)]
        out.append([*found[:width], *[None] * (width - len(found)), None if len(found) == width else text])
    return out


def read_cut(cut: Cut, paths: set[str], width: int, header: bool, delim: str, names: list[str], ordered: bool) -> DataFrame:
    """The cells of all records of the files: ``names`` are those of the cells, of the text of uneven records, and of file and row.
    Unless rows are ``ordered``, only uneven ones say their file."""
    states = {k: v for k, v in cut.states.items() if k[0] in paths}
    schema = ", ".join(f"`{n}` string" for n in names[:-1]) + f", `{names[-1]}` long"
    arrow = pa.schema([*[(n, pa.string()) for n in names[:-1]], (names[-1], pa.int64())])

    def parsed(records: pa.Array) -> list[pa.Array]:
        data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(records)], pa.int32()), records), "\n")[0].as_buffer()
        how = pacsv.ReadOptions(use_threads=False, block_size=data.size + 1, column_names=names[:width])
        grammar = pacsv.ParseOptions(delimiter=delim, newlines_in_values=True)
        kinds = pacsv.ConvertOptions(column_types=dict.fromkeys(names[:width], pa.string()), strings_can_be_null=False)
        try:
            table = pacsv.read_csv(pa.BufferReader(data), how, grammar, kinds)
            if table.num_rows == len(records):
                return [*(c.combine_chunks() for c in table.columns), pa.nulls(len(records), pa.string())]
        except pa.ArrowInvalid:
            pass  # records of different widths
        columns = list(zip(*cells(records.to_pylist(), width, delim), strict=True))
        return [pa.array(c, pa.string()) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in splits(batches):
            if key[0] not in paths:
                continue
            way, first = Lines(states[key]), header and key[1] == 0
            for batch in own:
                if not (found := way.add(batch.column(3), batch.column(2))):
                    continue
                lines, starts, rows = found
                records, rows = joined(lines, starts), rows.take(pa.array(starts[:-1]))
                there = pc.not_equal(records, "")
                records, rows = records.filter(there), rows.filter(there)
                if first and len(records):
                    records, rows, first = records[1:], rows[1:], False
                if len(records):
                    columns = parsed(records)
                    said = pa.repeat(pa.scalar(key[0]), len(records)) if ordered else pc.if_else(pc.is_null(columns[-1]), None, key[0]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*columns, said, rows], schema=arrow)

    df = cut.lines.mapInArrow(run, schema)
    between = [(f, r, t) for f, r, t in cut.between if f in paths]
    if between:
        made = [(*c, f, r) for c, (f, r, _) in zip(cells([t for _, _, t in between], width, delim), between, strict=True)]
        df = df.union(df.sparkSession.createDataFrame(made, schema))
    return df
