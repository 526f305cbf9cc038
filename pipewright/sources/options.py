"""Load options: which apply to which format, and compressed inputs."""

from __future__ import annotations

import gzip
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import zstandard
from pyarrow import fs
from pyspark.errors import PythonException
from pyspark.sql import SparkSession

from ..errors import LoadError, ParseError

SAMPLE = 20_480
EXTENSIONS = {"csv": "csv", "json": "json", "jsonl": "jsonl", "avro": "avro", "parquet": "parquet"}
SUFFIXES = {"gz": "gzip", "zst": "zstd", "zstd": "zstd", "deflate": "deflate", "zlib": "deflate"}
TEXT = ("csv", "json", "jsonl")


@dataclass(frozen=True)
class Options:
    format: str
    compression: str = "none"
    header: bool = True
    delim: str = ","
    allow_jagged_rows: bool = False
    ignore_unknown_values: bool = False
    infer_rows: int = SAMPLE
    max_bad_records: int = 0
    #: Spark's own codecs read it by its name.
    native: bool = True


def resolve(path: str, given: dict) -> Options:
    parts = os.path.basename(path.rstrip("/")).lower().split(".")
    suffix = SUFFIXES.get(parts[-1]) if len(parts) > 1 else None
    extension = EXTENSIONS.get(parts[-2] if suffix and len(parts) > 2 else parts[-1])
    form = given.get("format") or extension
    if form is None:
        raise LoadError(f"cannot tell the format of {path}; add 'with format=...'")
    compression = given.get("compression") or suffix or "none"
    if form not in TEXT and compression != "none":
        raise ParseError(f"{form} files cannot be {compression}-compressed as a whole")
    if form != "csv":
        for name in ("header", "delim", "allow_jagged_rows", "ignore_unknown_values"):
            if name in given:
                raise ParseError(f"load option {name} is for csv only, not {form}")
    if form not in TEXT:
        for name in ("infer_rows", "max_bad_records"):
            if name in given:
                raise ParseError(f"load option {name} is not for {form}")
    if form in ("json", "jsonl") and given.get("infer_rows") == 0:
        raise ParseError(f"infer_rows=0 is not for {form}")
    native = "compression" not in given and (suffix is None or parts[-1] in ("gz", "zst", "deflate"))
    rest = {k: v for k, v in given.items() if k not in ("format", "compression")}
    if "delim" in rest:
        rest["delim"] = rest["delim"][0]
    return Options(form, compression, native=native or compression == "none", **rest)


def key(o: Options) -> tuple:
    return o.format, o.compression


def opened(path: str):
    if "://" in path:
        system, name = fs.FileSystem.from_uri(path)
        return system.open_input_stream(name, compression=None)
    return open(path, "rb")


def inflated(file, compression: str) -> Iterator[bytes]:
    if compression == "zstd":
        reader = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True)
    elif compression == "gzip":
        reader = gzip.GzipFile(fileobj=file)
    elif compression == "deflate":
        tool = zlib.decompressobj()
        while chunk := file.read(1 << 20):
            while chunk:  # so much at a time, whatever it unfolds to
                yield tool.decompress(chunk, 1 << 20)
                chunk = tool.unconsumed_tail
        yield tool.flush()
        if not tool.eof:
            raise EOFError("compressed data ends too soon")
        return
    else:
        reader = file
    while chunk := reader.read(1 << 20):
        yield chunk


def has_shared_folder(spark: SparkSession) -> bool:
    return bool(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which may be in a store; a temporary one only where all run on one machine."""
    import tempfile

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.removeprefix("file://").removeprefix("file:").rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise LoadError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "pipewright")


def scratch_file(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    import uuid

    folder = shared_folder(spark)
    if "://" not in folder:
        os.makedirs(folder, exist_ok=True)
    return f"{folder}/{uuid.uuid4().hex}-{name}"


def written(target: str, chunks: Iterator[bytes]) -> None:
    if "://" in target:
        system, name = fs.FileSystem.from_uri(target)
        with system.open_output_stream(name) as out:
            for chunk in chunks:
                out.write(chunk)
    else:
        with open(target, "wb") as out:
            out.writelines(chunks)


def unpack(path: str, target: str, compression: str) -> None:
    try:
        with opened(path) as file:
            written(target, inflated(file, compression))
    except (OSError, EOFError, zlib.error, zstandard.ZstdError) as e:
        raise LoadError(f"{path}: {e}") from None


def readable(spark: SparkSession, paths: list[str], o: Options) -> list[str]:
    """Paths that Spark reads; for what its codecs don't, decompressed copies in the shared folder, each made by a task of its own."""
    if o.native:
        return paths
    base = scratch_file(spark, "input")
    targets = [f"{base}-{i:08d}" for i in range(len(paths))]  # in the order of the paths
    if spark.sparkContext.master.startswith("local") or all("://" in p for p in paths):
        jobs = list(zip(paths, targets, strict=True))

        def run(batches):
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    unpack(*jobs[i], o.compression)
                yield batch

        try:
            spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()
        except PythonException as e:
            found = re.search(r"LoadError: (.*)", str(e))
            raise (LoadError(found[1]) if found else e) from None
    else:  # on the driver's own disk
        for path, target in zip(paths, targets, strict=True):
            unpack(path, target, o.compression)
    return targets


def spooled(spark: SparkSession, stdin, o: Options) -> str:
    """Standard input, kept in a file, since it can be read but once."""
    target = scratch_file(spark, "stdin")
    as_bytes = (c if isinstance(c, bytes) else c.encode() for c in iter(lambda: stdin.read(1 << 20) or None, None))
    chunks = as_bytes
    if o.compression != "none":
        chunks = inflated(Chunks(as_bytes), o.compression)
    try:
        written(target, chunks)
    except (OSError, EOFError, zlib.error, zstandard.ZstdError) as e:
        raise LoadError(f"standard input: {e}") from None
    return target


class Chunks:
    """Chunks as a file to read."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def read(self, n: int = -1) -> bytes:
        while n < 0 or len(self.held) < n:
            chunk = next(self.chunks, b"")
            if not chunk:
                break
            self.held += chunk
        out, self.held = (self.held, b"") if n < 0 else (self.held[:n], self.held[n:])
        return out
