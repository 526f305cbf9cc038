"""Finding files. Local patterns follow the shell, with ``**`` and braces; other file systems go through Hadoop's globbing."""

from __future__ import annotations

import glob
import os
import re
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LoadError
from ..plans.names import has_glob


def braces(pattern: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [x for option in m[1].split(",") for x in braces(pattern[: m.start()] + option + pattern[m.end() :])]


def hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remote(path: str) -> bool:
    return "://" in path


def expand(spark: SparkSession, path: str, base: str | None = None) -> list[str]:
    """The files (or data directories) that a path names, in order of their names."""
    if remote(path):
        p, system = hadoop(spark, path)
        found = system.globStatus(p)
        if found is None or not len(found):
            raise LoadError(f"no such file: {path}")
        return sorted(str(x.getPath()) for x in found)
    full = os.path.join(base, path) if base else os.path.abspath(path)
    if not has_glob(path):
        if not os.path.exists(full):
            raise LoadError(f"no such file: {path}")
        return [full]
    found = sorted({x for one in braces(full) for x in glob.glob(one.replace("[", "[[]"), recursive=True) if os.path.isfile(x)})
    if not found:
        raise LoadError(f"no file matches {path}")
    return found


def is_directory(spark: SparkSession, path: str) -> bool:
    if not remote(path):
        return os.path.isdir(path)
    p, system = hadoop(spark, path)
    return system.getFileStatus(p).isDirectory()


#: Suffixes that Spark's readers unpack and Hadoop's codecs may not, without native libraries.
UNPACKED = {".zst": "zstd", ".gz": "gzip"}
CODECS = {".bz2", ".deflate", ".lz4", ".snappy"}


def beginning(spark: SparkSession, path: str, n: int) -> tuple[bytes, bool]:
    """Up to ``n`` first bytes of a file, unpacked as Spark would, and whether they are all of it; of a folder, its first file's."""
    p, system = hadoop(spark, path)
    if system.getFileStatus(p).isDirectory():
        inside = sorted(str(x.getPath()) for x in system.listStatus(p) if not x.getPath().getName().startswith(("_", ".")))
        return beginning(spark, inside[0], n) if inside else (b"", True)
    sc, suffix = spark.sparkContext, os.path.splitext(path)[1].lower()
    unpacked = UNPACKED.get(suffix)
    codec = None if suffix not in CODECS else sc._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(sc._jsc.hadoopConfiguration()).getCodec(p)
    stream = system.open(p)
    try:
        stream = codec.createInputStream(stream) if codec is not None else stream
        if unpacked:
            from .options import Chunks, inflated

            data = b""
            try:
                for chunk in inflated(Chunks(iter(lambda: bytes(stream.readNBytes(1 << 16)) or None, None)), unpacked):
                    data += chunk
                    if len(data) >= n:
                        break
            except (OSError, EOFError, zlib.error, zstandard.ZstdError) as e:
                raise LoadError(f"{path}: {e}") from None
            data = data[:n]
        else:
            data = bytes(stream.readNBytes(n))
    finally:
        stream.close()
    return data, len(data) < n


def beginnings(spark: SparkSession, paths: list[str], n: int = 1 << 16) -> list[tuple[bytes, bool]]:
    """Of many files, without a job. Plain files of a local path are opened here: the JVM takes several calls for each."""
    here = hadoop(spark, "/")[1].getUri().getScheme() == "file"

    def look(path: str) -> tuple[bytes, bool]:
        if here and os.path.isabs(path) and os.path.splitext(path)[1].lower() not in {*UNPACKED, *CODECS} and os.path.isfile(path):
            with open(path, "rb") as file:
                data = file.read(n)
            return data, len(data) < n
        return beginning(spark, path, n)

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(look, paths))


def lengths(spark: SparkSession, paths: list[str]) -> list[int | None]:
    """Bytes of each file; None for a folder."""
    def length(path: str) -> int | None:
        if os.path.isabs(path):  # else a URI, as a pattern's are
            return None if os.path.isdir(path) else os.path.getsize(path)
        p, system = hadoop(spark, path)
        status = system.getFileStatus(p)
        return None if status.isDirectory() else status.getLen()

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(length, paths))


def last_byte(spark: SparkSession, path: str, size: int) -> bytes:
    p, system = hadoop(spark, path)
    stream = system.open(p)
    try:
        stream.seek(max(0, size - 1))
        return bytes(stream.readNBytes(1))
    finally:
        stream.close()


def origin() -> Column:
    """The file that a row of a scan is from, under its plain name: names sort as the paths of a pattern do."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def location() -> Column:
    """The file that a row of a scan is from, as a URI, which costs nothing for a row."""
    return F.col("_metadata.file_path")


def decoded(uri: str) -> str:
    """What ``origin`` gives for a ``location``."""
    return unquote(uri)


def named(spark: SparkSession, path: str) -> str:
    """A path with its file system, as ``and_above`` writes it."""
    p, system = hadoop(spark, path)
    return and_above(str(system.makeQualified(p)))[0]


def and_above(path: str) -> list[str]:
    """A file as ``origin`` names it, and the folders it is in."""
    path = re.sub("^file:/+", "file:/", path).rstrip("/")
    return [path, *[path[: m.start()] for m in re.finditer("/+", path) if m.start() > 0]]


#: Tasks of a scan of many files: so many for each core, or one for so many bytes if those are more.
TASKS, TASK_BYTES = 16, 1 << 26


def scan(spark: SparkSession, read: Callable[[], DataFrame], *columns: Column | str) -> DataFrame:
    """Columns of a read of many files. Spark lists them in a job with a task for each path, and reads a few small files in a
    task; some tasks for each core do. Row ids among the columns are made before tasks are joined, so they rise within a file."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, cores = spark.conf.get(key), spark.sparkContext.defaultParallelism
    spark.conf.set(key, str(min(int(before), 4 * cores)))
    try:
        df = read()
    finally:
        spark.conf.set(key, before)
    out, plan = df.select(*columns), df._jdf.queryExecution().optimizedPlan()
    tasks = max(TASKS * cores, int(str(plan.stats().sizeInBytes())) // TASK_BYTES)
    return out if len(df._jdf.inputFiles()) <= tasks else out.coalesce(tasks)
