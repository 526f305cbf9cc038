"""Helpers that several corpus operators share: the shared folder, batch handling and distributed ranking."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)

_own_dir: list[str] = []
#: Folders made in the shared folder that are still there.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where all run on one machine, and it is unset,
    a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="pipewright-"))
    return _own_dir[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name. What is in it when the program ends is removed, if nobody removed it before (see ``discard``)."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch folders that no plan reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _made.remove(path)


def made() -> list[str]:
    """The scratch folders there are, oldest first."""
    return list(_made)


@atexit.register
def _discard_all() -> None:
    for path in _made:
        try:
            system, name = fs.FileSystem.from_uri(path)
            system.delete_dir(name)
        except (OSError, ValueError):  # never made, or in a store that only Spark reaches
            pass


def materialise(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back. ``scratch_path`` of the result is its folder.

    Narrow rows are rebalanced first, so that a table has as many files as its size calls for, not as its tasks were;
    tables with texts are written where they are.
    """
    path = scratch(df.sparkSession, name)
    (df if texts else df.hint("rebalance")).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def source_key(df: DataFrame, source: str = "source") -> DataFrame:
    """Add ``_null`` and ``_src``, which group and join null sources like any other; null sorts last."""
    return df.withColumns({"_null": F.col(source).isNull(), "_src": F.coalesce(F.col(source).cast("string"), F.lit(""))})


def ranked(
    df: DataFrame, group: list[str], bucket: Column, buckets: int, order: list[str], size: str | None = None
) -> DataFrame:
    """Rank rows within groups without bringing a group together in one task.

    ``bucket`` cuts each group into at most ``buckets`` ranges that follow ``order``. Counts for each range (partly
    aggregated before the shuffle) give its offset, and a window numbers the rows inside a range. Adds ``_rank`` (from 0)
    and ``_rows`` (rows of the group); with ``size`` also ``_start`` (sizes of the rows before) and ``_total``.
    Rows equal in all of ``order`` are numbered arbitrarily.
    """
    df = df.withColumn("_bucket", F.least(F.lit(buckets - 1), bucket.cast("int")))
    sums = {"_n": F.count(F.lit(1)), **({"_s": F.sum(size)} if size else {})}
    stats = df.groupBy(*group, "_bucket").agg(*[c.alias(k) for k, c in sums.items()])
    over = Window.partitionBy(*group) if group else Window.partitionBy()
    before = over.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = stats.select(
        *group,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), zero).alias("_before"),
        F.sum("_n").over(over).alias("_rows"),
        *([F.coalesce(F.sum("_s").over(before), zero).alias("_sbefore"), F.sum("_s").over(over).alias("_total")] if size else []),
    )
    out = df.join(offsets, [*group, "_bucket"])
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    out = out.withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
    if size:
        running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("_start", F.col("_sbefore") + F.sum(size).over(running) - F.col(size)).drop("_sbefore")
    return out.drop("_bucket", "_before")


def hash_bucket(h: str, buckets: int) -> Column:
    """Which of ``buckets`` equal ranges a non-negative 63-bit hash falls into."""
    return F.shiftright(F.shiftright(F.col(h), 32) * F.lit(buckets).cast("long"), 31)
