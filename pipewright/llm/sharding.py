"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; the fractional rank ``(rank + u) / rows of the source``
(``u``: a fixed offset for each source) orders all rows, so any stretch of that order holds every source in proportion.
Cutting it into equal stretches gives shards whose row counts differ by one at most and whose mixtures match the corpus.
DataFrame operations only; ranks are taken in ranges (see ``ranked``), so a source with most rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_bucket, partitions, ranked, source_key, table


def interleave(df: DataFrame, shards: int, seed: int = 7, source: str = "source", key: str = "doc_id", text: str = "text", crc: str | None = None) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard) to each row.

    The order depends on seed, key, source and the text's checksum only. Null sources form one stratum; null keys and
    texts take part (``crc`` names a column that holds the checksum already); rows equal in key and checksum are interchangeable. An empty table stays empty. Other columns
    pass through; columns named ``shard`` or ``slot`` are replaced; names beginning with ``_`` are reserved.
    """
    buckets = 4 * partitions(df.sparkSession)
    df = source_key(df.drop("shard", "slot"), source)
    df = df.withColumn("_crc", F.col(crc) if crc else F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    apart = F.when(F.col(key).isNull(), F.monotonically_increasing_id())  # or copies without a key would all be in one range
    df = df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col("_crc"), apart), 1))
    one = ranked(df, ["_null", "_src"], hash_bucket("_h", buckets), buckets, ["_h", key, "_crc"])
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "_null", "_src"), 33) / F.lit(float(2**31))
    one = one.withColumn("_at", (F.col("_rank") + offset) / F.col("_rows")).withColumnRenamed("_rank", "_within").drop("_rows")
    two = ranked(one, [], F.floor(F.col("_at") * buckets), buckets, ["_at", "_null", "_src", "_within"])
    shard = F.expr(f"(_rank * {shards}) div _rows")
    first = F.expr(f"(((_rank * {shards}) div _rows) * _rows + {shards - 1}) div {shards}")
    out = two.withColumns({"shard": shard.cast("int"), "slot": F.col("_rank") - first})
    return out.drop("_null", "_src", "_crc", "_h", "_within", "_at", "_rows", "_rank")


def op5_shard_documents(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents in 8 shards under the law ``rows``; nulls: size 1, the checksum of no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleave(docs, shards, crc="text_crc32").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
