"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a seeded hash and laid end to end as a stream of words, cut into blocks of equal
words. Slots are van der Corput points: slot ``i`` of ``2**m`` lies at the bit reversal of ``i``, which the cumulative
number of blocks that the sources need maps to a source. Slots are ranked within their source, and the slot of rank ``k``
takes block ``k`` (a second pass over a source goes on where the first ends; the last block is trimmed to the target).
So every stretch of the schedule holds the sources near their weights, and each source gives its target to the word.
DataFrame operations only; streams, ranks and slots are built in ranges, so one large source is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, hash_bucket, materialise, partitions, ranked, source_key, table

KEY = ["_null", "_src"]


def n_words(c):
    return F.coalesce(F.regexp_count(c, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def places(sources: DataFrame) -> DataFrame:
    """Add ``_place``, the number of each source in code point order, null last, without bringing them together: they are sorted by
    range and written, and the sizes of the ranges number them."""
    spark = sources.sparkSession
    rows = sources.orderBy(*KEY).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    rows = materialise(rows, "mix-sources", texts=True)  # as they lie
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    known = sizes.select("_part", before.alias("_before"))
    place = F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_before")
    return rows.join(known, "_part").withColumn("_place", place).drop("_part", "_id", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Targets of the sources in ``sizes`` (one row for each: the key columns and ``_size``).

    Sources in code point order, null last, take the weights in turn and share ``share`` times all sizes. No target goes
    over ``most`` times its source's size; the excess goes to the others by weight: those that a level times their weight would
    fill are full, the rest get level times weight. Filling some raises the level, which may fill more; each round is one
    aggregation, and it ends when no source is filled any more. Sources without words get 0.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    df = places(sizes).withColumn("_w", F.element_at(turn, (F.col("_place") % len(weights) + 1).cast("int")))
    full = F.lit(float(most)) * F.col("_size")
    level = 0.0
    while True:
        open_ = F.col("_w") * F.lit(level) < full
        row = df.agg(F.sum("_size"), F.sum(F.when(~open_, full)), F.sum(F.when(open_, F.col("_w")))).first()
        left = share * (row[0] or 0) - (row[1] or 0.0)
        raised = left / row[2] if row[2] and left > 0 else level
        if raised <= level:
            return df.withColumn("target", F.when(open_, F.col("_w") * F.lit(level)).otherwise(full)).drop("_w")
        level = raised


def bit_reversed(i, bits: int):
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """The slots: the key columns, ``_k`` (block of the source's stream) and ``slot`` (place in the schedule, with gaps).

    ``sources``: the key columns, ``target`` and, if at hand, ``_place``. Each source owns as many grid points as its target has blocks.
    """
    spark = sources.sparkSession
    sources = sources if "_place" in sources.columns else places(sources)
    need = sources.select(*KEY, "_place", F.ceil(F.floor("target") / block).cast("long").alias("_q")).where("_q > 0")
    total = need.agg(F.sum("_q")).first()[0] or 0
    bits = max(1, int(total - 1).bit_length()) if total else 1
    chunk = 4096
    need = need.withColumn("_range", F.expr(f"_place div {chunk}"))  # many sources are added up range by range
    sums = need.groupBy("_range").agg(F.sum("_q").alias("_sum"))
    sums = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_q").over(Window.partitionBy("_range").orderBy("_place")) - F.col("_q")
    chunks = need.join(sums, "_range").withColumn("_first", F.col("_before") + inside).withColumn("_c", F.explode(F.expr(f"sequence(0L, (_q - 1) div {chunk})")))
    chunks = chunks.repartition(partitions(spark), *KEY, "_c")
    points = chunks.select(
        *KEY, F.explode(F.expr(f"sequence(_first + _c * {chunk}, _first + least(_q, (_c + 1) * {chunk}) - 1)")).alias("_j")
    )
    points = points.withColumn("slot", bit_reversed(F.col("_j"), bits)).drop("_j")
    buckets = 4 * partitions(spark)
    at = F.expr(f"cast(slot as double) * {buckets} / {2**bits}D")
    return ranked(points, KEY, F.floor(at), buckets, ["slot"]).select(*KEY, F.col("_rank").alias("_k"), "slot")


def mix(
    df: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 2048,
    seed: int = 11,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    size: str | None = None,
) -> DataFrame:
    """Add ``size`` (words), ``source_size``, ``target``, ``taken`` (words that the mix takes, repeats counted) and
    ``first_slot`` (null if none is taken) to each row.

    ``size`` names a column that holds the words already. A document is taken at most ``most`` times over; the last
    one of a source may be taken in part. Null texts and texts without words have size 0 and are never taken. Rows equal
    in key and size are interchangeable. Other columns pass through; columns of the names above are replaced; names
    beginning with ``_`` are reserved. An empty table stays empty.
    """
    spark = df.sparkSession
    words = F.col(size) if size else n_words(F.col(text))
    df = source_key(df.withColumn("_words", words), source)
    df = df.drop("size", "source_size", "target", "taken", "first_slot").withColumnRenamed("_words", "size")
    apart = F.when(F.col(key).isNull(), F.monotonically_increasing_id())  # or all of them would have one place in the shuffle
    df = df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col("size"), apart), 1))
    goals = targets(df.groupBy(*KEY).agg(F.sum("size").alias("_size")), weights, share, most)
    slots = schedule(goals, block)
    goals = goals.select(*KEY, F.col("_size").alias("source_size"), "target", F.floor("target").alias("_goal"))
    buckets = 4 * partitions(spark)
    streams = ranked(df, KEY, hash_bucket("_h", buckets), buckets, ["_h", key, "size"], "size").drop("_rows", "_h")
    streams = materialise(streams, "mix-streams")  # read twice
    narrow = streams.select(*KEY, "_rank", "size", "_start", "_total").join(goals.select(*KEY, "_goal"), KEY)
    passes = narrow.withColumn("_pass", F.explode(F.expr(f"sequence(0, {int(-(-most // 1)) - 1})")))
    passes = passes.withColumns({"_from": F.expr("_start + _pass * _total"), "_to": F.expr("least(_goal, _start + _pass * _total + size)")})
    pieces = passes.where("_from < _to").withColumn("_k", F.explode(F.expr(f"sequence(_from div {block}, (_to - 1) div {block})")))
    taken = F.expr(f"least(_to, (_k + 1) * {block}) - greatest(_from, _k * {block})")
    pieces = pieces.select(*KEY, "_rank", "_k", taken.alias("_taken")).join(slots.hint("merge"), [*KEY, "_k"])  # both grow with the input
    got = pieces.groupBy(*KEY, "_rank").agg(F.sum("_taken").alias("taken"), F.min("slot").alias("first_slot"))
    out = streams.drop("_start", "_total").join(got.hint("merge"), [*KEY, "_rank"], "left").join(goals.drop("_goal"), KEY)
    return out.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop(*KEY, "_rank")


def draw(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` as often as ``mix`` takes them, in whole documents: taken over size, halves rounded up.

    Only keys, sources and sizes go through the mix; the rows themselves are shuffled once, to meet their number of copies.
    """
    columns = df.columns
    words = n_words(F.col(options.get("text", "text")))
    rows = materialise(df.select("*", words.alias("_n"), F.monotonically_increasing_id().alias("_row")), "mix", texts=True)  # fixes the numbers
    narrow = rows.select("_row", *dict.fromkeys([options.get("source", "source"), options.get("key", "doc_id")]), "_n")
    copies = F.expr("case when taken > 0 then cast(floor(taken / size + 0.5D) as int) else 0 end").alias("_copies")
    drawn = mix(narrow, size="_n", **options).select("_row", copies).where("_copies > 0")
    out = rows.join(drawn, "_row").withColumn("_copy", F.explode(F.expr("sequence(1, _copies)")))
    return out.select(*columns)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed at 5, 2, 1 in turn to 150 % of their words, no source over twice its size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("_n"))
    docs = materialise(docs, "mix")  # counting words costs most, so it is done once
    return mix(docs, size="_n").select("doc_id", "size", "source_size", "target", "taken", "first_slot")
