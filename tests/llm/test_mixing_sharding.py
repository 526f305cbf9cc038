import math
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import ODD, documents, frame, words
from pyspark.sql import functions as F

from pipewright.llm import mixing, sharding
from pipewright.llm.common import ranked


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing until none is over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: most * sizes[s] for s in over}


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for _, text, _, source in docs:
        sizes[source] += len(words(text))
    target, taken = water(sizes), defaultdict(int)
    of = Counter()
    for r in rows:
        source = r["source"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(target[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["first_slot"] is None) == (r["taken"] == 0)
        taken[source] += r["taken"]
        of[source] += 1
    for s, n in taken.items():
        assert math.floor(target[s] + 1e-6) - 1 <= n <= target[s] + 1e-6


def test_mix(spark, data):
    docs = documents(data)
    df = spark.read.parquet(f"{data}/documents.parquet").withColumn("target", F.lit("clash"))
    first = mixing.mix(df, block=64).collect()
    check_mix(first, docs)
    again = mixing.mix(df.repartition(7), block=64).collect()
    key = lambda rows: sorted((r["doc_id"], r["taken"], r["first_slot"] or -1) for r in rows)
    assert key(first) == key(again)


def test_mix_odd(spark):
    check_mix(mixing.mix(frame(spark, ODD), block=128).collect(), ODD)
    assert mixing.mix(frame(spark, [])).collect() == []
    nothing = mixing.mix(frame(spark, [(1, None), (2, "", None, "a")])).collect()
    assert [r["taken"] for r in nothing] == [0, 0] and [r["target"] for r in nothing] == [0, 0]


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([(False, "a", 5000.0), (False, "b", 2000.0), (True, "", 1000.0)], "_null boolean, _src string, target double")
    slots = mixing.schedule(sources, 10).orderBy("slot").collect()
    assert Counter(s["_src"] for s in slots) == {"a": 500, "b": 200, "": 100}
    for source, n in (("a", 500), ("b", 200), ("", 100)):
        own = [s["_k"] for s in slots if s["_src"] == source]
        assert own == list(range(n))
        for end in (80, 160, 400, 640):
            got = sum(s["_src"] == source for s in slots[:end])
            assert abs(got - end * n / 800) < 8


def test_draw(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mixed = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    copies = Counter(r["doc_id"] for r in drawn.collect())
    for i, r in mixed.items():
        assert copies[i] == (math.floor(r["taken"] / r["size"] + 0.5) if r["taken"] else 0)
    assert mixing.draw(frame(spark, [])).collect() == []


def check_shards(rows, n=8):
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    counts = [len(shards[k]) for k in range(n)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total = Counter(r["source"] for r in rows)
    for own in shards.values():
        have = Counter(r["source"] for r in own)
        for source, m in total.items():
            assert abs(have[source] - m * len(own) / len(rows)) <= 3
    return shards


def test_shards(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").withColumn("slot", F.lit("clash"))
    rows = sharding.interleave(df, 8).collect()
    check_shards(rows)
    again = sharding.interleave(df.repartition(5), 8).collect()
    key = lambda rows: sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)
    assert key(rows) == key(again)


def test_shards_odd(spark):
    assert sharding.interleave(frame(spark, []), 8).collect() == []
    check_shards(sharding.interleave(frame(spark, ODD), 3).collect(), 3)
    alone = frame(spark, [(i, "x", None, f"s{i}") for i in range(100)])
    rows = sharding.interleave(alone, 8).collect()
    assert Counter(Counter(r["shard"] for r in rows).values()) == {12: 4, 13: 4}
    assert sharding.interleave(frame(spark, [(1, "x")]), 8).collect()[0]["slot"] == 0


def test_shard_query(spark, data):
    texts = {i: t for i, t, *_ in documents(data)}
    rows = sharding.op5_shard_documents(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_mix_query(spark, data):
    rows = mixing.op6_mix_sources(spark, data).collect()
    source = {i: s for i, _, _, s in documents(data)}
    from pyspark.sql import Row

    check_mix([Row(**r.asDict(), source=source[r["doc_id"]]) for r in rows], documents(data))


def test_native_plans(spark, data):
    for df in (mixing.op6_mix_sources(spark, data), sharding.op5_shard_documents(spark, data)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_ranked_with_repeated_order_keys(spark):
    df = spark.createDataFrame([("a", i // 3, 2) for i in range(30)] + [("b", 5, 1)], "g string, k long, s long")
    rows = ranked(df, ["g"], F.col("k") * 4 / 10, 4, ["k"], "s").orderBy("g", "_rank").collect()
    assert [r["_rank"] for r in rows] == [*range(30), 0]
    assert [r["_start"] for r in rows[:30]] == [2 * i for i in range(30)] and rows[0]["_total"] == 60 and rows[0]["_rows"] == 30
