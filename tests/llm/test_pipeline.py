import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pipewright.llm import quality

pipeline = pytest.importorskip("corpus_pipeline")


def near_duplicates(docs):
    """The first document of each component of both kinds of links, pair by pair."""
    from test_simhash import brute_print, shingles

    prints = np.array([brute_print(d[1]) for d in docs], np.uint64)
    sets = [shingles(d[1]) for d in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        near = np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= 4
        alike = [len(sets[i] & x) >= 0.8 * len(sets[i] | x) for x in sets[i + 1 :]]
        for j in np.flatnonzero(near | np.array(alike, bool)) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [d for i, d in enumerate(docs) if root(i) == i]


def surviving(data):
    """Documents after the three filtering stages, by brute force."""
    from test_decontaminate import brute as contaminated

    docs = duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{data}/documents.parquet' order by doc_id").fetchall()
    features = np.array([quality.features(d[1]) for d in docs])
    con = duckdb.connect()
    con.register("f", __import__("pandas").DataFrame(features, columns=quality.FEATURES))
    votes = np.array(con.sql("select " + ", ".join(f"coalesce({v}, -1)" for v in quality.VOTES.values()) + " from f").fetchall())
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good = quality.fit(patterns, counts.astype(float))["posterior"][index.ravel()] >= 0.5
    n, repeated = features[:, 0], features[:, 4]
    docs = [d for d, k in zip(docs, good & (n >= 50) & (100 * repeated <= 50 * n), strict=True) if k]
    docs = near_duplicates(docs)
    items = duckdb.sql(f"select item_id, text from '{data}/benchmark.parquet'").fetchall()
    return [d for d, (_, hit, _) in zip(docs, contaminated([d[1] for d in docs], items), strict=True) if not hit]


def test_run(spark, data):
    from helpers import words
    from test_mixing_sharding import check_shards, water

    kept = {d[0]: d for d in surviving(data)}
    rows = pipeline.run(spark, data).collect()
    copies = Counter(r["doc_id"] for r in rows)
    assert set(copies) <= set(kept) and max(copies.values()) <= 2
    for r in rows:
        assert (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) == kept[r["doc_id"]]
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, text, _, source, _ in kept.values():
        n = len(words(text))
        sizes[source] += n
        taken[source] += n * copies[i]
        longest[source] = max(longest[source], n)
    for source, target in water(sizes).items():
        assert math.fabs(taken[source] - target) <= longest[source] + 1
    check_shards(rows)


def test_stages_keep_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, data).collect() == []
