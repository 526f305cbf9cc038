import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from helpers import LOWER, ODD, documents, frame

from pipewright.llm import decontaminate


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = defaultdict(set)
    for k, text in items:
        w = tokens(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add("null" if k is None else str(k))
    out = []
    for text in docs:
        w, hit, found = tokens(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Short one"), (3, None), (4, " .,! "), (5, "a a a a a a a a a a a a"), (None, "no id here"), (6, "Short one"), (7, "É日 x"), (11, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")]
TEXTS = [
    None, "", LONG, "x " + LONG.upper() + " y", "w0 " + " ".join(f"w{i}" for i in range(5, 14)), " ".join(f"w{i}" for i in range(5, 15)) + " w1", "short ONE short one",
    "short", "a " * 9, "a " * 10, "a " * 25, "é日 x", "É日-X", "no.id-here", "w39 " + " ".join(f"w{i}" for i in range(30, 40)), "the short\none" + " filler" * 50, "one short",
]


@pytest.mark.parametrize("words, block", [(1 << 20, 16 << 20), (5, 40)])
def test_small(spark, monkeypatch, words, block):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 6 * words)
    monkeypatch.setattr(decontaminate, "CANDIDATES", 3 if words == 5 else 1 << 21)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = frame(spark, [(i, t, "clash", "s") for i, t in enumerate(TEXTS)]).withColumnRenamed("lang", "items")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.mark(docs, bench).collect()}
    want = brute(TEXTS, ITEMS)
    assert [got[i] for i in range(len(TEXTS))] == want
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i, (_, hit, _) in enumerate(want) if not hit]


def test_postings():
    texts = [b"", b"B a  b", b"...", "é1 a".encode(), b" a"]
    shard, words = decontaminate.postings(texts)
    assert words.tolist() == [0, 3, 0, 2, 1]
    gap = decontaminate.GAP
    got = {t: np.cumsum(p).tolist() for t, p in zip(shard["term"].to_pylist(), shard["positions"].to_pylist(), strict=True)}
    assert got == {b"b": [gap, gap + 2], b"a": [gap + 1, 3 * gap + 4, 4 * gap + 5], "é1".encode(): [3 * gap + 3]}
    assert decontaminate.postings([b"", b" "])[0].num_rows == 0


def test_text_column_named_like_an_output(spark):
    docs = frame(spark, list(enumerate(TEXTS))).withColumnRenamed("text", "items")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.mark(docs, bench, text="items").collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS, ITEMS)


def test_proximity(spark):
    window = [f"w{i}" for i in range(10)]
    shuffled = " ".join(reversed(window))
    spread = " ".join(window[:5]) + " x x x x " + " ".join(window[5:])
    too_far = " ".join(window[:5]) + " x x x x x " + " ".join(window[5:])
    lacking = " ".join(window[:9]) + " x x x"
    docs = frame(spark, list(enumerate([shuffled, spread, too_far, lacking, " ".join(window)])))
    bench = spark.createDataFrame([(1, " ".join(window))], "item_id long, text string")
    got = {r["doc_id"]: (r["items"], r["near_items"]) for r in decontaminate.mark(docs, bench, slop=4).collect()}
    assert got == {0: ([], ["1"]), 1: ([], ["1"]), 2: ([], []), 3: ([], []), 4: (["1"], ["1"])}
    assert all(r["near_items"] == [] for r in decontaminate.mark(docs, bench, slop=None).collect())


def test_odd_and_empty(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.mark(frame(spark, ODD), bench).collect()
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted(brute([t for _, t, *_ in ODD], ITEMS))
    assert decontaminate.mark(frame(spark, []), bench).collect() == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 and r["items"] == [] for r in decontaminate.mark(frame(spark, ODD), nothing).collect())


def test_query(spark, data):
    docs, items = documents(data), duckdb.sql(f"select item_id, text from '{data}/benchmark.parquet'").fetchall()
    want = dict(zip([i for i, *_ in docs], brute([t for _, t, *_ in docs], items), strict=True))
    rows = decontaminate.op7_decontaminate(spark, data).collect()
    assert len(rows) == len(docs) and any(r["contaminated"] for r in rows)
    for r in rows:
        n, hit, found = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r["n_near_items"] >= 0
