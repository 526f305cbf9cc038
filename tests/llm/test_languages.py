import math
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from helpers import ODD, documents, frame

from pipewright.llm import languages


def saved(folder, *trees):
    """Files as ``train`` leaves them."""
    names = []
    for i, t in enumerate(trees):
        (folder / f"group-{i}").write_bytes(cloudpickle.dumps(t))
        names.append((folder / f"group-{i}").as_uri())
    return names


def learned(models):
    return sorted(k for t in languages.Models(models) for k in t.languages)


def brute_bits(train, text):
    """Code length by walking the contexts down, byte by byte."""
    stats = {}
    stream = b"".join(b"\n" * 3 + t for t in train)
    for order in range(4):
        for i in range(order, len(stream)):
            after = stats.setdefault(stream[i - order : i], {})
            after[stream[i]] = after.get(stream[i], 0) + 1
    whole, bits = b"\n" * 3 + text, 0.0
    for i in range(3, len(whole)):
        for order in (3, 2, 1, 0):
            after = stats.get(whole[i - order : i])
            if not after:
                continue
            total, distinct = sum(after.values()), len(after)
            if whole[i] in after:
                bits += math.log2((total + distinct) / after[whole[i]])
                break
            bits += math.log2((total + distinct) / distinct)
        else:
            bits += 8
    return bits


TRAIN = {"x": [b"abracadabra", b"", b"banana band"], "y": ["ünd öde".encode(), b"zzz"], "z": [b"a"]}
TEXTS = [b"", b"a", b"abra band", "öde ÿ".encode(), b"\xff\xfe\x00", b"zzzzzz" * 50, b"banana " * 40]


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_code_lengths(monkeypatch, block):
    monkeypatch.setattr(languages, "BLOCK", block)
    trees = languages.Trees(TRAIN)
    got = trees.score(TEXTS)
    want = [[brute_bits(TRAIN[k], t) for k in trees.languages] for t in TEXTS]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


@pytest.mark.parametrize("held", [0, 1 << 28])
@pytest.mark.parametrize("together", [True, False])
def test_frame(spark, tmp_path, monkeypatch, together, held):
    monkeypatch.setattr(languages, "HELD_BYTES", held)
    texts = {"en": [b"the cat and the dog sat on the mat " * 5], "de": ["der hund und die katze sind im haus ".encode() * 5]}
    whole = languages.Trees(texts)
    trees = saved(tmp_path, *([whole] if together else [languages.Trees({k: v}) for k, v in texts.items()]))
    rows = [*ODD, (40, "the dog and the cat"), (41, "der hund und das haus"), (42, "12345 ½ ²"), (43, "...")]
    got = {(r["doc_id"], r["text"]): r for r in languages.identify(frame(spark, rows).withColumnRenamed("source", "score"), trees).collect()}
    for r in got.values():
        assert r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    for text in ("the dog and the cat", "word " * 30000):  # the posterior over both groups
        bits = whole.score([text.encode()])[0]
        row = next(r for (_, t), r in got.items() if t == text)
        assert row["lang_pred"] == whole.languages[bits.argmin()] and math.isclose(row["score"], 1 / (2.0 ** (bits.min() - bits)).sum(), rel_tol=1e-6)
    assert got[40, rows[-4][1]]["lang_pred"] == "en" and got[41, rows[-3][1]]["lang_pred"] == "de"
    assert languages.identify(frame(spark, []), trees).collect() == []


def test_nothing_learned(spark):
    trees = languages.train(frame(spark, [(1, "text", None), (2, None, "en"), (3, "", None)]))
    assert {r["lang_pred"] for r in languages.identify(frame(spark, ODD), trees).collect()} == {"und"}


def test_only_training_rows_teach(spark):
    rows = [(i, f"text of {i}", "en" if zlib.crc32(str(i).encode()) % 4 != 2 else "xx") for i in range(200)]
    assert learned(languages.train(frame(spark, rows))) == ["en"]


def test_every_language_is_learned(spark):
    rows = [(i, f"w{i % 70} " * (9000 if i % 70 == 3 else 20), f"l{i % 70}") for i in range(700)]  # one language has long texts only
    models = languages.train(frame(spark, rows))
    assert len(models) > 5 and learned(models) == sorted({r[2] for r in rows})
    got = {r["doc_id"]: r["lang_pred"] for r in languages.identify(frame(spark, rows), models).collect()}
    assert sum(got[i] == k for i, _, k in rows) > 0.9 * len(rows)


def test_equal_rows_are_no_sample(spark):
    rows = [(None, "the same", "en")] * 3000 + [(i, f"text {i}", "en") for i in range(100)]
    got = languages.sample(frame(spark, rows), "doc_id", "text", "lang").collect()
    assert 60 < len(got) <= 101 and len({r["h"] for r in got}) == len(got)


def test_sparse_levels(monkeypatch):
    want = languages.Trees(TRAIN).score(TEXTS)
    monkeypatch.setattr(languages, "DENSE", 1)
    assert (languages.Trees(TRAIN).score(TEXTS) == want).all()


def test_text_column_named_like_an_output(spark, tmp_path):
    trees = saved(tmp_path, languages.Trees({"en": [b"the cat"]}))
    docs = frame(spark, [(1, "the cat", None)]).withColumnRenamed("text", "score")
    assert [(r["lang_pred"], r["score"] > 0) for r in languages.identify(docs, trees, text="score").collect()] == [("en", True)]


@pytest.mark.parametrize("thinned", [10_000, 1])
def test_sample_is_bounded(spark, monkeypatch, thinned):
    monkeypatch.setattr(languages, "TRAIN_TEXTS", 20)
    monkeypatch.setattr(languages, "THINNED", thinned)
    rows = [(i, f"text {i}", "en" if i % 10 else "de") for i in range(3000)]
    got = languages.sample(frame(spark, rows), "doc_id", "text", "lang").collect()
    assert {k: sum(r["lang"] == k for r in got) for k in ("en", "de")} == {"en": 20, "de": 20}


def test_held_out_accuracy(spark):
    rows = languages.op10_identify_languages(spark, "/root/testdata/sf0.01").collect()
    lang = {i: k for i, _, k, _ in documents("/root/testdata/sf0.01")}
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    out = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert len(out) > 100 and sum(out) / len(out) > 0.98
