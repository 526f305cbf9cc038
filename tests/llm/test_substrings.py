import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, documents, frame

from pipewright.llm import substrings


def brute(texts, length=substrings.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), int((runs == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def result(df, **options):
    rows = substrings.deduplicate(df, **options).collect()
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


def expected(rows):
    return sorted((r[0] is not None, r[0] or 0, *b) for r, b in zip(rows, brute([r[1] for r in rows]), strict=True))


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(150):
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8))]
        text = np.frombuffer(bytes(7).join(segments) + bytes(7), np.uint8)
        sizes = np.array([len(s) for s in segments])
        starts = np.cumsum(sizes + 7) - (sizes + 7)
        left = np.maximum(0, np.repeat(starts + sizes, sizes + 7) - np.arange(len(text)))
        suffix = lambda i: text.tobytes()[i : i + left[i]]  # noqa: B023, E731
        want = sorted(np.flatnonzero(left).tolist(), key=lambda i: (suffix(i), i))
        got = substrings.suffix_array(text, left)
        assert got.tolist() == want
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert substrings.common_prefixes(text, left, got).tolist() == [0] + [common(suffix(a), suffix(b)) for a, b in zip(want, want[1:], strict=False)]


def planted(seed):
    """Passages in changing places, near copies, runs of one byte, and text longer than a piece."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 50)), rng.choice(passages), text(rng.randrange(0, 30)), rng.choice([*passages, ""])]
        if rng.random() < 0.3:
            parts[1] = parts[1][rng.randrange(0, 40) :]
        rows.append((i, " ".join(parts)))
    base = text(120).split(" ")
    for i in range(30):
        near = list(base)
        near[rng.randrange(120)] = word()
        rows.append((100 + i, " ".join(near)))
    rows += [(200, "z" * 700), (201, "q" + "z" * 200), (202, "z" * 199), (203, "ab" * 300), (204, "x" + "ba" * 150), (205, passages[0][:199]), (206, passages[0][:200])]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (301, rows[0][1]), (None, rows[1][1]), (400, text(4000)), (401, rows[3][1] + text(3000))]
    return rows


@pytest.mark.parametrize("large, block, piece, shard", [(512, 4 << 20, 1 << 20, 192 << 10), (1, 4096, 1024, 2000)])
def test_planted(spark, monkeypatch, large, block, piece, shard):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "PIECE_BYTES", piece)
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard)
    rows = planted(large)
    assert result(frame(spark, rows).repartition(3), large=large) == expected(rows)


def test_odd_and_empty(spark):
    assert result(frame(spark, ODD).withColumnRenamed("lang", "row").withColumnRenamed("source", "hash")) == expected(ODD)
    assert substrings.deduplicate(frame(spark, [])).collect() == []


def test_query(spark, data):
    docs = documents(data)
    want = dict(zip([i for i, *_ in docs], brute([t for _, t, *_ in docs]), strict=True))
    rows = substrings.op8_substring_dedup(spark, data).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
    assert sum(r["n_removed"] > 0 for r in rows) > 10
