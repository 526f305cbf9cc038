import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import ODD, documents, frame, words

from pipewright.llm import quality


def brute(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated)


TEXTS = [None, "", " ", "a", "a a a", "a a a a", "a b c a b c", "x y\nx y\n\n \nx y ", "a#b *|<>&%$ c\v\f\r d", "é\u00a0è ü\u2003ö", "p q r s p q r t p q"]


def test_features():
    for text in TEXTS:
        assert quality.features(text)[:5] == brute(text), text


def test_documents(spark, data):
    texts = {i: t for i, t, *_ in documents(data)}
    for r in quality.op4_quality_rules(spark, data).collect():
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_verdicts_against_labels():
    """What labels call bad goes, what they call good stays (but for the base rules)."""
    rows = duckdb.sql("select text, quality from '/root/testdata/sf0.01/documents.parquet' join '/root/testdata/sf0.01/labels.parquet' using (doc_id)").fetchall()
    table = np.array([quality.features(t) for t, _ in rows])
    con = duckdb.connect()
    con.register("f", __import__("pandas").DataFrame(table, columns=quality.FEATURES))
    votes = np.array(con.sql("select " + ", ".join(f"coalesce({v}, -1)" for v in quality.VOTES.values()) + " from f").fetchall())
    failed = np.array(con.sql(f"select {quality.BASE_FAILED} from f").fetchall())[:, 0]
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    kept = quality.fit(patterns, counts.astype(float))["posterior"][index.ravel()] >= 0.5
    label = np.array([q for _, q in rows])
    assert kept[(label == 1) & ~failed].mean() > 0.99
    assert kept[(label == 0) & ~failed].mean() < 0.05


def test_fit_recovers_planted_accuracies():
    rng = np.random.default_rng(3)
    rules, n = 5, 40_000
    kind = np.where(rng.random(n) < 0.2, rng.integers(0, rules, n), rules)
    bad = rng.random((n, rules)) < np.where(kind[:, None] == np.arange(rules), 0.85, 0.005)
    votes = np.where(rng.random((n, rules)) < 0.2, -1, 1 - bad)
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.fit(patterns, counts.astype(float))
    good = model["posterior"][index.ravel()] >= 0.5
    assert abs(model["share"][-1] - 0.8) < 0.1
    assert good[kind == rules].mean() > 0.9
    assert good[(kind < rules) & (votes == 0).any(1)].mean() < 0.4


def em(patterns, counts, rounds=300):
    """The same model, a class, rule and vote at a time."""
    rules = len(patterns[0])
    total = float(sum(counts))
    prior = []
    for c in range(rules + 1):
        prior.append([])
        for r in range(rules):
            seen = [sum(n for p, n in zip(patterns, counts) if p[r] == v) + 1e-3 * max(1.0, total) for v in (0, 1)]
            bad = seen[0] / sum(seen)
            if c == r:
                bad = 0.8
            elif c == rules:
                bad = bad * 0.2 / (bad * 0.2 + 1 - bad)
            prior[-1].append([bad, 1 - bad])
    p, share = [[list(x) for x in row] for row in prior], [0.5 / rules] * rules + [0.5]
    posts, before = [], -math.inf
    for _ in range(rounds):
        posts, likely = [], 0.0
        for votes, n in zip(patterns, counts):
            each = [share[c] * math.prod(p[c][r][v] for r, v in enumerate(votes) if v >= 0) for c in range(rules + 1)]
            posts.append([x / sum(each) for x in each])
            likely += n * math.log(sum(each))
        if likely - before < 1e-10 * abs(likely):
            break
        before = likely
        for c in range(rules + 1):
            for r in range(rules):
                got = [sum(q[c] * n for q, votes, n in zip(posts, patterns, counts) if votes[r] == v) + 20 * prior[c][r][v] for v in (0, 1)]
                bad = got[0] / sum(got)
                bad = max(bad, 0.5) if c == r else bad
                p[c][r] = [bad, 1 - bad]
        share = [sum(q[c] * n for q, n in zip(posts, counts)) + 20 / (rules + 1) for c in range(rules + 1)]
        share = [x / sum(share) for x in share]
    return [q[-1] for q in posts]


def test_query_against_em_by_hand(spark, data):
    docs = documents(data)
    features = [dict(zip(quality.FEATURES, quality.features(t), strict=True)) for _, t, *_ in docs]
    vote = {
        "symbols": lambda n_symbols, n_words, **_: 0 if n_symbols > 0.1 * n_words else 1 if n_symbols <= 0.02 * n_words else -1,
        "lines": lambda n_dup_lines, n_lines, **_: 0 if n_dup_lines > 0.5 * n_lines else 1 if n_lines >= 3 and n_dup_lines <= 0.05 * n_lines else -1,
        "repeats": lambda n_repeat_words, n_words, **_: 0 if n_repeat_words > 0.4 * n_words else 1 if n_repeat_words <= 0.1 * n_words else -1,
        "short": lambda n_short, n_words, **_: 0 if n_short < 0.02 * n_words else 1 if n_short >= 0.08 * n_words else -1,
        "length": lambda word_chars, n_words, **_: 0 if not 2.5 * n_words <= word_chars <= 12 * n_words else 1 if word_chars <= 10 * n_words else -1,
        "letters": lambda n_alphabetic, n_bytes, **_: 0 if n_alphabetic < 0.7 * n_bytes else 1 if n_alphabetic >= 0.85 * n_bytes else -1,
        "capitals": lambda n_capitals, n_letters, **_: 0 if n_capitals > 0.5 * n_letters else 1 if n_capitals <= 0.2 * n_letters else -1,
        "size": lambda n_words, **_: 0 if n_words < 50 else 1 if n_words >= 100 else -1,
    }
    assert list(vote) == list(quality.VOTES)
    votes = [tuple(v(**f) for v in vote.values()) for f in features]
    counts = Counter(votes)
    good = dict(zip(counts, em(list(counts), list(counts.values())), strict=True))
    want = {d[0]: good[v] for d, v in zip(docs, votes, strict=True)}
    for r in quality.op4_quality_rules(spark, data).collect():
        assert abs(r["quality"] - want[r["doc_id"]]) < 1e-4
        assert r["kept"] == (not r["base_failed"] and want[r["doc_id"]] >= 0.5)


@pytest.mark.parametrize("rules, others", [(6, {1: 0.5, 3: 0.6}), (8, {1: 0.6, 3: 0.5, 5: 0.4})])
def test_fit_estimates_a_rules_own_accuracy(rules, others):
    rng = np.random.default_rng(4)
    n, right = 60_000, np.resize([0.97, 0.7, 0.9, 0.75], rules)
    kind = np.where(rng.random(n) < 0.4, rng.integers(0, rules, n), rules)
    chance = np.full((rules + 1, rules), 0.01)
    for r in range(rules):
        chance[r, r] = right[r]
        for k, c in others.items():  # what tells of a bad document that its own rule passes
            chance[r, (r + k) % rules] = c
    votes = (rng.random((n, rules)) >= chance[kind]).astype(int)
    patterns, _, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.fit(patterns, counts.astype(float), rounds=3000, tolerance=1e-12)
    assert np.abs(model["accuracy"] - right).max() < 0.05


def test_prose_of_other_languages_is_kept(spark):
    rng = np.random.default_rng(5)
    particles = "и в на не что он с как это по но из у за от".split()
    docs = documents("/root/testdata/sf0.001")
    rows = [(i, t) for i, t, *_ in docs]
    for i in range(20):
        words = [particles[rng.integers(len(particles))] if rng.random() < 0.3 else "".join(chr(0x430 + c) for c in rng.integers(0, 32, rng.integers(4, 10))) for _ in range(200)]
        rows.append((10_000 + i, " ".join(words)))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(frame(spark, rows)).collect()}
    assert all(got[10_000 + i] for i in range(20))


def test_too_many_rules(spark):
    with pytest.raises(ValueError, match="at most"):
        quality.judge(frame(spark, ODD), votes={f"r{i}": "1" for i in range(13)})


def test_text_column_named_like_an_output(spark):
    docs = frame(spark, [(1, "a b c " * 30)])
    for name in ("kept", "n_words"):
        (row,) = quality.judge(docs.withColumnRenamed("text", name), text=name, keep_text=False).collect()
        assert row["n_words"] == 90


def test_a_corpus_of_one_kind_keeps_it():
    patterns = np.ones((1, len(quality.VOTES)), int)
    assert quality.fit(patterns, np.array([1000.0]))["posterior"][0] > 0.9


def test_frame(spark):
    df = frame(spark, ODD).withColumnRenamed("lang", "kept").withColumnRenamed("source", "n_words")
    for keep in (True, False):
        got = quality.judge(df, keep_text=keep).collect()
        assert len(got) == len(ODD)
        assert all(r["base_failed"] and not r["kept"] for r in got if (r["doc_id"] or 0) in range(1, 6))
    assert quality.judge(frame(spark, [])).collect() == []
