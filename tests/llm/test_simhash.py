import random

import numpy as np
import pytest
import xxhash
from helpers import LOWER, ODD, documents, frame, words

from pipewright.llm import simhash


def brute_print(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=4):
    """The smallest index that each is linked to."""
    values = np.array(prints, np.uint64)
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= distance) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprints():
    for text in [None, "", " ", "One", "one two", "a b c d", "A b c D e f", "é ü x y z " * 9, "same " * 100]:
        assert simhash.fingerprint(text) == brute_print(text), text


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "BITS", 16)
    text = " ".join(f"w{i % 37}" for i in range(500))
    assert simhash.fingerprint(text) == brute_print(text)


def clustered(seed, n=400):
    """Distinct fingerprints with chains of near ones and one dense cluster."""
    rng = random.Random(seed)
    found = {rng.getrandbits(64) for _ in range(n)}
    for start in list(found)[:60]:
        value = start
        for _ in range(rng.randrange(1, 6)):
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                value ^= 1 << b
            found.add(value)
    centre = rng.getrandbits(64)
    for _ in range(300):
        value = centre
        for b in rng.sample(range(64), rng.randrange(0, 4)):
            value ^= 1 << b
        found.add(value)
    return list(found)


@pytest.mark.parametrize("distance, rows, large", [(4, 1 << 18, 4096), (4, 50, 1), (2, 100, 4096), (0, 100, 4096), (6, 1 << 18, 5)])
def test_links_lose_nothing(spark, monkeypatch, distance, rows, large):
    monkeypatch.setattr(simhash, "ROWS", rows)
    monkeypatch.setattr(simhash, "PAIRS", 1000)
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "LARGE_TIMES", 0 if large < 10 else 4)
    prints = clustered(distance)
    signed = [(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(signed, "_fp long, node long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, distance)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == components(prints, distance)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7)], "u long, v long")
    found = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 400: 400, 450: 400, 500: 400}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_odd_and_empty(spark):
    rows = [*ODD, (30, "One"), (31, "one")]
    got = simhash.near_duplicates(frame(spark, rows).withColumnRenamed("lang", "component_id")).collect()
    assert len(got) == len(rows)
    prints = {r[1]: brute_print(r[1]) for r in rows}
    of = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert of[1, "0" * 16] == of[2, "0" * 16] == of[3, "0" * 16] == of[None, "0" * 16] == 1
    one = f"{prints['one']:016x}"
    assert of[4, one] == of[5, one] == of[30, one] == of[31, one] == 4
    alone = f"{prints['no id ' * 60]:016x}"
    assert of[None, alone] is None
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_rows_without_a_key_link_others_and_a_key_links_nothing(spark):
    far = (1 << 40) - 1
    rows = [(0, 1, 0), (0b1111, None, 1), (0b11111111, 2, 2), (far << 20, 5, 3), (far << 20 | 3 << 10, 3, 4), (0x7A5A5A5A5A5A5A5A, 5, 5), (-1, None, 6), (-2, None, 7)]
    marked = spark.createDataFrame(rows, "_fp long, doc_id long, _row long")
    got = {r["_fp"]: (r["root"], r["component_id"]) for r in simhash.labelled(marked, "doc_id", 4).collect()}
    assert {k: v for k, (_, v) in got.items()} == {0: 1, 0b1111: 1, 0b11111111: 1, far << 20: 3, far << 20 | 3 << 10: 3, 0x7A5A5A5A5A5A5A5A: 5, -1: None, -2: None}
    assert got[-1] == got[-2] and len({v for v, _ in got.values()}) == 4


def test_key_and_text_named_like_outputs(spark):
    docs = spark.createDataFrame([(3, "one"), (2, "One"), (1, "two words")], "fingerprint long, component_id string")
    got = simhash.near_duplicates(docs, key="fingerprint", text="component_id").collect()
    assert sorted((r["component_id"], r["fingerprint"]) for r in got) == sorted([(2, f"{brute_print('one'):016x}")] * 2 + [(1, f"{brute_print('two words'):016x}")])


def test_one_of_each(spark):
    rows = [*ODD, (30, "One"), (31, "one")]
    kept = simhash.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (True, 1), (True, 4), (True, 7), (True, 8), (True, 9)]


def test_query(spark, data):
    docs = documents(data)
    prints = [brute_print(t) for _, t, *_ in docs]
    root = components(prints)
    want = {i: (f"{p:016x}", docs[r][0]) for (i, *_), p, r in zip(docs, prints, root, strict=True)}
    rows = simhash.op9_simhash_components(spark, data).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want


@pytest.mark.parametrize("depth", [3, 4])
def test_deeper_chains_lose_nothing(spark, monkeypatch, depth):
    monkeypatch.setattr(simhash, "MAX_DEPTH", depth)
    monkeypatch.setattr(simhash, "crowding", lambda *_: 1e12)
    prints = clustered(depth)
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)], "_fp long, node long")
    for distance in (4, 8):
        found = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, distance)).collect()}
        assert [found.get(i, i) for i in range(len(prints))] == components(prints, distance)


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_sketches_tell_similarity():
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(600)]
    for n in (0, 3, 10, 40, 150):
        other = list(base)
        for i in rng.sample(range(600), n):
            other[i] = "new"
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        share = np.mean(np.frombuffer(simhash.sketch([w.encode() for w in base]), np.uint8) == np.frombuffer(simhash.sketch([w.encode() for w in other]), np.uint8))
        assert abs(share - len(a & b) / len(a | b)) < 0.13
    assert len(simhash.sketch([])) == len(simhash.sketch([b"one"])) == simhash.SKETCH


def test_similar_documents_are_found_and_others_stay(spark):
    docs = documents("/root/testdata/sf0.01")
    sets = {i: shingles(t) for i, t, *_ in docs}
    kept = {r["doc_id"] for r in simhash.one_of_each(frame(spark, docs), similar=0.8).collect()}
    gone = [i for i, *_ in docs if i not in kept]
    root = dict(zip([i for i, *_ in docs], components([brute_print(t) for _, t, *_ in docs]), strict=True))
    place = {k: i for k, (i, *_) in enumerate(docs)}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for i in gone:  # each has something like it among the documents
        assert place[root[i]] != i or max(alike(i, j) for j in sets if j != i) > 0.65
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i]) > 20 and alike(i, j) >= 0.8]
    lost = [(i, j) for i, j in pairs if i in kept and j in kept]
    assert pairs and len(lost) <= 0.1 * len(pairs)


def test_similar_by_count_on_either_side_of_the_threshold(spark):
    rng = random.Random(8)
    rows = []
    for k in range(40):  # five-word similarity 0.815 and 0.774 in turn
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(base)
        for n in range(4 + k % 2):
            other[20 + 40 * n - 10 * (n == 4)] = f"new{k}x{n}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    of = [shingles(t) for _, t in rows]
    alike = [len(a & b) / len(a | b) for a, b in zip(of[::2], of[1::2], strict=True)]
    assert all(0.8 <= x < 0.83 for x in alike[::2]) and all(0.76 < x < 0.8 for x in alike[1::2])
    near = [(brute_print(a) ^ brute_print(b)).bit_count() <= 4 for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True)]
    assert sum(near[1::2]) < 10
    kept = {r["doc_id"] for r in simhash.one_of_each(frame(spark, rows), similar=0.8).collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or i % 4 == 3 and not near[i // 2]}


def test_copies_with_an_added_or_cut_passage(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        base = [f"w{int(5000 ** rng.random())}" for _ in range(200)]
        other = base + [f"w{int(5000 ** rng.random())}" for _ in range(40)] if k % 2 else base[: 165 + k % 9]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    of = [shingles(t) for _, t in rows]
    assert all(len(a & b) / len(a | b) >= 0.8 for a, b in zip(of[::2], of[1::2], strict=True))
    assert {r["doc_id"] for r in simhash.one_of_each(frame(spark, rows), similar=0.8).collect()} == {i for i, _ in rows if i % 2 == 0}


@pytest.mark.parametrize("few, rows, block", [(64, 1 << 16, 1 << 14), (2, 50, 1 << 14), (2, 50, 25)])
def test_large_group_of_near_copies(spark, monkeypatch, few, rows, block):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "NEIGHBOURS", 1)
    monkeypatch.setattr(simhash, "ROWS", rows)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(simhash, "PAIRS", 100)
    rng = random.Random(10)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    docs = []
    for i in range(120):
        other = list(base)
        for at in rng.sample(range(150), rng.randrange(8)):
            other[at] = f"n{rng.randrange(5000)}"
        docs.append((i, " ".join(other)))
    sets = [shingles(t) for _, t in docs]
    parent = list(components([brute_print(t) for _, t in docs]))
    for _ in range(9):  # until nothing changes
        for i in range(120):
            for j in range(i):
                if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    parent[i] = parent[j] = min(parent[i], parent[j], parent[parent[i]], parent[parent[j]])
    want = {i for i in range(120) if parent[i] == i}
    assert {r["doc_id"] for r in simhash.one_of_each(frame(spark, docs), similar=0.8).collect()} == want


def test_texts_of_one_fingerprint_link_by_each_of_their_sets(spark):
    rng = random.Random(11)
    first, second = ([f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(2))
    changed = [*second[:50], "new", *second[51:]]
    rows = [(1, " ".join(first + ["same"] * 400)), (2, " ".join(second + ["same"] * 400)), (3, " ".join(changed + ["same"] * 9))]
    prints = [simhash.fingerprint(t) for _, t in rows]
    assert prints[0] == prints[1] and (prints[0] ^ prints[2]).bit_count() > 4
    assert [r["doc_id"] for r in simhash.one_of_each(frame(spark, rows), similar=0.8).collect()] == [1]
