import base64
import bz2
import gzip
import hashlib
import lzma
import re
import urllib.parse
import zlib

import zstandard
from helpers import ODD, documents, frame

from pipewright.llm import secrets

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, secrets.KINDS[k]) for s, k, e in sorted(found)]


BASE = [
    "password=abcdef", "PassWord : 'abcde", "token=abc token: abcdef", "api_key=\"zzzzzz\" APIKEY=123456", "ſecret=abcdef toKen=abcdef",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAKIA" + "B" * 14, "f" * 23, "f" * 24 + "g" + "0" * 30, "passwordpassword=secret=token=x", "secret\n=abcdef", "\U0001f600 token=abcdef",
]


def test_base_spans():
    for text in [*BASE, None, "", " ".join(BASE)]:
        assert secrets.scan(text)[0] == brute(text), text


def test_documents(data):
    for _, text, *_ in documents(data):
        base, spans, _ = secrets.scan(text)
        assert base == brute(text)
        assert set(base) <= set(spans)


SECRET = "password=hunter2hunter2"
B64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


def found(text):
    return {(text[s:e], k) for s, e, k in secrets.scan(text)[1]}


def test_layers():
    hidden = "".join(f"%{b:02X}" for b in SECRET.encode())
    assert (hidden, "assign") in found(f"see {hidden} end")
    escaped = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    assert (escaped, "assign") in found(f"see {escaped} end")
    partly = "pass%77ord=abc%64efgh"
    assert found(f"é {partly}!") >= {(partly, "assign")}
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        run = B64(pack(f"config {SECRET} {'x' * 50}".encode()))
        assert (run, "assign") in found(f"a {run} b"), pack


def test_nested_layers_map_to_the_outermost():
    inner = B64(f"deep {SECRET}")
    outer = B64(gzip.compress(f"text {urllib.parse.quote(inner)} and AKIA{'Z' * 20}".encode()))
    text = f"日本 {outer} after"
    assert found(text) == {(outer, "assign"), (outer, "access")}


def test_surrogate_pairs_and_entities():
    text = "x \\ud83d\\ude00 tok&#101;n=abcdef"
    assert ("tok&#101;n=abcdef", "assign") in found(text)


def test_cycles_and_damage_end():
    quine = B64(B64("harmless text that goes round") * 3)
    assert found(quine) == set()
    broken = B64(gzip.compress(b"password=abcdefgh" * 50)[:-9])
    assert found(broken) == {(broken, "assign")}
    many = B64("a" * 30)
    for _ in range(12):
        many = B64(many)
    assert secrets.scan(many)[2] > 10
    assert secrets.scan("%zz %E4%F6 \\uZZZZ \\uD800 " + "=" * 50 + "A" * 17)[1] == []


def test_large_layer_is_read_in_windows(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1 << 16)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 10)
    run = B64(zlib.compress(b"a " * 200_000 + SECRET.encode() + b" b" * 200_000))
    assert found(run) == {(run, "assign")}


def test_bytes_that_are_no_text(monkeypatch):
    random = __import__("random").Random(3)
    for data in (SECRET + "\0", ("é " + SECRET).encode("latin-1"), SECRET.encode("utf-16"), SECRET.encode("utf-16-be"), SECRET.encode("utf-32"), random.randbytes(99) + SECRET.encode()):
        run = B64(data)
        assert found(f"a {run} b") == {(run, "assign")}, data


def test_compressed_in_compressed():
    pack = zstandard.ZstdCompressor().compress
    for data in (gzip.compress(gzip.compress(SECRET.encode() * 3)), gzip.compress(b"a " * 30) + gzip.compress(SECRET.encode()), pack(b"aaa bbb") + pack(SECRET.encode()),
                 bz2.compress(lzma.compress(zlib.compress(SECRET.encode()))), b"head " * 9 + gzip.compress(b"first") + b"between" + gzip.compress(SECRET.encode()) + b"after"):
        run = B64(data)
        assert found(f"a {run} b") == {(run, "assign")}, data


def test_runs_without_bounds():
    run = B64(SECRET)
    for text in (f"key_{run}", f"//host/path/{run}", f"{run.rstrip('=')}/rest/of/it", f"a-b-c-{run}", f"{run}\\nnext"):
        assert {k for _, k in found(text)} == {"assign"}, text
    packed = B64(gzip.compress(SECRET.encode() + __import__("random").Random(4).randbytes(200)))
    assert {k for _, k in found(f"x_y/{packed}")} == {"assign"}
    for end in ("\n", "\r\n  ", "\\n", "\\r\\n"):
        lines = end.join(packed[i : i + 64] for i in range(0, len(packed), 64))
        assert (lines, "assign") in found(f"begin {lines} end")
    long = B64(b"x" * 45 + SECRET.encode() + b" " * 90)
    lines = [long[i : i + 76] for i in range(0, len(long), 76)]
    assert found("\n".join(lines)) == {("\n".join(lines[:2]), "assign")}  # only the lines that it stands in


def test_escapes_of_odd_bytes_and_of_escapes():
    hidden = "".join(f"%{b:02X}" for b in SECRET.encode())
    assert found(f"%FF{hidden}%E4") == {(hidden, "assign")}
    deep = hidden.replace("%", "%" + "25" * 5)
    assert found(deep) == {(deep, "assign")}
    assert secrets.scan("%25" * 20000 + "41")[2] < 5
    twice = "".join(f"\\u005cu{ord(c):04x}" for c in SECRET)
    assert found(twice) == {(twice, "assign")}
    quoted = urllib.parse.quote(gzip.compress(SECRET.encode()))
    assert found(f"x {quoted}") == {(quoted, "assign")}
    assert found("\\UFFFFFFFF" + "".join(f"\\x{ord(c):02x}" for c in SECRET)) != set()
    assert "".join(t for t, _, _ in secrets.percent("%C3%A9%FF%41")) == "éÿA"


def test_endless_compression_ends(monkeypatch):
    data = b"x"
    for _ in range(80):
        data = zlib.compress(data)
    assert found(B64(data)) == set()
    monkeypatch.setattr(secrets, "codec", lambda head: "gzip" if head else None)
    monkeypatch.setattr(secrets, "inflated", lambda feed: iter([feed.head(1 << 20)]))
    assert list(secrets.stream(secrets.Feed(iter([b"itself"])), lambda _: None))[0] == b"itself"


def test_runs_and_matches_over_the_end_of_a_window(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1 << 14)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 10)
    monkeypatch.setattr(secrets, "LONGEST", 1 << 15)
    random = __import__("random").Random(5)
    for size in (20_000, 200_000):  # kept whole for a window, and read as a stream
        inner = B64(gzip.compress(random.randbytes(size) + SECRET.encode()))
        run = B64(bz2.compress(b"x " * 7000 + inner.encode() + b" y" * 9000))
        assert found(run) == {(run, "assign")}, size
    plain = B64(bz2.compress(b"x " * 7000 + B64(random.randbytes(100_000) + SECRET.encode() + random.randbytes(100_000)).encode()))
    assert found(plain) == {(plain, "assign")}
    for gap in (b"token" + b" " * 50_000 + b"= abcdefgh", b"f" * 60_000):
        for shift in range(0, 3000, 997):
            run = B64(zlib.compress(b"a " * 6000 + b"z" * shift + b" " + gap + b" " * 9000))
            assert {k for _, k in found(run)} == {"hex" if gap[:1] == b"f" else "assign"}


def test_unfolding_takes_bounded_memory():
    code = """
import base64, resource, sys, zlib
from pipewright.llm import secrets
pack = zlib.compressobj(9)
data = b"".join([pack.compress(b"a b " * 250_000) for _ in range(300)]) + pack.compress(b"password=abcdefgh") + pack.flush()
run = base64.b64encode(data).decode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert secrets.scan(run)[1] == [(0, len(run), "assign")]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    import subprocess
    import sys
    from pathlib import Path

    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    assert int(out.stdout) < 150  # MB, of 300 MB that it unfolds to


def test_text_column_named_like_an_output(spark):
    docs = frame(spark, [(1, f"see {B64(SECRET)}")]).withColumnRenamed("text", "spans")
    (row,) = secrets.scan_secrets(docs, text="spans").collect()
    assert [(s.start, s.kind) for s in row["spans"]] == [(4, "assign")] and row["base_spans"] == []


def test_frame(spark, data):
    rows = [*ODD, (20, f"{SECRET} {B64('x ' + SECRET)}")]
    got = secrets.scan_secrets(frame(spark, rows).withColumnRenamed("lang", "spans")).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "text", "base_spans", "spans", "layers"}
    for r in got:
        assert [(s.start, s.end, s.kind) for s in r["base_spans"]] == brute(r["text"])
    assert secrets.scan_secrets(frame(spark, [])).collect() == []


def test_query(spark, data):
    texts = {i: t for i, t, *_ in documents(data)}
    for r in secrets.op2_scan_secrets(spark, data).collect():
        base = brute(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for *_, k in base) for x in secrets.KINDS]
        assert joined == r["spans"] or len(r["spans"]) > len(joined)
