import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, documents, frame
from tokenizers import Tokenizer

from pipewright.llm import tokenfiles

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TRICKY = ["it's WE'LL o'd 'Sno", "½ a1b22 ÀÉß ª µ <|endoftext|> x", "日本 ΑΣ é́ é  x\u0085y\x1cz", "", "a" * 3000 + " b", "İstanbul ı ŉ ǅ ſ", "tab\tline\n\rend", "x y", "ɏɐ Ɏ", "''s'll''"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_pieces_are_the_library_s(tokenizer, data, monkeypatch):
    monkeypatch.setattr(tokenfiles, "STRETCH", 300)
    monkeypatch.setattr(tokenfiles, "CACHE_PIECES", 500)
    encode = tokenfiles.PieceEncoder(PATH)
    assert encode.known_make
    for text in [*TRICKY, *[t for _, t, *_ in documents(data)]]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def test_every_character(tokenizer):
    encode = tokenfiles.PieceEncoder(PATH)
    for block in range(0, 0x3000, 64):
        text = " ".join(f"a{chr(c)}B {chr(c)}" for c in range(block, block + 64))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, hex(block)


@pytest.mark.parametrize("width", [2, 4])
def test_file_round_trip(tmp_path, monkeypatch, width):
    monkeypatch.setattr(tokenfiles, "FRAME_TOKENS", 100)
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 60_000, n).astype("<u4")) for k, n in [(None, 3), (-5, 0), (1, 100), (1, 101), (7, 1000), (2**62, 1)]]
    path = f"{tmp_path}/x.tok"
    assert tokenfiles.write_file(path, docs, width) == (6, 1205)
    reader = tokenfiles.Reader(path)
    assert reader.keys.tolist()[1:] == [-5, 1, 1, 7, 2**62]
    for i in (4, 0, 3, 1, 2, 5):
        assert reader.ids(i).tolist() == docs[i][1].tolist()


def test_damage_is_noticed(tmp_path):
    path = f"{tmp_path}/x.tok"
    tokenfiles.write_file(path, [(1, np.arange(500, dtype="<u4")), (2, np.arange(9, dtype="<u4"))], 2)
    data = bytearray(open(path, "rb").read())
    data[30] ^= 1
    open(path, "wb").write(data)
    reader = tokenfiles.Reader(path)
    with pytest.raises(Exception):
        reader.ids(0)
    assert reader.ids(1).tolist() == list(range(9))
    open(path, "wb").write(data[:-3])
    with pytest.raises(Exception):
        tokenfiles.Reader(path)


def test_frames_are_plain_zstandard(tmp_path):
    import zstandard

    path = f"{tmp_path}/x.tok"
    tokenfiles.write_file(path, [(1, np.array([1, 2], "<u4")), (2, np.array([3], "<u4"))], 2)
    with open(path, "rb") as file:
        whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert np.frombuffer(whole[:6], "<u2").tolist() == [1, 2, 3]


def test_frame(spark, tmp_path, tokenizer):
    manifest = tokenfiles.write_tokens(frame(spark, ODD).withColumnRenamed("lang", "key"), f"file://{tmp_path}/t", PATH, 1)
    got = tokenfiles.read_tokens(manifest, tokenfiles.checksum, "ids_crc32 long").orderBy("start").collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    ids = [np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in order]
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(order, ids, strict=True)]
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).tolist()
    found = tokenfiles.lookup(f"file://{tmp_path}/t", manifest.collect(), {5, 9, 77})
    assert found.keys() == {5, 9} and found[5].tolist() == [*tokenizer.encode("one", add_special_tokens=False).ids, 1]


def test_empty(spark, tmp_path):
    manifest = tokenfiles.write_tokens(frame(spark, []), f"file://{tmp_path}/t", PATH, 1)
    assert manifest.collect() == [] and tokenfiles.read_tokens(manifest, tokenfiles.checksum, "ids_crc32 long").collect() == []


def test_query(spark, data, tokenizer):
    start, docs = 0, documents(data)
    got = {r["doc_id"]: r for r in tokenfiles.op3_token_files(spark, data).collect()}
    assert len(got) == len(docs)
    for i, text, *_ in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
