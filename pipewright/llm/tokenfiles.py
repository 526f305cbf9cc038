"""Token files: independent zstandard frames with a trailing seek table.

A file holds, in this order: one zstandard frame for each document (a document of more than ``FRAME_TOKENS`` ids takes
several), a skippable frame with the document index, and a skippable frame in the public seekable format: for each
frame its compressed size, decompressed size and checksum (low 32 bits of XXH64), then the footer. All integers are
little-endian. A reader takes the footer and the tables from the end and decompresses only the documents that it wants.

Index: ``PWIX``, version 1, bytes for each id (2 or 4), 2 zero bytes, number of documents (u64), then for each document
its key (i64, the smallest i64 for null), and for each document its number of ids (u64).
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, scratch, table

FRAME_TOKENS = 1 << 20
INDEX_FRAME, SEEK_FRAME, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NULL_KEY = -(1 << 63)
#: Entries of the cache of encoded pieces, the longest piece that it keeps, and characters cut at a time.
CACHE_PIECES, CACHE_LENGTH, STRETCH = 300_000, 48, 1 << 20
# The tokenizer's rule for pieces, the same for lower-case characters up to U+017F, and what is outside of that.
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\\s0-9a-zªµºß-öø-ſ²³¹¼-¾]+")
# The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
UNUSUAL = re.compile("[^\t\n\r -~¡-įı-ſ]")
MANIFEST = "part int, path string, docs long, tokens long"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_file(uri: str, docs: Iterable[tuple[int | None, np.ndarray]], width: int) -> tuple[int, int]:
    """Write (key, ids) pairs; returns (documents, ids). The file appears under its name only when it is complete, so
    a task that runs again, or twice at once, leaves one whole file."""
    filesystem, path = open_fs(uri)
    keys, counts, entries, total = [], [], [], 0
    press = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(temporary) as out:
        for key, ids in docs:
            keys.append(NULL_KEY if key is None else key)
            counts.append(len(ids))
            total += len(ids)
            for at in range(0, max(1, len(ids)), FRAME_TOKENS):
                raw = ids[at : at + FRAME_TOKENS].astype(f"<u{width}").tobytes()
                frame = press.compress(raw)
                out.write(frame)
                entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        index = struct.pack("<4sBBHQ", b"PWIX", 1, width, 0, len(keys)) + np.array(keys, "<i8").tobytes() + np.array(counts, "<u8").tobytes()
        out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = np.array(entries, "<u4").tobytes() + struct.pack("<IBI", len(entries), 0x80, SEEK_MAGIC)
        out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)
    filesystem.move(temporary, path)
    return len(keys), total


class Reader:
    """Random access to one file's documents."""

    def __init__(self, uri: str):
        filesystem, path = open_fs(uri)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError(f"{uri}: no seek table")
        seek = size - 17 - 12 * count
        kind, length = struct.unpack("<II", self.file.read_at(8, seek))
        if kind != SEEK_FRAME or length != 12 * count + 9:
            raise ValueError(f"{uri}: damaged seek table")
        self.entries = np.frombuffer(self.file.read_at(12 * count, seek + 8), "<u4").reshape(count, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        index = self.file.read_at(seek - int(self.offsets[-1]) - 8, int(self.offsets[-1]) + 8)
        name, version, self.width, _, docs = struct.unpack("<4sBBHQ", index[:16])
        if name != b"PWIX" or version != 1:
            raise ValueError(f"{uri}: damaged index")
        self.keys = np.frombuffer(index, "<i8", docs, 16)
        self.counts = np.frombuffer(index, "<u8", docs, 16 + 8 * docs).astype(np.int64)
        frames = np.maximum(1, -(-self.counts // FRAME_TOKENS))
        self.first = np.concatenate([[0], np.cumsum(frames)])
        self.unpress = zstandard.ZstdDecompressor()

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document; raises ValueError if a frame doesn't match its checksum."""
        parts = []
        for f in range(self.first[i], self.first[i + 1]):
            length, size, check = self.entries[f].tolist()
            raw = self.unpress.decompress(self.file.read_at(length, int(self.offsets[f])), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {f} is damaged")
            parts.append(np.frombuffer(raw, f"<u{self.width}"))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def close(self) -> None:
        self.file.close()


class PieceEncoder:
    """The ids of texts, piece by piece with a bounded cache.

    Nearly all of the library's time goes into cutting texts into pieces. Texts of letters up to U+017F, for which its
    normalizer only lower-cases, are cut here instead (PIECES are its rules for these characters) and each new piece goes to
    its BPE model; all other texts, and tokenizers of another make, go to the library whole. A test holds both against it.
    """

    def __init__(self, tokenizer_path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        with open(tokenizer_path, encoding="utf-8") as file:
            made = json.load(file)
        split = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.known_make = (split.get("pattern") or {}).get("Regex") == SPLIT_RULE and split.get("invert") is True and [x["type"] for x in made["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.special = [x["content"] for x in made.get("added_tokens", [])]
        self.cache: dict[str, bytes] = {}

    def fresh(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        out = array("I", [x.id for x in self.model.tokenize(piece)])
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def __call__(self, text: str) -> np.ndarray:
        if not self.known_make or UNUSUAL.search(text) or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        out, cache = [], self.cache
        # long texts in stretches, so that their pieces never stand in memory together
        at = 0
        while at < len(text):
            end = at + STRETCH
            if end < len(text):
                end = text.find(" ", end) + 1 or len(text)
            pieces = PIECES.findall(text[at:end].lower())
            extra = {p: self.fresh(p) for p in set(pieces).difference(cache)}
            cache.update((p, b) for p, b in extra.items() if len(p) <= CACHE_LENGTH)
            if any(len(p) > CACHE_LENGTH for p in extra):
                out += [cache[p] if p in cache else extra[p] for p in pieces]
            else:
                out += map(cache.__getitem__, pieces)
            at = end
        return np.frombuffer(b"".join(out), "<u4")


def write_tokens(
    df: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, key: str = "doc_id", text: str = "text", width: int = 4
) -> DataFrame:
    """Encode each text and write files ``part-N.tok`` in ascending order of the key (nulls first, then by text among equal keys).

    Returns the manifest (part, path, docs, tokens), already written to ``folder/manifest``. A null or empty text has the end
    id alone (no ids if ``end_id`` is None). Repeated rows are written each time. Only key and text are kept. An empty table
    gives an empty manifest. ``width``: 2 or 4 bytes an id; an id that doesn't fit raises.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = partitions(spark)
    rows = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = PieceEncoder(tokenizer_path)
        tail = np.array([] if end_id is None else [end_id], "<u4")

        def docs():
            for batch in batches:
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = np.concatenate([encode(text.as_py()), tail])
                    if width == 2 and len(ids) and ids.max() > 0xFFFF:
                        raise ValueError("an id needs more than 2 bytes")
                    yield key.as_py(), ids

        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.tok"
        count, tokens = write_file(path, docs(), width)
        if count:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "docs": [count], "tokens": [tokens]})

    filesystem, path = open_fs(folder)
    filesystem.create_dir(path, recursive=True)
    rows.mapInArrow(run, MANIFEST).hint("rebalance").write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, consume: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """Read every document back: ``doc_id``, ``start`` (ids before it in all files), ``n_tokens`` and what ``consume`` makes of its ids.

    The window that sums the files' sizes sees one row for each file.
    """
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", "path", F.coalesce(before, F.lit(0).cast("long")).alias("base"))
    files = files.repartition(partitions(manifest.sparkSession), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, out = Reader(row["path"]), []
                starts = row["base"] + np.concatenate([[0], np.cumsum(reader.counts)])
                for i, key in enumerate(reader.keys.tolist()):
                    ids = reader.ids(i)
                    out.append({"doc_id": None if key == NULL_KEY else key, "start": int(starts[i]), "n_tokens": len(ids), **consume(ids)})
                    if len(out) == 5000:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                reader.close()
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    whole = f"doc_id long, start long, n_tokens long, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(whole))
    return files.mapInArrow(run, whole)


def lookup(folder: str, manifest_rows: list, wanted: set[int]) -> dict[int, np.ndarray]:
    """The ids of the wanted documents; decompresses no other frame."""
    found = {}
    for row in manifest_rows:
        reader = Reader(row["path"])
        for i in np.flatnonzero(np.isin(reader.keys, list(wanted))).tolist():
            found[int(reader.keys[i])] = reader.ids(i)
        reader.close()
    return found


def checksum(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents' ids with end id 1, written and read back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), str(tokenizer_path), 1, width=2)
    return read_tokens(manifest, checksum, "ids_crc32 long")
