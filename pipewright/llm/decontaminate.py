"""Benchmark decontamination with a distributed positional inverted index.

The index is stored in the shared folder, in shards by documents, as search engines keep theirs: each shard holds, for a block
of documents, every term's posting list of sorted positions (documents lie apart by a gap). It knows nothing of a benchmark, so one
index serves any number of them, and no posting is shuffled.

A search reads the shards in tasks of their own. A test window starts from the list of its rarest term in the shard: the
positions less the term's offset in the window are the candidate starts; then each next rarer term's list, less its offset, is
intersected with them by binary search, until all terms agree: an exact phrase. Proximity matches intersect in the same order
but ask only for a position near by. The benchmark is cut into blocks of a bounded size, whose windows every task sees in turn.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, partitions, scratch, table

WINDOW = 10
#: Words that a proximity match may hold between those of its window.
SLOP = 4
#: Bytes of benchmark text that are collected, and held by a task, at a time.
BLOCK_BYTES = 16 << 20
#: Bytes of documents from which on a shard of the index is full (so a longer document has one of its own), and candidates looked at at once.
SHARD_BYTES, CANDIDATES = 6 << 20, 1 << 21
#: What parts documents in a shard: more words than any match may span.
GAP = 64
#: Lower-cases A-Z and blanks whatever isn't in a word.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


class Phrases:
    """The distinct windows of a block of benchmark items, as term numbers from 1 (0: no term)."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [k for k, _ in items]
        of: dict[tuple[int, ...], set[int]] = {}
        for i, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                of.setdefault(tuple(ids[at : at + window]), set()).add(i)
        self.length = np.array([len(w) for w in of], np.int64)
        self.terms = np.zeros((len(of), window), np.int32)
        for row, w in enumerate(of):
            self.terms[row, : len(w)] = w
        self.owners = np.array([i for s in of.values() for i in sorted(s)], np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(s) for s in of.values()])]).astype(np.int64)


def postings(texts: list[bytes]) -> tuple[pa.Table, np.ndarray]:
    """(term, positions as differences; words of each document) of a block of documents."""
    data = np.frombuffer(b" ".join(texts).translate(WORDS) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = data != 32
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    first, last = edge[::2], edge[1::2]  # of each word; the last byte is a blank
    counts = np.diff(np.searchsorted(first, ends), prepend=0)
    place = np.arange(len(first)) + GAP * np.repeat(np.arange(len(texts)), counts)
    bounds = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[inside].tobytes())])
    coded = values.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    sizes = np.bincount(code, minlength=len(coded.dictionary))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    apart = np.diff(place[order], prepend=0)
    if len(order):
        apart[starts[:-1]] = place[order][starts[:-1]]
    return pa.table({"term": coded.dictionary, "positions": pa.LargeListArray.from_arrays(pa.array(starts), pa.array(apart))}), counts


class Index:
    """The posting lists of one shard, of the terms that some phrases use."""

    def __init__(self, shard: pa.Table, words: np.ndarray, phrases: Phrases):
        get = phrases.vocabulary.get
        lists = shard["positions"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        bounds = lists.offsets.to_numpy()
        # differences become positions: sums that begin anew with each list
        apart = lists.values.to_numpy()
        sums = np.cumsum(apart)
        sums -= np.repeat(sums[bounds[:-1]] - apart[bounds[:-1]], np.diff(bounds)) if len(apart) else 0
        number = np.array([get(t, 0) for t in shard["term"].to_pylist()], np.int64)
        order = np.argsort(number, kind="stable")
        order = order[number[order] > 0]
        sizes = np.diff(bounds)[order]
        take = np.arange(sizes.sum()) + np.repeat(bounds[:-1][order] - (np.cumsum(sizes) - sizes), sizes)
        self.positions = sums[take]
        self.count = np.zeros(len(phrases.vocabulary) + 1, np.int64)
        self.count[number[order]] = sizes
        self.offset = np.concatenate([[0], np.cumsum(self.count)])
        self.starts = np.cumsum(words + GAP) - (words + GAP)
        self.size = int((words + GAP).sum())
        self.keys = np.repeat(np.arange(len(self.count), dtype=np.int64), self.count) * (self.size + 1) + self.positions

    def candidates(self, rows: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) for each position of each row's term."""
        n = self.count[term]
        row = np.repeat(rows, n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, self.positions[np.repeat(self.offset[term], n) + inside]

    def near(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term's list has a position in [low, high]; by binary search in (term, position) order."""
        if not len(self.keys):
            return np.zeros(len(term), bool)
        at = np.searchsorted(self.keys, term * (self.size + 1) + np.maximum(low, 0))
        return (self.keys[np.minimum(at, len(self.keys) - 1)] - term * (self.size + 1) <= high) & (at < len(self.keys))


def lookups(index: Index, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (windows with all terms present, their offsets from the rarest term on)."""
    counts = index.count[phrases.terms]
    used = np.arange(phrases.terms.shape[1]) < phrases.length[:, None]
    alive = np.flatnonzero(((counts > 0) | ~used).all(1))
    ranks = np.argsort(np.where(used, counts, np.iinfo(np.int64).max)[alive], axis=1, kind="stable")
    least = counts[alive, ranks[:, 0]] if len(alive) else np.array([], np.int64)
    chunk = np.cumsum(least) // CANDIDATES
    for c in np.unique(chunk):
        yield alive[chunk == c], ranks[chunk == c]


def phrase_matches(index: Index, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every occurrence."""
    found = [(np.array([], np.int64), np.array([], np.int64))]
    for windows, ranks in lookups(index, phrases):
        row, at = index.candidates(np.arange(len(windows)), phrases.terms[windows, ranks[:, 0]])
        start = at - ranks[row, 0]
        keep = start >= 0
        row, start = row[keep], start[keep]
        for j in range(1, phrases.terms.shape[1]):
            offset = ranks[row, j]
            used = np.flatnonzero(offset < phrases.length[windows[row]])
            keep = np.ones(len(row), bool)
            goal = start[used] + offset[used]
            keep[used] = index.near(phrases.terms[windows[row[used]], offset[used]].astype(np.int64), goal, goal)
            row, start = row[keep], start[keep]
        found.append((windows[row], start))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def proximity_matches(index: Index, phrases: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of its rarest term) where all of a full window's terms lie within its length plus ``slop`` words, in any order."""
    found = [(np.array([], np.int64), np.array([], np.int64))]
    width = phrases.terms.shape[1]
    for windows, ranks in lookups(index, phrases):
        keep = phrases.length[windows] == width
        windows, ranks = windows[keep], ranks[keep]
        row, at = index.candidates(np.arange(len(windows)), phrases.terms[windows, ranks[:, 0]])
        span = width + slop
        for j in range(1, width):
            keep = index.near(phrases.terms[windows[row], ranks[row, j]].astype(np.int64), at - span + 1, at + span - 1)
            row, at = row[keep], at[keep]
        good = np.zeros(len(row), bool)
        for s in range(span):
            low, fits = at - s, np.ones(len(row), bool)
            for j in range(1, width):
                fits &= index.near(phrases.terms[windows[row], j].astype(np.int64), low, low + span - 1)
            fits &= index.near(phrases.terms[windows[row], 0].astype(np.int64), low, low + span - 1)
            good |= fits
        found.append((windows[row[good]], at[good]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def benchmark_blocks(benchmark: DataFrame, item: str, text: str) -> list[str]:
    """Write the benchmark's Phrases to the shared folder, in blocks of about BLOCK_BYTES of text; the driver holds one at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    filesystem, path = fs.FileSystem.from_uri(scratch(benchmark.sparkSession, "benchmark"))
    filesystem.create_dir(path, recursive=True)
    found = []
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        name = f"{path}/block-{b:06d}"
        with filesystem.open_output_stream(name) as out:
            out.write(cloudpickle.dumps(Phrases([(r["item"], r["text"]) for r in part.toLocalIterator()])))
        found.append(name)
    return [scratch_uri(filesystem, x) for x in found]


def scratch_uri(filesystem: fs.FileSystem, path: str) -> str:
    return f"file://{path}" if filesystem.type_name == "local" else path


def build_index(documents: DataFrame, text: str, folder: str, keep_text: bool) -> DataFrame:
    """Write the index of all documents; their rows with ``_block``, ``_row`` (where they are in it), ``_words`` and ``_digest`` (SHA-256
    of the text, null for null) in place of the text, or beside it (``keep_text``).

    A shard's file appears under its name only when it is whole, so a task that runs again, or twice at once, does no harm.
    """
    from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

    kept = [f for f in documents.schema.fields if keep_text or f.name != text]
    added = [StructField("_block", LongType()), StructField("_row", IntegerType()), StructField("_words", LongType()), StructField("_digest", StringType())]
    filesystem, path = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)

    def write(block: int, texts: list[bytes]) -> np.ndarray:
        shard, counts = postings(texts)
        filesystem, path = fs.FileSystem.from_uri(folder)
        temporary = f"{path}/{uuid.uuid4().hex}.tmp"
        shard = shard.replace_schema_metadata({"words": counts.astype("<i8").tobytes()})
        with filesystem.open_output_stream(temporary) as out, pa.ipc.new_file(out, shard.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
            file.write_table(shard)
        filesystem.move(temporary, f"{path}/{block}")
        return counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            blocks, rows, words, digests = [], [], [], []
            held: list[bytes] = []
            size = 0

            def flush() -> None:
                nonlocal held, size, number
                if held:
                    words.extend(write(part << 32 | number, held).tolist())  # noqa: B023
                    held, size, number = [], 0, number + 1

            for value in batch.column(batch.schema.get_field_index(text)):
                value = value.as_py()
                data = (value or "").encode("utf-8", "surrogatepass")
                digests.append(None if value is None else hashlib.sha256(data).hexdigest())
                blocks.append(part << 32 | number)
                rows.append(len(held))
                held.append(data)
                size += len(data)
                if size >= SHARD_BYTES:
                    flush()
            flush()
            columns = [pa.array(blocks, pa.int64()), pa.array(rows, pa.int32()), pa.array(words, pa.int64()), pa.array(digests, pa.string())]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, *columns], names=[*[f.name for f in kept], *[f.name for f in added]])

    return materialise(documents.mapInArrow(run, StructType([*kept, *added])), "index-rows", texts=True)


def search(rows: DataFrame, folder: str, benchmark: DataFrame, item: str, text: str, slop: int | None) -> DataFrame:
    """(``_block``, ``_row``, ``n_hit``, ``items``, ``near_items``) of each document of the index in which something is found."""
    paths = benchmark_blocks(benchmark, item, text)
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [b for batch in batches for b in batch.column(0).to_pylist()]
        hits: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {b: [] for b in shards}
        found: tuple[dict, dict] = {}, {}
        places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        filesystem, folder_path = fs.FileSystem.from_uri(folder)
        for path in paths:
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_file(name) as file:
                phrases = pickle.loads(file.read())
            for block in shards:
                with filesystem.open_input_file(f"{folder_path}/{block}") as file:
                    shard = pa.ipc.open_file(file).read_all()
                words = np.frombuffer(shard.schema.metadata[b"words"], "<i8")
                index = Index(shard, words, phrases)
                places[block] = index.starts, words
                for kind, (windows, at) in enumerate((phrase_matches(index, phrases), proximity_matches(index, phrases, slop) if slop is not None else ([], []))):
                    if not len(windows):
                        continue
                    doc = np.searchsorted(index.starts, at, "right") - 1
                    for w, d in np.unique(np.stack([windows, doc], 1), axis=0).tolist():
                        own = found[kind].setdefault((block, d), set())
                        own.update("null" if phrases.items[i] is None else phrases.items[i] for i in phrases.owners[phrases.first[w] : phrases.first[w + 1]])
                    if kind == 0:
                        span = np.unique(np.stack([at, at + phrases.length[windows]], 1), axis=0)
                        hits[block].append((span[:, 0], span[:, 1]))
        out = []
        for block in shards:
            if hits[block]:
                starts, words = places[block]
                change = np.zeros(int((words + GAP).sum()) + 1, np.int64)
                for low, high in hits[block]:
                    np.add.at(change, low, 1)
                    np.add.at(change, high, -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
            for d in sorted({d for kind in found for b, d in kind if b == block}):
                n = int(covered[starts[d] + words[d]] - covered[starts[d]]) if hits[block] else 0
                out.append((block, d, n, sorted(found[0].get((block, d), ())), sorted(found[1].get((block, d), ()))))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
        names = ["_block", "_row", "n_hit", "items", "near_items"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    blocks = rows.select("_block").distinct().repartition(4 * partitions(spark), "_block")
    return blocks.mapInArrow(run, "_block long, _row int, n_hit long, items array<string>, near_items array<string>")


def mark(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", slop: int | None = SLOP, keep_text: bool = True
) -> DataFrame:
    """Add ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``items`` (sorted ids, as strings, of the items that
    occur) and ``near_items`` (those found by proximity; empty if ``slop`` is None) to each row.

    Null and empty texts have no words; items without words are never found, items of under WINDOW words are one window;
    null item ids count as the string ``null``, repeated items once. An empty benchmark marks nothing, an empty table stays empty.
    A very long text is a shard of its own, some 60 bytes of memory for each of its words. Other columns pass through
    (``keep_text=False``: but for the text; else texts are written once more); columns of the names above are replaced, a text
    column of such a name is read first; names beginning with ``_`` are reserved.
    """
    if slop is not None and WINDOW + slop >= GAP:
        raise ValueError(f"slop must be under {GAP - WINDOW}")
    names = ["n_words", "n_hit", "items", "near_items"]
    documents = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in names or c == text])
    folder = scratch(documents.sparkSession, "index")
    rows = build_index(documents, text, folder, keep_text and text not in names)
    found = materialise(search(rows, folder, benchmark, item, item_text, slop), "index-found")
    discard(documents.sparkSession, folder)
    out = rows.join(found, ["_block", "_row"], "left")
    none = F.array().cast("array<string>")
    filled = {"n_words": F.col("_words"), "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", none), "near_items": F.coalesce("near_items", none)}
    return out.withColumns(filled).drop("_block", "_row", "_words", "_digest")


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``documents`` in whose text no window occurs. Rows leave by their texts' digests, so texts are neither written nor
    sorted unless most of them are contaminated."""
    spark, folder = documents.sparkSession, scratch(documents.sparkSession, "index")
    rows = build_index(documents.select(F.col(text).alias("text")), "text", folder, False)
    found = search(rows, folder, benchmark, item, item_text, None).where("n_hit > 0")
    gone = materialise(rows.join(found, ["_block", "_row"]).select("_digest").distinct(), "index-found")
    discard(spark, folder, rows.scratch_path)
    return documents.join(gone, F.sha2(F.col(text).cast("binary"), 256) == F.col("_digest"), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )
