"""Exact substring deduplication with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes over it also starts elsewhere in the corpus. Suffix arrays of all text would cost
most of their time on text that occurs once, and shards of random text would each have to be merged with every other. So
shards are made by content. Each window of LENGTH bytes is owned by an anchor, the least hash among the strings of ``GRAM``
bytes inside it; equal windows have equal anchors, so:

1. Blocks of documents are written to the shared folder with their anchors. Anchor hashes seen twice or more anywhere are
   found bucket by bucket; windows of other anchors occur once.
2. The stretch of text that an anchor of the rest owns is a segment. Segments equal in anchor and digest, in whatever
   documents, are merged by an aggregation that partly runs before its shuffle; their windows all repeat.
3. What differs within an anchor goes to one shard: a suffix array of the shard's segments by Larsson-Sadakane refinement
   (order by the first few bytes, then double the depth by the ranks found, only where ties remain), the common prefixes of
   neighbours by Kasai's rule in text order (a suffix whose predecessor follows the one before's has one byte less in common, so only
   others are compared), and a window repeats if a neighbour shares LENGTH bytes.
4. An anchor with more different segments than a task should hold is cut into several shards. Each looks up the windows of the
   others by binary search in their sorted window digests, which meet by digest range.
5. Windows that repeat go back to their blocks, which cut them out.

No text is shuffled but the differing segments; every group that meets in a task is bounded or merged before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, scratch, table

LENGTH, GRAM = 200, 32
#: Bytes of text in a block, hashed at once, and in a suffix array.
BLOCK_BYTES, PIECE_BYTES, SHARD_BYTES = 4 << 20, 1 << 20, 192 << 10
#: Different segments of one anchor that go to one suffix array.
LARGE = 512
#: Buckets of anchor hashes for each shuffle partition; a task holds one at a time.
BUCKETS = 4
ROW_BITS = 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(buffer: bytes, n: int) -> np.ndarray:
    """A hash of the GRAM bytes from each of the first ``n`` positions on; ``buffer`` holds 2 * GRAM more."""
    word = np.ndarray((n + GRAM,), "<u8", buffer, 0, (1,)).copy()
    word *= M1
    word ^= word >> np.uint64(29)
    out = word[:n] * M2
    for at in range(8, GRAM, 8):
        out += word[at : at + n]
        out *= M1
    out ^= out >> np.uint64(32)
    out *= M2
    return out


def anchors(docs: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first owned window, hash) of each anchor in turn; a document's last one owns up to its last window."""
    none = np.array([], np.int64), np.array([], np.int64), np.array([], np.uint64)
    lengths = np.array([len(d) for d in docs], np.int64)
    if not len(docs) or lengths.max() < length:
        return none
    buffer = b"".join([*docs, bytes(2 * GRAM + 8)])
    n = int(lengths.sum())
    hashed = gram_hashes(buffer, n)
    least = (hashed & ~PLACE) | np.arange(n, dtype=np.uint64)
    places, span = length - GRAM + 1, 1
    while span * 2 <= places:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if places > span:
        least = np.minimum(least[: len(least) - (places - span)], least[places - span :])
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(docs)), lengths)[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + length <= ends[doc])
    place = (least[window] & PLACE).astype(np.int64)
    doc = doc[window]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    doc, window = doc[first], window[first]
    return doc, window - (ends - lengths)[doc], hashed[place[first]]


def document_anchors(docs: list[bytes], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first owned windows, hashes) of each document, PIECE_BYTES at a time; a longer document in overlapping pieces."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in docs]
    batch: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        nonlocal batch, size
        doc, start, hashed = anchors([x[2] for x in batch], length)
        bounds = np.searchsorted(doc, np.arange(len(batch) + 1))
        for k, (d, offset, _) in enumerate(batch):
            lo, hi = bounds[k], bounds[k + 1]
            found[d].append((start[lo:hi] + offset, hashed[lo:hi]))
        batch, size = [], 0

    for d, text in enumerate(docs):
        for at in range(0, max(1, len(text) - length + 1), PIECE_BYTES):
            batch.append((d, at, text[at : at + PIECE_BYTES + length - 1]))
            size += len(batch[-1][2])
            if size >= PIECE_BYTES:
                flush()
    flush()
    return [(np.concatenate([a for a, _ in x]), np.concatenate([h for _, h in x])) for x in found]


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in order of their suffixes, each up to its segment's end; ties by position.

    ``left``: bytes from each position to the end of its segment; 0 marks the padding, of 7 positions after each segment.
    """
    places = np.flatnonzero(left)
    symbol = np.where(left > 0, text.astype(np.uint64) + np.uint64(1), np.uint64(0))
    symbol = np.concatenate([symbol, np.zeros(7, np.uint64)])
    key = np.zeros(len(text), np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | symbol[j : j + len(text)]
    order = np.argsort(key[places], kind="stable")
    suffixes, ordered = places[order], key[places[order]]
    rank = np.zeros(len(text) + 1, np.int64)

    def starts_of(ordered: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first slot, size) of each slot's tie group."""
        new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sizes = np.diff(np.append(new, len(ordered)))
        return np.repeat(slots[new], sizes), np.repeat(sizes, sizes)

    slots = np.arange(len(suffixes))
    group, sizes = starts_of(ordered, slots)
    rank[suffixes] = group + 1
    depth = 7
    active = (sizes > 1) & (left[suffixes] >= depth)
    slots, group = slots[active], group[active]
    while len(slots):
        own = suffixes[slots]
        further = np.where(left[own] > depth, rank[np.minimum(own + depth, len(text))], 0)
        key = (group.astype(np.uint64) << np.uint64(32)) | further.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        own = own[order]
        suffixes[slots] = own
        group, sizes = starts_of(key[order], slots)
        rank[own] = group + 1
        depth *= 2
        active = (sizes > 1) & (left[own] >= depth)
        slots, group = slots[active], group[active]
    return suffixes


def common_prefixes(text: np.ndarray, left: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """For each suffix in order, the bytes it has in common with the one before it (0 for the first), by Kasai's rule."""
    if not len(suffixes):
        return np.array([], np.int64)
    before = np.full(len(text), -2, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    before[suffixes[0]] = -1
    places = np.sort(suffixes)
    prior = before[places]
    # a suffix follows the one before it only if that one and its predecessor start with the same byte
    follows = (places[1:] == places[:-1] + 1) & (prior[1:] == prior[:-1] + 1) & (prior[:-1] >= 0)
    run = np.concatenate([[True], ~(follows & (text[places[:-1]] == text[np.maximum(prior[:-1], 0)]))])
    starts = np.flatnonzero(run)
    # what runs start with is compared, 8 bytes at a time; the rest follows
    a, b = places[starts], prior[starts]
    bound = np.where(b >= 0, np.minimum(left[a], left[np.maximum(b, 0)]), 0)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.ndarray((len(text) + 8,), "<u8", padded, 0, (1,)).copy()
    shared = np.zeros(len(starts), np.int64)
    open_ = np.flatnonzero(bound > 0)
    while len(open_):
        at = shared[open_]
        differ = words[a[open_] + at] ^ words[b[open_] + at]
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs
        same = np.where(differ == 0, 8, (np.bitwise_count(low - np.uint64(1)) // 8))
        shared[open_] = np.minimum(at + same, bound[open_])
        open_ = open_[(differ == 0) & (shared[open_] < bound[open_])]
    of_run = np.cumsum(run) - 1
    at_place = np.zeros(len(text), np.int64)
    at_place[places] = np.maximum(0, shared[of_run] - (places - places[starts][of_run]))
    return at_place[suffixes]


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its windows occur elsewhere in the segments."""
    pad = bytes(7)
    text = np.frombuffer(pad.join(segments) + pad, np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = np.cumsum(sizes + 7) - (sizes + 7)
    left = np.maximum(0, np.repeat(starts + sizes, sizes + 7) - np.arange(len(text)))
    suffixes = suffix_array(text, left)
    far = common_prefixes(text, left, suffixes) >= length
    again = np.zeros(len(text), bool)
    again[suffixes] = far | np.append(far[1:], False)
    return [again[s : s + n - length + 1] for s, n in zip(starts, sizes, strict=True)]


def ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


class Blocks:
    """Blocks of documents in the shared folder."""

    def __init__(self, folder: str):
        self.folder, self.block, self.table = folder, None, None

    def write(self, block: int, docs: list[bytes], found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        filesystem, path = fs.FileSystem.from_uri(self.folder)
        columns = {
            "text": pa.array(docs, pa.large_binary()),
            "start": pa.array([a.tolist() for a, _ in found], pa.list_(pa.int64())),
            "hash": pa.array([h.view(np.int64).tolist() for _, h in found], pa.list_(pa.int64())),
        }
        made = pa.table(columns)
        name = f"{path}/block-{block}"
        import uuid

        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        with filesystem.open_output_stream(temporary) as out, pa.ipc.new_file(out, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
            file.write_table(made)
        filesystem.move(temporary, name)

    def open(self, block: int) -> pa.Table:
        if self.block != block:
            filesystem, path = fs.FileSystem.from_uri(self.folder)
            with filesystem.open_input_file(f"{path}/block-{block}") as file:
                self.table = pa.ipc.open_file(file).read_all().combine_chunks()
            self.block = block
        return self.table

    def text(self, row: int) -> bytes:
        return self.table["text"][row].as_py()

    def anchors(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """(first owned windows and, at the end, the number of windows; hashes)."""
        return self.table["start"][row].values.to_numpy(), self.table["hash"][row].values.to_numpy()


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by ``block``, a block at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(batch.schema.get_field_index("block")).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(lo, hi - lo)
            if held and held[-1].column(0)[0].as_py() != part.column(0)[0].as_py():
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def on_blocks(df: DataFrame, run: Callable[[Blocks, int, pa.Table], Iterator[pa.RecordBatch]], folder: str, schema: str, order: list[str]) -> DataFrame:
    """Bring the rows of each block together, in order, and run over them with the block at hand. ``block`` is the first column."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(folder)
        for block, rows in by_block(batches):
            blocks.open(block)
            yield from run(blocks, block, rows)

    df = df.select("block", *[c for c in df.columns if c != "block"])
    return df.repartition(partitions(df.sparkSession), "block").sortWithinPartitions("block", *order).mapInArrow(each, schema)


def write_blocks(df: DataFrame, key: str, text: str, folder: str, buckets: int, length: int) -> DataFrame:
    """Write the blocks. A row for each document (key, block, row, same: the row of the first equal text of the block, n_bytes,
    whole: SHA-256) and for each block and bucket (bucket, block, hashes: the distinct anchor hashes, twice: those that the block has twice)."""
    schema = "key long, block long, row int, same int, n_bytes long, whole string, bucket int, hashes binary, twice binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks, part = Blocks(folder), TaskContext.get().partitionId()
        docs: list[bytes] = []
        where: dict[bytes, int] = {}
        rows: list[dict] = []
        size = number = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs, where, rows, size, number
            if not rows:
                return
            block = part << 24 | number
            found = document_anchors(docs, length)
            blocks.write(block, docs, found)
            unique, counts = np.unique(np.concatenate([h for _, h in found]), return_counts=True)
            bucket = (unique >> np.uint64(11)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            none = {"bucket": None, "hashes": None, "twice": None}
            out = [{**r, "block": block, **none} for r in rows]
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                if len(own):
                    empty = {"key": None, "row": None, "same": None, "n_bytes": None, "whole": None}
                    out.append({**empty, "block": block, "bucket": b, "hashes": unique[own].tobytes(), "twice": unique[own][counts[own] > 1].tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
            docs, where, rows, size, number = [], {}, [], 0, number + 1

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(data)
                same = where.setdefault(digest.digest(), len(docs))
                if same == len(docs):
                    docs.append(data)
                    size += len(data)
                rows.append({"key": k.as_py(), "row": len(rows), "same": same, "n_bytes": len(data), "whole": digest.hexdigest()})
                if size >= BLOCK_BYTES or len(rows) >= (1 << ROW_BITS) - 1:
                    yield from flush()
        yield from flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    filesystem, path = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return materialise(rows.mapInArrow(run, schema), "substrings-rows")


def repeated_hashes(packed: DataFrame, kind: str = "<u8") -> DataFrame:
    """(block, again): for each block, its anchor hashes that occur twice or more anywhere, a bucket at a time.

    A bucket holds each block's distinct hashes once, so no anchor is larger than the number of blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, bytes]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            own = [np.frombuffer(x[2], kind) for x in held]
            unique, counts = np.unique(np.concatenate(own), return_counts=True)
            again = np.union1d(unique[counts > 1], np.concatenate([np.frombuffer(x[3], kind) for x in held]))
            out = [(x[1], o[np.isin(o, again, assume_unique=True)].tobytes()) for x, o in zip(held, own, strict=True)]
            out = [x for x in out if x[1]]
            yield pa.RecordBatch.from_pydict({"block": pa.array([x[0] for x in out], pa.int64()), "again": pa.array([x[1] for x in out], pa.binary())})

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1][0] != row["bucket"]:
                    yield from flush()
                    held = []
                held.append((row["bucket"], row["block"], row["hashes"], row["twice"]))
        yield from flush()

    rows = packed.select("bucket", "block", "hashes", "twice").repartition(partitions(packed.sparkSession), "bucket")
    return rows.sortWithinPartitions("bucket", "block").mapInArrow(run, "block long, again binary")


def segments_of(again: DataFrame, folder: str, length: int) -> DataFrame:
    """(row: block and document, at: number of the anchor in it, hash, digest, windows) of each segment whose anchor repeats."""

    def run(blocks: Blocks, block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        wanted = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows["again"]]))
        out: dict[str, list] = {k: [] for k in ("row", "at", "hash", "digest", "windows")}
        for d in range(blocks.table.num_rows):
            starts, hashes = blocks.anchors(d)
            if not len(hashes):
                continue
            hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes)
            if not len(hit):
                continue
            text = memoryview(blocks.text(d))
            ends = np.append(starts[1:], len(text) - length + 1)
            out["row"] += [block << ROW_BITS | d] * len(hit)
            out["at"] += hit.tolist()
            out["hash"] += hashes[hit].tolist()
            out["windows"] += (ends - starts)[hit].tolist()
            out["digest"] += [xxhash.xxh3_64_intdigest(text[a : b + length - 1]) - (1 << 63) for a, b in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k in ("at", "windows") else pa.int64()) for k, v in out.items()})

    return materialise(on_blocks(again, run, folder, "row long, at int, hash long, digest long, windows int", []), "substrings-segments")


def segment_texts(chosen: DataFrame, folder: str, length: int) -> DataFrame:
    """Add ``segment`` (its bytes) to rows (row, at, hash, digest, ...)."""

    def run(blocks: Blocks, block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        out, document, text, starts = [], None, b"", np.array([], np.int64)
        for row, at in zip(rows["row"].to_pylist(), rows["at"].to_pylist(), strict=True):
            if row != document:
                document, text = row, blocks.text(row & (1 << ROW_BITS) - 1)
                starts = blocks.anchors(row & (1 << ROW_BITS) - 1)[0]
            end = starts[at + 1] if at + 1 < len(starts) else len(text) - length + 1
            out.append(text[starts[at] : end + length - 1])
        step = 4096
        for lo in range(0, len(out), step):
            part = rows.slice(lo, step).select(["hash", "digest", "different"]).combine_chunks()
            yield from part.append_column("segment", pa.array(out[lo : lo + step], pa.binary())).to_batches()

    chosen = chosen.withColumn("block", F.shiftright("row", ROW_BITS)).select("block", "row", "at", "hash", "digest", "different")
    return on_blocks(chosen, run, folder, "hash long, digest long, different long, segment binary", ["row", "at"])


RANGES = "hash long, digest long, first array<int>, last array<int>"


def shard_ranges(texts: DataFrame, length: int) -> DataFrame:
    """(hash, digest, first, last): ranges of each segment's windows that occur in others of its anchor, by suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        segments: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, segments, size
            if segments:
                found = [ranges(x) for x in repeated_windows(segments, length)]
                rows = [(*k, *r) for k, r in zip(keys, found, strict=True) if r[0]]
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["hash", "digest", "first", "last"])
            keys, segments, size = [], [], 0

        for batch in batches:
            for row in batch.to_pylist():
                if size >= SHARD_BYTES and keys[-1][0] != row["hash"]:  # an anchor stays in one array
                    yield from flush()
                keys.append((row["hash"], row["digest"]))
                segments.append(row["segment"])
                size += len(row["segment"])
        yield from flush()

    texts = texts.select("hash", "digest", "segment").repartition(partitions(texts.sparkSession), "hash")
    return texts.sortWithinPartitions("hash", "digest").mapInArrow(run, RANGES)


def window_digests(segment: bytes, length: int) -> np.ndarray:
    view = memoryview(segment)
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[i : i + length]) for i in range(len(view) - length + 1)]), "S16")


def merged_ranges(texts: DataFrame, length: int) -> DataFrame:
    """Like ``shard_ranges`` for anchors with too many segments for one array, which are cut into shards.

    Each shard's distinct window digests are dealt by range, sorted; those that occur twice or more come back to the shards
    that have them, which look their windows up by binary search.
    """
    buckets = partitions(texts.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, LARGE):
                rows = batch.slice(lo, LARGE)
                yield rows.append_column("block", pa.array([part << 24 | number] * rows.num_rows, pa.int64()))
                number += 1

    texts = texts.select("hash", "digest", "segment").repartition(buckets, "hash", "digest").sortWithinPartitions("hash", "digest")
    shards = materialise(texts.mapInArrow(deal, "hash long, digest long, segment binary, block long"), "substrings-shards", texts=True)

    def pack(table: pa.Table) -> pa.Table:
        found = np.concatenate([window_digests(x.as_py(), length) for x in table["segment"]])
        unique, counts = np.unique(found, return_counts=True)
        bucket = np.frombuffer(unique.tobytes(), "<u4")[::4] % buckets
        out = []
        for b in np.unique(bucket).tolist():
            own = bucket == b
            out.append({"bucket": b, "block": table["block"][0].as_py(), "hashes": unique[own].tobytes(), "twice": unique[own & (counts > 1)].tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("twice", pa.binary())]))

    packed = shards.groupBy("block").applyInArrow(pack, "bucket int, block long, hashes binary, twice binary")
    again = repeated_hashes(packed, "S16")

    def look_up(table: pa.Table, again: pa.Table) -> pa.Table:
        known = np.sort(np.concatenate([np.array([], "S16"), *[np.frombuffer(x.as_py(), "S16") for x in again["again"]]]))
        rows = []
        for row in table.to_pylist():
            own = window_digests(row["segment"], length)
            hit = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
            first, last = ranges(hit)
            if first:
                rows.append({"hash": row["hash"], "digest": row["digest"], "first": first, "last": last})
        return pa.Table.from_pylist(rows, schema=pa.schema([("hash", pa.int64()), ("digest", pa.int64()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32()))]))

    return shards.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(look_up, RANGES)


def cut(found: DataFrame, folder: str, length: int) -> DataFrame:
    """(block, row, n_removed, n_spans, kept_sha256) of each document with repeated windows. ``found``: (row, at, first, last)."""

    def run(blocks: Blocks, block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        document, marks = None, []

        def done() -> None:
            d = document & (1 << ROW_BITS) - 1
            text, starts = memoryview(blocks.text(d)), blocks.anchors(d)[0]
            low = np.concatenate([starts[at] + np.array(x, np.int64) for at, x, _ in marks])
            high = np.concatenate([starts[at] + np.array(x, np.int64) for at, _, x in marks]) + length - 1
            order = np.argsort(low, kind="stable")
            low, high = low[order], np.maximum.accumulate(high[order])
            new = np.concatenate([[True], low[1:] > high[:-1]])  # runs that touch are one
            low, high = low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(high) - 1)]
            kept, at = hashlib.sha256(), 0
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            out.append({"block": block, "same": d, "n_removed": int((high - low).sum()), "n_spans": len(low), "kept_sha256": kept.hexdigest()})

        columns = [rows[c].to_pylist() for c in ("row", "at", "first", "last")]
        for row, at, first, last in zip(*columns, strict=True):
            if row != document:
                if document is not None:
                    done()
                document, marks = row, []
            marks.append((at, first, last))
        if document is not None:
            done()
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    schema = "block long, same int, n_removed long, n_spans long, kept_sha256 string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return on_blocks(found.withColumn("block", F.shiftright("row", ROW_BITS)), run, folder, schema, ["row", "at"])


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """One row for each row of ``df``: key, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``.

    Null and empty texts have no bytes; texts of less than ``length`` bytes lose none. Rows with equal texts, keys equal or
    not, are documents of their own and so repeat each other. An empty table stays empty.
    """
    spark, folder = df.sparkSession, scratch(df.sparkSession, "substrings-blocks")
    buckets = BUCKETS * partitions(spark)
    rows = write_blocks(df, key, text, folder, buckets, length)
    docs = rows.where("bucket is null")
    again = repeated_hashes(rows.where("bucket is not null"))
    segments = segments_of(again, folder, length)
    # texts that a block holds twice or more stand in it once; all their windows repeat
    twins = docs.groupBy("block", "same").count().where("count > 1").select("block", "same")
    merged = segments.groupBy("hash", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at")).alias("one"), F.first("windows").alias("windows"))
    merged = materialise(merged, "substrings-merged")
    different = materialise(merged.groupBy("hash").agg(F.count(F.lit(1)).alias("different")).where("different > 1"), "substrings-different")
    chosen = merged.join(different, "hash").select("one.row", "one.at", "hash", "digest", "different")
    texts = segment_texts(chosen, folder, length)
    found = shard_ranges(texts.where(F.col("different") <= large), length)
    most = different.agg(F.max("different")).first()[0] or 0
    if most > large:
        found = found.unionByName(merged_ranges(texts.where(F.col("different") > large), length))
    found = materialise(found, "substrings-ranges")
    whole = merged.where("n > 1").select("hash", "digest", F.array(F.lit(0)).alias("first"), F.array("windows").alias("last"))
    parts = found.join(merged.where("n > 1").select("hash", "digest"), ["hash", "digest"], "left_anti")
    marks = materialise(whole.unionByName(parts), "substrings-marks")
    places = segments.select("row", "at", "hash", "digest").join(marks, ["hash", "digest"]).select("row", "at", "first", "last")
    gone = cut(places, folder, length)
    out = docs.select("key", "block", "same", "n_bytes", "whole").join(gone, ["block", "same"], "left").join(twins.withColumn("_twin", F.lit(True)), ["block", "same"], "left")
    twin = F.coalesce("_twin", F.lit(False)) & (F.col("n_bytes") >= length)
    return out.select(
        F.col("key").alias(key),
        "n_bytes",
        F.when(twin, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(twin, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(twin, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts, strings of 200 bytes."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return deduplicate(docs)
