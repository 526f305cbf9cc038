"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into segments that form a ring, one more than the bits that may differ. If two fingerprints differ in
few enough bits, some segment starts a chain along the ring whose differences, added up segment by segment, stay within a
budget in proportion to the chain's length. So the first segment of a chain must agree (the key of the shuffle), the second
may differ in one bit (looked up within the key's group), and the longer chains weed out candidates before the full count.

A group never emits its pairs: each task joins what it links into stars, and large-star/small-star rounds over these find the
components. Each distinct fingerprint takes part once, so exact copies cost nothing here.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, discard, materialise, partitions, table

LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Shingles whose bits are counted at once; rows of groups that a task matches at once; pairs looked at at once.
BITS, ROWS, PAIRS = 1 << 15, 1 << 16, 1 << 18
#: Bytes of a sketch of a document's shingles, a low byte of each least hash; least hashes that make one band.
SKETCH, BAND = 128, 4
#: By how much the sketches of pairs worth a count may be less alike than they are asked to be.
MARGIN = 0.2
#: Rows of a group up to which all its pairs are looked at at once, and the neighbours that a row of a larger one meets before.
FEW, NEIGHBOURS = 64, 4
#: A group of more rows than LARGE, and than so many times the mean, is parted by its second segment; one of over MOST rows always.
LARGE, LARGE_TIMES, MOST = 4096, 4, 1 << 20
#: Rows of a group whose sets a task compares; larger groups are compared block by block.
BLOCK_ROWS = 1 << 14
#: The longest chain that is looked up in a group.
MAX_DEPTH = 4


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: each set if it is set in over half of the shingles' hashes. No words: 0."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED)
    words = data.split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    take = max(1, len(words) - shingle + 1)
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    first, last = starts[:take].tolist(), ends[len(words) - take :].tolist()
    for at in range(0, take, BITS):
        hashes = b"".join([digest(data[a:b], seed) for a, b in zip(first[at : at + BITS], last[at : at + BITS], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > take).tobytes(), "big")


def shingle_hashes(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """The set of a document's shingles, as sorted hashes. Fewer words are one shingle."""
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    take = max(1, len(words) - shingle + 1)
    first, last = np.concatenate([[0], ends[:-1] + 1])[:take].tolist(), ends[len(words) - take :].tolist() if words else [0]
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(data[a:b], SEED + 1) for a, b in zip(first, last, strict=False)]), ">u8").astype(np.uint64))


FLIPS, FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, SKETCH), np.uint64)
FACTORS |= np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes in each of SKETCH orders."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[at : at + 512, None] ^ FLIPS) * FACTORS).min(0), out=least)
    return least


def low_bytes(least: np.ndarray) -> bytes:
    return ((least * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)).astype(np.uint8).tobytes()


def sketch(words: list[bytes], shingle: int = 5) -> bytes:
    """SKETCH bytes that agree, in two documents, about as often as their sets of shingles have members in common."""
    return low_bytes(signature(shingle_hashes(words, shingle)))


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each BAND least hashes: documents alike to 0.8 share none of the 32 with a probability of 5e-8."""
    data = least.tobytes()
    size = 8 * BAND
    return np.array([xxhash.xxh64_intdigest(data[i : i + size], i) for i in range(0, len(data), size)], np.uint64).astype(np.int64)


def resembling(sketches: np.ndarray, similar: float):
    """Whether pairs of rows are alike to the degree ``similar``, by their sketches; equal bytes by chance are allowed for."""
    least = SKETCH * (similar + (1 - similar) / 256)

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (sketches[a] == sketches[b]).sum(1) >= least

    return test


def with_fingerprints(df: DataFrame, text: str = "text", keep_text: bool = False, sketches: bool = False) -> DataFrame:
    """Add ``_fp`` (the fingerprint as a signed 64-bit integer); with ``sketches`` also ``_set`` (a digest of the set
    of five-word shingles), ``_bands`` and ``_sketch``."""
    from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

    kept = [f for f in df.schema.fields if keep_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            prints = np.array([fingerprint(x.as_py()) for x in column], np.uint64).astype(np.int64)
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            more = []
            if sketches:
                sets, keys, bodies = [], [], []
                for x in column:  # one document's words at a time
                    words = (x.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
                    hashes = shingle_hashes(words)
                    least = signature(hashes)
                    sets.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                    keys.append(bands(least))
                    bodies.append(low_bytes(least))
                more = [pa.array(np.array(sets, np.uint64).astype(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, pa.array(prints), *more], names=[*[f.name for f in kept], "_fp", *added[1:]])

    added = ["_fp", "_set", "_bands", "_sketch"] if sketches else ["_fp"]
    kinds = [LongType(), LongType(), ArrayType(LongType()), BinaryType()]
    return df.mapInArrow(run, StructType([*kept, *[StructField(n, k) for n, k in zip(added, kinds, strict=False)]]))


def ring(distance: int) -> list[tuple[int, int]]:
    """(shift, bits) of the segments: one more than ``distance``, as equal as can be."""
    m = distance + 1
    sizes = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(m)]


def stars(size: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of ``size`` rows is linked to."""
    label = np.arange(size)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                break
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while True:
                nxt = label[label]
                if (nxt == label).all():
                    break
                label = nxt
    return label


def within(a: np.ndarray, b: np.ndarray, start: int, segments: list[tuple[int, int]], distance: int) -> np.ndarray:
    """Which pairs keep every chain's budget from segment ``start`` on; the longest chain is the full Hamming check."""
    m, good, so_far = len(segments), np.arange(len(a)), np.zeros(len(a), np.int64)
    for n in range(1, m + 1):
        shift, bits = segments[(start + n - 1) % m]
        differ = ((a[good] ^ b[good]) >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        so_far = so_far + np.bitwise_count(differ)
        keep = so_far <= n * distance // m
        good, so_far = good[keep], so_far[keep]
    return good


def expand(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for each j in [left[i], right[i]), in chunks of about PAIRS."""
    n = right - left
    chunk = np.cumsum(n) // PAIRS
    bounds = np.flatnonzero(np.diff(chunk, prepend=-1))
    for lo, hi in zip(bounds, [*bounds[1:], len(n)], strict=True):
        k = n[lo:hi]
        i = np.repeat(np.arange(lo, hi), k)
        yield i, np.repeat(left[lo:hi], k) + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)


def chained(prints: np.ndarray, start: int, segments: list, depth: int) -> tuple[np.ndarray, int]:
    """The second up to the ``depth``-th segment of a chain as one number, the second highest, and its bits."""
    value, bits = np.zeros(len(prints), np.int64), 0
    for n in range(1, depth):
        shift, size = segments[(start + n) % len(segments)]
        part = (prints >> np.uint64(shift)) & np.uint64((1 << size) - 1)
        value, bits = (value << size) | part.astype(np.int64), bits + size
    return value, bits


def masks(start: int, segments: list, distance: int, depth: int) -> list[int]:
    """The flips of those segments that keep the budget of every chain up to ``depth``."""
    m, found = len(segments), [(0, 0)]
    for n in range(2, depth + 1):
        size, budget = segments[(start + n - 1) % m][1], n * distance // m
        grown = []
        for mask, flipped in found:
            for more in range(budget - flipped + 1):
                grown += [(mask << size | sum(1 << b for b in bits), flipped + more) for bits in itertools.combinations(range(size), more)]
        found = grown
    return [mask for mask, _ in found]


def crowding(group: np.ndarray, start: int, segments: list, depth: int) -> float:
    """Rows that a row of the largest group would meet at this depth, if bits were even."""
    bits = sum(segments[(start + n) % len(segments)][1] for n in range(1, depth))
    return float(np.bincount(group - group.min()).max()) / (1 << bits) * bits


def group_pairs(group: np.ndarray, prints: np.ndarray, role: np.ndarray, start: int, segments: list, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (a row each) within groups of equal first segment; rows come sorted by group and second segment.

    Whole groups (role 0) are searched for each second segment that differs in one bit at most, or, where that would meet
    too many rows, for each pair of second and third segments within the budgets of their chains; groups parted by the second
    segment hold the exact rows (role 1) and those that one flipped bit brings there (role 2).
    """
    whole = np.flatnonzero(role == 0)
    if len(whole):
        own, groups = prints[whole], group[whole]
        depth = 2
        while depth < MAX_DEPTH and depth < len(segments) and crowding(groups, start, segments, depth) > len(masks(start, segments, distance, depth + 1)):
            depth += 1
        value, bits = chained(own, start, segments, depth)
        order = np.lexsort((value, groups))
        rows, k = whole[order], (groups[order].astype(np.int64) - groups.min() << bits) | value[order]
        for flip in masks(start, segments, distance, depth):
            goal = k ^ flip
            left, right = np.searchsorted(k, goal, "left"), np.searchsorted(k, goal, "right")
            for i, j in expand(left, right):
                once = i < j
                i, j = rows[i[once]], rows[j[once]]
                good = within(prints[i], prints[j], start, segments, distance)
                yield i[good], j[good]
    exact = np.flatnonzero(role == 1)
    if len(exact):
        left, right = np.searchsorted(group, group[exact], "left"), np.searchsorted(group, group[exact], "right")
        for i, j in expand(left, right):
            i = exact[i]
            once = i != j
            i, j = i[once], j[once]
            good = within(prints[i], prints[j], start, segments, distance)
            yield i[good], j[good]


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """(u, v), v < u: stars that link the nodes (``_fp``, ``node``) whose fingerprints are near; as many rows as fingerprints
    in a group at most. The table of ``large`` groups is small."""
    spark, segments = nodes.sparkSession, ring(distance)
    if distance == 0:  # nodes differ, so nothing is linked
        return spark.createDataFrame([], "u long, v long")
    cut = lambda i: F.shiftrightunsigned("_fp", segments[i % len(segments)][0]).bitwiseAND(F.lit((1 << segments[i % len(segments)][1]) - 1))
    parts = F.array(*[F.struct(F.lit(i).alias("seg"), cut(i).alias("block"), cut(i + 1).alias("second")) for i in range(len(segments))])
    keyed = nodes.select("_fp", "node", F.explode(parts).alias("p")).select("_fp", "node", "p.*")
    total = nodes.count()
    limit = min(MOST, max(LARGE, LARGE_TIMES * total // (1 << segments[0][1])))
    large = keyed.groupBy("seg", "block").count().where(F.col("count") > limit).select("seg", "block", F.lit(True).alias("large"))
    large = materialise(large, "simhash-large")
    if large.limit(1).count():  # seldom: then at most total / limit groups for each segment
        keyed = keyed.join(large, ["seg", "block"], "left").withColumn("large", F.coalesce("large", F.lit(False)))
        flips = F.when(
            F.col("large"),
            F.concat(
                F.array(F.struct(F.lit(1).alias("role"), F.col("second").alias("sub"))),
                F.transform(
                    F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(segments[(i + 1) % len(segments)][1] - 1) for i in range(len(segments))]), F.col("seg") + 1)),
                    lambda b: F.struct(F.lit(2).alias("role"), F.call_function("shiftleft", F.lit(1).cast("long"), b).bitwiseXOR(F.col("second")).alias("sub")),
                ),
            ),
        ).otherwise(F.array(F.struct(F.lit(0).alias("role"), F.lit(-1).cast("long").alias("sub"))))
        keyed = keyed.withColumn("r", F.explode(flips)).select("_fp", "node", "seg", "block", "second", "r.*")
    else:
        keyed = keyed.select("_fp", "node", "seg", "block", "second", F.lit(0).alias("role"), F.lit(-1).cast("long").alias("sub"))
    keyed = keyed.repartition(partitions(spark), "seg", "block", "sub").sortWithinPartitions("seg", "block", "sub", "second", "_fp", "node")

    def linked(part: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        change = np.zeros(len(part["seg"]), bool)
        for name in ("seg", "block", "sub"):
            change[1:] |= part[name][1:] != part[name][:-1]
        group = np.cumsum(change)
        prints = part["_fp"].view(np.uint64)
        for seg in np.unique(part["seg"]).tolist():
            rows = np.flatnonzero(part["seg"] == seg)
            label = stars(len(rows), group_pairs(group[rows], prints[rows], part["role"][rows], seg, segments, distance))
            node = part["node"][rows]
            # the star's centre: the smallest node of the star, whichever row has it
            low = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(low, label, node)
            u, v = node, low[label]
            keep = u > v
            if keep.any():
                edge = np.unique(np.stack([u[keep], v[keep]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_fp", "node", "seg", "block", "second", "role", "sub"]
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            now = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}
            held.append(now)
            size += len(now["seg"])
            if size >= ROWS:
                part = {n: np.concatenate([h[n] for h in held]) for n in names}
                same = (part["seg"] == part["seg"][-1]) & (part["block"] == part["block"][-1]) & (part["sub"] == part["sub"][-1])
                first = int(np.flatnonzero(same)[0])  # the last group may go on
                if first:
                    yield from linked({n: x[:first] for n, x in part.items()})
                held = [{n: x[first:] for n, x in part.items()}]
                size = len(held[0]["seg"])
        if size:
            yield from linked({n: np.concatenate([h[n] for h in held]) for n in names})

    return keyed.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (u, v): the smallest node reachable. Nodes without an edge aren't returned.

    Large-star and small-star rounds until nothing changes; each round's edges are written to the shared folder. A hub's
    edges meet its minimum in a join that adaptive execution can split.
    """
    spark = edges.sparkSession
    edges = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        before = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, before.scratch_path, large.scratch_path)
        if tuple(sums) == state:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
            out.scratch_path = edges.scratch_path
            return out
        state = tuple(sums)


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by ``keys``, a group at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for lo, hi in itertools.pairwise([0, *change.tolist(), len(batch)]):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def likely_pairs(rows: DataFrame, margin: float) -> DataFrame:
    """(a, b), a < b: some pairs of the rows (``key``, ``row``, ``label``, ``_sketch``) of equal key whose labels differ and whose sketches
    are alike to the degree ``margin``: all in groups of up to FEW rows; in larger ones each row meets the first one and
    NEIGHBOURS in the order of sketches, so their number is in proportion to the rows."""

    def pairs(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = np.arange(size)
        if size <= FEW:
            yield from expand(at + 1, np.full(size, size))
        else:
            yield np.zeros(size - 1, np.int64), at[1:]
            for n in range(1, NEIGHBOURS + 1):
                yield at[:-n], at[n:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ["key"]):
            row, label = column(group, "row"), column(group, "label")
            test = resembling(np.frombuffer(b"".join(group["_sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH), margin)
            for i, j in pairs(len(row)):
                for at in range(0, len(i), PAIRS):
                    a, b = i[at : at + PAIRS], j[at : at + PAIRS]
                    apart = label[a] != label[b]
                    a, b = a[apart], b[apart]
                    good = test(a, b)
                    a, b = row[a[good]], row[b[good]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = rows.select("key", "row", "label", "_sketch").repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "_sketch", "row")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def links_between(rows: DataFrame, margin: float, similar: float) -> DataFrame:
    """(u, v), v < u: stars that join the labels of all rows (``key``, ``low``, ``high``, ``own``, ``band``, ``row``, ``label``, ``_bands``, ``_sketch``,
    ``shingles``) of equal (key, low, high) whose sets are alike to the degree ``similar``.

    ``own``: the block of a row; with low < high only rows of different blocks meet. A group's pairs stay in its task: pairs of one
    label, or of labels joined meanwhile, aren't looked at, sketches and the first band that a pair shares tell which are
    counted, and what leaves the task is one link for each label at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ["key", "low", "high"]):
            names, label = np.unique(column(group, "label"), return_inverse=True)
            own, band = column(group, "own"), column(group, "band")[0]
            cross = group["low"][0] != group["high"][0]
            bands = group["_bands"].chunk(0).flatten().to_numpy().reshape(len(own), -1)
            test = resembling(np.frombuffer(b"".join(group["_sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH), margin)
            sets = group["shingles"].chunk(0)
            held: dict[int, frozenset] = {}
            root = np.arange(len(names))

            def members(i: int, sets=sets, held=held) -> frozenset:
                if i not in held:
                    if len(held) >= ROWS:
                        held.clear()
                    held[i] = frozenset(sets[i].values.to_pylist())
                return held[i]

            # labels with few rows meet all others; rows of one label are never paired
            order = np.lexsort((label, np.bincount(label)[label]))
            turn = label[order]
            for i, j in expand(last_of_run(turn), np.full(len(turn), len(turn))):
                a, b = order[i], order[j]
                keep = root[label[a]] != root[label[b]]
                if cross:
                    keep &= own[a] != own[b]
                a, b = a[keep], b[keep]
                good = test(a, b)
                a, b = a[good], b[good]
                good = (bands[a] == bands[b]).argmax(1) == band
                for x, y in zip(a[good].tolist(), b[good].tolist(), strict=True):
                    p, q = root[label[x]], root[label[y]]
                    if p != q:
                        left, right = members(x), members(y)
                        both = len(left & right)
                        if both >= similar * (len(left) + len(right) - both):
                            root[root == max(p, q)] = min(p, q)
            joined = np.flatnonzero(root != np.arange(len(root)))
            if len(joined):
                yield pa.RecordBatch.from_arrays([pa.array(names[joined]), pa.array(names[root[joined]])], names=["u", "v"])

    dealt = rows.repartition(partitions(rows.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high", "row")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def last_of_run(values: np.ndarray) -> np.ndarray:
    """For each place the end of the run of equal values that it is in."""
    new = np.flatnonzero(np.append(values[1:] != values[:-1], True)) + 1
    return new[np.searchsorted(new, np.arange(len(values)), "right")]


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(``row``, ``shingles``) of ``texts`` (``row``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes((x.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()).astype(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["row", "shingles"])

    return texts.select("row", "text").mapInArrow(run, "row long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(u, v) of the pairs (a, b) whose sets are alike to the degree ``similar``, by count."""
    of = lambda x: sets.select(F.col("row").alias(x), F.col("shingles").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", both)
    return alike.where(F.col("both") / (F.size("sa") + F.size("sb") - F.col("both")) >= similar).select(F.col("b").alias("u"), F.col("a").alias("v"))


def similar_links(nodes: DataFrame, texts: DataFrame, known: DataFrame, similar: float) -> DataFrame:
    """(u, v): the links ``known`` and enough of those between ``nodes`` (``row``, ``_bands``, ``_sketch``) alike to the degree
    ``similar`` to make the same components as all of them.

    Nodes that share a band and whose sketches come near are compared by their sets of shingles. First each meets a number of
    others that doesn't grow with its group. Then only groups of over FEW rows that hold several components are looked at in
    full, each in one task or, if it has over BLOCK_ROWS rows, in a task for each two blocks of it; their sets go there, and no pair
    leaves a task.
    """
    spark = nodes.sparkSession
    over = Window.partitionBy("key")
    keyed = nodes.select("row", F.posexplode("_bands").alias("band", "key"))
    shared = keyed.withColumn("n", F.count(F.lit(1)).over(over)).where("n > 1")
    shared = materialise(shared, "bands")
    sets = materialise(shingle_sets(texts.join(shared.select("row").distinct(), "row")), "sets", texts=True)
    marked = nodes.select("row", "_sketch", "_bands")

    def apart(rows: DataFrame, found: DataFrame) -> DataFrame:
        """Rows with their component as ``label``, of groups that hold several."""
        rows = rows.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("component", "row"))
        return rows.drop("component").withColumns({"_lo": F.min("label").over(over), "_hi": F.max("label").over(over)}).where("_lo != _hi").drop("_lo", "_hi")

    before = components(known)
    first = apart(shared, before).join(marked.drop("_bands"), "row")
    pairs = materialise(likely_pairs(first, similar - MARGIN), "pairs")
    known = materialise(known.unionByName(confirmed(pairs, sets, similar)), "links")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    after = components(known)
    rest = apart(shared.where(F.col("n") > FEW), after).withColumn("own", F.pmod(F.xxhash64("row"), blocks).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "n")
    rest = materialise(rest, "bands")  # rows that few documents are in, as a rule
    found = links_between(rest.join(marked, "row").join(sets, "row"), similar - MARGIN, similar)
    out = materialise(known.unionByName(found), "links")
    discard(spark, *[x.scratch_path for x in (shared, sets, before, pairs, known, after, rest)])
    return out


def labelled(marked: DataFrame, key: str, distance: int, similar: float | None = None, text: str = "text") -> DataFrame:
    """(``_fp``, ``root``, ``component_id``) for each fingerprint of ``marked`` (with ``_row``, a number for each row), written to the
    shared folder: a plain scan, so that a join with it can be split where a fingerprint is frequent.

    A fingerprint's node is its first row, so each is a node of its own whatever the keys are; ``component_id`` is the smallest key
    of a component, null if it has none. With ``similar``, links between similar sets of shingles come on top; each distinct set
    takes part, as its first row, tied to the fingerprints it occurs with."""
    nodes = marked.groupBy("_fp").agg(F.min("_row").alias("node"), F.min(F.col(key).cast("long")).alias("least"))
    nodes = materialise(nodes, "nodes")
    found = links(nodes.select("_fp", "node"), distance)
    done = [nodes.scratch_path]
    if similar is not None:
        sets = marked.groupBy("_set").agg(F.min(F.struct(F.col("_row").alias("row"), "_bands", "_sketch")).alias("first")).select("_set", "first.*")
        sets = materialise(sets, "sets")
        ties = marked.select("_fp", "_set").distinct().join(nodes.select("_fp", F.col("node").alias("v")), "_fp").join(sets.select("_set", F.col("row").alias("u")), "_set")
        found = materialise(found.unionByName(ties.where("u != v").select("u", "v")), "links")
        done += [sets.scratch_path, found.scratch_path]
        found = similar_links(sets, marked.select(F.col("_row").alias("row"), F.col(text).alias("text")), found, similar)
        done.append(found.scratch_path)
    whole = components(found)
    labels = nodes.join(whole, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    out = materialise(labels.select("_fp", "root").join(least, "root").select("_fp", "root", "component_id"), "labels")
    discard(marked.sparkSession, *done, whole.scratch_path)
    return out


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, keep_text: bool = False) -> DataFrame:
    """Add ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest key reachable over links of at most ``distance``
    differing bits, its own included) to each row.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null key link like any other too; a component
    of such rows only has a null id. Repeated rows and keys share what their texts say, and different texts under one key
    aren't linked by it. An empty table stays empty. A very long text is fingerprinted in stretches of BITS shingles.
    ``keep_text=False`` drops the text; other columns pass through, columns of the names above are replaced (one that holds the
    texts or keys is read first), and names beginning with ``_`` are reserved.
    """
    names = ["fingerprint", "component_id"]
    spare = df.drop(*[n for n in names if n not in (key, text)]).withColumn("_row", F.monotonically_increasing_id())
    marked = materialise(with_fingerprints(spare, text, keep_text), "fingerprints", texts=keep_text)
    labels = labelled(marked, key, distance).withColumnRenamed("component_id", "_component")
    out = marked.join(labels, "_fp").withColumns({"fingerprint": F.lpad(F.lower(F.hex("_fp")), 16, "0"), "component_id": F.col("_component")})
    return out.drop("_fp", "_row", "root", "_component")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, similar: float | None = None) -> DataFrame:
    """The row of the smallest key of each component; of repeated rows one; of a component whose keys are all null one.
    Columns stay as they are; names beginning with ``_`` are reserved. An empty table stays empty.

    ``similar``: documents whose sets of five-word shingles have this share of their union in common, by count, are linked too.
    Fingerprints of shingles seldom come as near for them.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    marked = materialise(with_fingerprints(rows, text, True, similar is not None), "fingerprints", texts=True)  # here row numbers become fixed
    labels = labelled(marked, key, distance, similar, text)
    small = marked.select("_row", "_fp", F.col(key).alias("_key")).join(labels, "_fp")
    first = F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_row"))
    kept = small.groupBy("root").agg(first.alias("first")).select("first._row")
    return marked.join(kept, "_row", "left_semi").drop("_row", "_fp", "_set", "_bands", "_sketch")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints and components."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
