"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of order 3: after each context of up to three bytes, how often each byte followed.
A byte that its longest context knows costs its share there; else the escape probability, and the next shorter context
is asked, down to a uniform share of all 256 bytes. Escapes are PPM method C (distinct / (total + distinct)), without exclusion.
The statistics are frozen after training, so the code length of a text is a sum over its bytes and is exact.

Languages are independent of each other, so they are learned in groups of GROUP, each by one task that writes its trees to
the shared folder; any number of languages is learned, and neither the driver nor a task holds more than a group. Trees of a
group share their nodes, so a batch of texts is scored by a few array lookups for each byte, for all its languages at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, scratch, table

#: The training sample of each language: texts and bytes at most (one text at least). Of a text of more than TRAIN_BYTES a stretch of
#: about that many bytes is learned, from a place chosen by hash, so long texts are in the sample like others.
TRAIN_TEXTS, TRAIN_BYTES, LANGUAGE_BYTES = 400, 32_768, 1 << 20
#: The most frequent languages whose texts are thinned by a broadcast table; those of others are all sorted to find their sample.
THINNED = 10_000
#: Languages that are learned and scored at once, about, and bytes of trees that a scoring task keeps at hand.
GROUP, HELD_BYTES = 8, 256 << 20
#: Entries of a dense table of children; a level with more is looked up by binary search.
DENSE = 1 << 24
#: Bytes scored at once.
BLOCK = 1 << 20
ORDER = 3


def held_out(key):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(lang, h, text): the training sample, by hash of key and text. Rows are thinned before any sort; equal rows count once."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)))
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(3), "key", F.crc32(F.col("text").cast("binary"))), 1))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))  # equal rows have one hash, so they are no sample
    # texts stay where they are until they are thinned, so what is broadcast has a bound; languages beyond it have few texts
    counts = counts.where(F.col("n") > 2 * TRAIN_TEXTS).orderBy(F.desc("n"), "lang").limit(THINNED)
    limit = F.coalesce(F.lit(2.0 * TRAIN_TEXTS) / F.col("n"), F.lit(1.0)) * float(2**63)
    some = rows.join(F.broadcast(counts), "lang", "left").where(F.col("h") <= limit)
    long = F.length("text") - TRAIN_BYTES
    stretch = F.substring(F.col("text"), F.when(long > 0, F.pmod("h", long + 1)).otherwise(F.lit(0)).cast("int") + 1, F.lit(TRAIN_BYTES))
    some = some.groupBy("lang", "h").agg(F.min(stretch).alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumns({"place": F.row_number().over(order), "before": before})
    return some.where((F.col("place") <= TRAIN_TEXTS) & ((F.col("before") < LANGUAGE_BYTES - TRAIN_BYTES) | (F.col("place") == 1))).select("lang", "h", "text")


class Trees:
    """The context trees with frozen statistics.

    Level ``o`` holds every string of ``o`` bytes seen in training in any language, numbered from 1; 0 is a string never
    seen. ``child[o]`` leads from a string and a byte to the string one byte longer. ``cost[o]`` has, for each string of
    ``o + 1`` bytes and each language, the bits that its last byte costs after the bytes before it, all escapes
    included; ``escape[o]`` the bits of an escape from a context of ``o`` bytes.
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        if not texts:  # nothing to learn from
            return
        pad = b"\n" * ORDER
        streams = [np.frombuffer(b"".join(pad + t for t in texts[k]) or pad, np.uint8) for k in self.languages]
        seen = np.unique(np.concatenate(streams))
        self.code = np.zeros(256, np.int64)  # 0: a byte that training never saw
        self.code[seen] = np.arange(1, len(seen) + 1)
        a = self.size = len(seen) + 1
        coded = [self.code[x] for x in streams]
        nodes = [np.ones(len(x), np.int64) for x in coded]
        shorter = None  # entries of the level before, by language and position
        self.child, self.cost, self.escape = [], [], []
        self.dense, count = [], 1
        for order in range(ORDER + 1):
            keys = [n * a + x for n, x in zip(nodes, coded, strict=True)]
            known = np.unique(np.concatenate([k[n > 0] for k, n in zip(keys, nodes, strict=True)]))
            child = known if (count + 1) * a > DENSE else np.zeros((count + 1) * a, np.int32)
            self.dense.append(child is not known)
            if child is not known:
                child[known] = np.arange(1, len(known) + 1)
            self.child.append(child)
            entries = [self.children(order, k) for k in keys]
            owner = known // a
            suffix = np.zeros(len(known) + 1, np.int64)
            if shorter is not None:
                for e, s in zip(entries, shorter, strict=True):
                    suffix[e] = s
            escape = np.zeros((count + 1, len(streams)))
            cost = np.zeros((len(known) + 1, len(streams)))
            for j, e in enumerate(entries):
                n = np.bincount(e, minlength=len(known) + 1)[1:].astype(float)
                total = np.bincount(owner, n, count + 1)
                distinct = np.bincount(owner, n > 0, count + 1)
                ever = total > 0
                escape[ever, j] = np.log2((total + distinct)[ever] / distinct[ever])
                below = self.cost[-1][suffix[1:], j] if order else np.full(len(known), 8.0)
                own = np.log2(np.maximum(1, total + distinct)[owner] / np.maximum(n, 1))
                cost[1:, j] = np.where(n > 0, own, escape[owner, j] + below)
            self.cost.append(cost.astype(np.float32))
            self.escape.append(escape.astype(np.float32))
            nodes = [np.concatenate([[0], e[:-1]]) for e in entries]
            shorter, count = entries, len(known)

    def children(self, order: int, keys: np.ndarray) -> np.ndarray:
        """The strings that keys (a string's number times the alphabet, and a byte) lead to."""
        child = self.child[order]
        if self.dense[order]:
            return child[keys].astype(np.int64)
        at = np.minimum(np.searchsorted(child, keys), len(child) - 1)
        return np.where(child[at] == keys, at + 1, 0)

    def size_bytes(self) -> int:
        return sum(x.nbytes for part in (self.child, self.cost, self.escape) for x in part) if self.languages else 0

    def bits(self, data: np.ndarray) -> np.ndarray:
        """(bytes, languages): the bits of each byte; the first ORDER bytes only give context."""
        x = self.code[data]
        node, entries, contexts = np.ones(len(x), np.int64), [], []
        for order in range(ORDER + 1):
            contexts.append(node)
            entry = self.children(order, node * self.size + x)
            entries.append(entry)
            node = np.concatenate([[0], entry[:-1]])
        out = self.cost[ORDER][entries[ORDER]]
        rest = np.flatnonzero(entries[ORDER] == 0)
        for order in range(ORDER, -1, -1):
            if not len(rest):
                break
            out[rest] += self.escape[order][contexts[order][rest]]
            if order:
                entry = entries[order - 1][rest]
                out[rest] += self.cost[order - 1][entry]
                rest = rest[entry == 0]
            else:
                out[rest] += 8.0
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): code lengths in bits. Long texts go piece by piece, with their context."""
        total = np.zeros((len(texts), len(self.languages)))
        pieces: list[bytes] = []
        owners: list[int] = []
        held = 0

        def flush():
            nonlocal held
            if pieces:
                lengths = np.array([len(p) for p in pieces])
                bits = self.bits(np.frombuffer(b"".join(pieces), np.uint8))
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                for o in range(ORDER):
                    bits[starts + o] = 0
                np.add.at(total, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))
            pieces.clear()
            owners.clear()
            held = 0

        for i, text in enumerate(texts):
            whole = b"\n" * ORDER + text
            for at in range(0, len(text), BLOCK):
                pieces.append(whole[at : at + BLOCK + ORDER])
                owners.append(i)
                held += len(pieces[-1])
                if held >= BLOCK:
                    flush()
        flush()
        return total


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[str]:
    """Learn every language of ``df``; the names of the groups' files in the shared folder.

    The driver gets these names only. Rows with a null text or language teach nothing; languages whose
    documents are all held out aren't learned; without any there are no files.
    """
    spark = df.sparkSession
    found = materialise(sample(df, key, text, lang), "languages-sample")
    languages = found.select("lang").distinct().count()
    groups = 1 if languages <= GROUP else -(-2 * languages // GROUP)
    texts = found.withColumn("group", F.pmod(F.xxhash64("lang"), F.lit(groups)).cast("int"))
    folder = scratch(spark, "languages")
    filesystem, path = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)

    def learn(rows: pa.Table) -> pa.Table:
        import uuid

        by_lang: dict[str, list[bytes]] = {}
        for row in rows.sort_by([("lang", "ascending"), ("h", "ascending")]).to_pylist():
            by_lang.setdefault(row["lang"], []).append(row["text"].encode("utf-8", "surrogatepass"))
        group = rows["group"][0].as_py()
        filesystem, path = fs.FileSystem.from_uri(folder)
        temporary, name = f"{path}/{uuid.uuid4().hex}.tmp", f"{path}/group-{group:06d}"
        with filesystem.open_output_stream(temporary) as out:
            out.write(cloudpickle.dumps(Trees(by_lang), 5))
        filesystem.move(temporary, name)  # a task that runs twice leaves one whole file
        return pa.table({"group": pa.array([group], pa.int32())})

    made = texts.select("group", "lang", "h", "text").groupBy("group").applyInArrow(learn, "group int").collect()
    return [f"{folder}/group-{g:06d}" for g in sorted(r["group"] for r in made)]


class Models:
    """The groups' trees, of which as many stay in memory as HELD_BYTES allow, one at least."""

    def __init__(self, paths: list[str]):
        self.paths, self.held = paths, {}

    def __iter__(self) -> Iterator[Trees]:
        for path in self.paths:
            trees = self.held.get(path)
            if trees is None:
                filesystem, name = fs.FileSystem.from_uri(path)
                with filesystem.open_input_file(name) as file:
                    trees = pickle.loads(file.read())
                if not self.held or sum(t.size_bytes() for t in self.held.values()) + trees.size_bytes() <= HELD_BYTES:
                    self.held[path] = trees
            yield trees


def identify(df: DataFrame, models: list[str], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to each row, from the text alone. ``models``: what ``train`` returns.

    The shortest code wins, the first name of equals; the score is its posterior probability if all languages are as likely.
    Null texts, texts without a letter, and all texts if nothing was learned: ``und`` and 0. Whole texts are scored, in
    pieces of BLOCK bytes with their context, so a very long text takes time in proportion and no more memory. Other columns
    pass through; columns of the names above are replaced (one that holds the texts is read first). An empty table stays empty.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    names = ["lang_pred", "score"]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Models(models)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            best, least, weight = ["und"] * len(texts), np.full(len(texts), np.inf), np.zeros(len(texts))
            rows = [i for i, x in enumerate(texts) if models and x and any(map(str.isalpha, x))]
            data = [texts[i].encode("utf-8", "surrogatepass") for i in rows]
            for trees in known if rows else ():
                bits = trees.score(data)
                low = bits.min(1)
                share = np.exp2(low[:, None] - bits).sum(1)  # of this group, against its own best
                for i, j, b, w in zip(rows, bits.argmin(1).tolist(), low.tolist(), share.tolist(), strict=True):
                    if (b, trees.languages[j]) < (least[i], best[i]):
                        best[i], least[i], weight[i] = trees.languages[j], b, w + weight[i] * 2.0 ** (b - least[i])
                    else:
                        weight[i] += w * 2.0 ** (least[i] - b)
            score = np.where(weight > 0, 1 / np.maximum(weight, 1), 0.0)
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*[f.name for f in kept], *names])

    return df.mapInArrow(run, schema)


def op10_identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by trees learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    models = train(docs.select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), models)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
