"""Quality rules combined by weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the whole corpus estimates how often each
rule gives each vote on good and on bad documents, without labels; the posterior probability of "good" replaces the usual
"all rules must pass". EM needs only how often each combination of votes occurs: that table is counted on the executors,
and its size is bound by the rules (3 to the power of their number), not by the data.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SYMBOLS = [c.encode() for c in "#*$%&|<>"]
SPACES = " \t\n\v\f\r"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
STARTS = bytes([*range(128), *range(192, 256)])  # the first byte of each character
ALPHABETIC = LETTERS + bytes(range(128, 256))
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_short", "n_bytes", "n_alphabetic", "n_capitals", "n_letters"]
#: Name, vote as SQL over FEATURES: 1 good, 0 bad, null abstains.
VOTES = {
    "symbols": "case when n_symbols > 0.1 * n_words then 0 when n_symbols <= 0.02 * n_words then 1 end",
    "lines": "case when n_dup_lines > 0.5 * n_lines then 0 when n_lines >= 3 and n_dup_lines <= 0.05 * n_lines then 1 end",
    "repeats": "case when n_repeat_words > 0.4 * n_words then 0 when n_repeat_words <= 0.1 * n_words then 1 end",
    "short": "case when n_short < 0.02 * n_words then 0 when n_short >= 0.08 * n_words then 1 end",
    "length": "case when word_chars < 2.5 * n_words or word_chars > 12 * n_words then 0 when word_chars <= 10 * n_words then 1 end",
    "letters": "case when n_alphabetic < 0.7 * n_bytes then 0 when n_alphabetic >= 0.85 * n_bytes then 1 end",
    "capitals": "case when n_capitals > 0.5 * n_letters then 0 when n_capitals <= 0.2 * n_letters then 1 end",
    "size": "case when n_words < 50 then 0 when n_words >= 100 then 1 end",
}
#: The longest word, in characters, that counts as short. Prose of any language with spaces repeats its short words (articles, particles,
#: conjunctions); lists, codes and random words don't.
SHORT = 4
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
#: Before any document is seen a rule is right this often, as if it had been seen on so many documents.
PRIOR_RIGHT, PRIOR_ROWS = 0.8, 20.0
#: A rule is right more often than this on its own kind of bad documents, or the kind would not be its own.
LEAST_RIGHT = 0.5
#: Rules at most: the table of vote combinations, which the driver holds, has up to 3 to this power of rows.
MAX_RULES = 12


def features(text: str | None) -> tuple[int, ...]:
    """FEATURES of one whole text; a null text has none of anything."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at just the ASCII white space that parts words here
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        counts, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeats += i + 3 - max(i, until)
                until = i + 3
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(data.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        sum(k for w, k in Counter(data.lower().split()).items() if k > 1 and len(w) <= 4 * SHORT and len(w) - len(w.translate(None, STARTS)) <= SHORT),
        sum(map(len, words)),
        len(data) - len(data.translate(None, ALPHABETIC)),
        len(data) - len(data.translate(None, CAPITALS)),
        len(data) - len(data.translate(None, LETTERS)),
    )


def with_features(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add FEATURES to each row, by Arrow batches; columns of these names are replaced, a text column of such a name is read first."""
    from pyspark.sql.types import LongType, StructField, StructType

    kept = [f for f in df.schema.fields if f.name not in FEATURES and (keep_text or f.name != text)]
    schema = StructType([*kept, *[StructField(x, LongType()) for x in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = np.array([features(x.as_py()) for x in batch.column(at)], np.int64).reshape(-1, len(FEATURES))
            columns = [pa.array(found[:, i]) for i in range(len(FEATURES))]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, *columns], names=[*[f.name for f in kept], *FEATURES])

    return df.mapInArrow(run, schema)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, tolerance: float = 1e-10) -> dict:
    """EM over one good class and, for each rule, the class of bad documents that this rule is about.

    Bad documents are bad in different ways, and most rules see only one of them; a single bad class would settle on the
    most common way and pass the others. Votes are independent given the class, and abstaining says nothing. ``patterns``: (combinations, rules) of
    0 bad, 1 good, -1 abstain; ``counts``: documents of each. Returns ``posterior`` of good for each combination, the
    ``share`` of each class (good last), ``p[class, rule, vote]``, and each rule's ``accuracy`` on its own kind of bad documents.
    All of them are estimated, under a Beta prior (see PRIOR_ROWS); it and LEAST_RIGHT keep classes from changing places and a
    corpus of one class from falling apart.
    """
    rules = patterns.shape[1]
    seen = np.stack([patterns == v for v in range(2)], 2).astype(float)  # combination, rule, vote
    rate = (seen * counts[:, None, None]).sum(0) + 1e-3 * max(1.0, counts.sum())
    prior = np.repeat((rate / rate.sum(1, keepdims=True))[None], rules + 1, 0)
    prior[rules, :, 0] *= 1 - PRIOR_RIGHT
    for r in range(rules):
        prior[r, r] = [PRIOR_RIGHT, 1 - PRIOR_RIGHT]
    prior /= prior.sum(2, keepdims=True)
    own = np.arange(rules)
    p, share, before = prior.copy(), np.array([0.5 / rules] * rules + [0.5]), -np.inf
    post = np.full((rules + 1, len(patterns)), 1 / (rules + 1))
    for _ in range(rounds):
        log = np.einsum("krv,crv->ck", seen, np.log(p)) + np.log(share)[:, None]
        top = log.max(0)
        each = np.exp(log - top)
        post = each / each.sum(0)
        total = float((counts * (top + np.log(each.sum(0)))).sum())
        if total - before < tolerance * abs(total):
            break
        before = total
        got = np.einsum("ck,krv->crv", post * counts, seen) + PRIOR_ROWS * prior
        p = got / got.sum(2, keepdims=True)
        right = np.maximum(p[own, own, 0], LEAST_RIGHT)
        p[own, own] = np.stack([right, 1 - right], 1)
        share = (post * counts).sum(1) + PRIOR_ROWS / (rules + 1)
        share /= share.sum()
    return {"posterior": post[rules], "share": share, "p": p, "accuracy": p[own, own, 0]}


def learn(patterns: DataFrame, rules: int) -> tuple[list[tuple[str, float]], dict]:
    """(pattern, posterior) of each combination of votes in ``patterns`` (``_pattern``), and the model. Combinations are counted where
    the documents are."""
    if rules > MAX_RULES:
        raise ValueError(f"{rules} rules; at most {MAX_RULES}")
    found = patterns.groupBy("_pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules rows
    keys = [r["_pattern"] for r in found]
    model = fit(np.array([list(map(int, k.split(","))) for k in keys], int).reshape(len(keys), rules), np.array([r["n"] for r in found], float))
    return list(zip(keys, map(float, model["posterior"]), strict=True)), model


def judge(df: DataFrame, text: str = "text", votes: dict[str, str] | None = None, keep_text: bool = True) -> DataFrame:
    """Add FEATURES, ``quality`` (posterior probability of good), ``base_failed`` and ``kept`` to each row.

    Kept: the base rules hold and good is at least as likely as not. Null and empty texts have no words and fail.
    ``keep_text=False`` drops the text and writes the features to the shared folder; with texts they are computed once
    to count votes and once to judge, which costs less than a copy of the corpus.
    An empty table stays empty. A very long text's words are held in memory, some 100 bytes for each. Columns of the names above
    are replaced; names beginning with ``_`` are reserved.
    """
    votes = votes or VOTES
    spark = df.sparkSession
    gone = [c for c in ("quality", "base_failed", "kept") if c != text]
    marks = with_features(df.drop(*gone), text, keep_text)
    if not keep_text:
        marks = materialise(marks, "quality")
    pattern = F.concat_ws(",", *[F.coalesce(F.expr(sql), F.lit(-1)).cast("string") for sql in votes.values()])
    marks = marks.withColumn("_pattern", pattern)
    posterior = spark.createDataFrame(learn(marks, len(votes))[0], "_pattern string, quality double")
    out = marks.join(F.broadcast(posterior), "_pattern", "left").drop("_pattern")
    failed = F.expr(BASE_FAILED)
    return out.withColumns({"base_failed": failed, "kept": ~failed & (F.col("quality") >= 0.5)})


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' counts and verdicts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )
