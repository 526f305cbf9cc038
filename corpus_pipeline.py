"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads it
back as the next stage's docs. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.llm import decontaminate, mixing, quality, sharding, simhash
from pipewright.llm.common import discard, made, materialise, table

#: SimHash components and EM posteriors are beyond SQL; the tests hold ``run`` against a brute-force version.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each component: fingerprints at most 4 bits apart, or at least 0.8 of the
    five-word shingles in common."""
    return simhash.one_of_each(docs, similar=0.8).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the last one of a source rounded to whole documents."""
    return mixing.draw(docs).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their ``shard`` (0 to 7) and ``slot``."""
    return sharding.interleave(docs, 8)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns. What a stage wrote for itself goes once its result is written, and that once the next
    stage's result is; only what the last stage reads stays until the program ends."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before = made()
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = materialise(out, "pipeline", texts=True)
            own = [p for p in made() if p not in before and p != out.scratch_path]
            discard(spark, *own, *([docs.scratch_path] if i else []))
        docs = out
    return docs
