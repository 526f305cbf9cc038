"""Entry points: ``run`` a query, or ``pipe`` a DataFrame through operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .lang.parser import parse, parse_pipe
from .plans.planner import Plan, bind_operations, plan_query
from .sources import FrameSource, prepare

#: What the language needs of a session.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.sizeOfNull": "false",
    "spark.sql.adaptive.enabled": "true",
}


def configured(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def plan(spark: SparkSession, text: str, stdin=None, base: str | None = None) -> Plan:
    """Parse, bind and type-check a query; no row is read but a sample for inference. The output stage, if any, is left out."""
    return plan_query(configured(spark), parse(text), stdin, base)


def run(spark: SparkSession, text: str, ordered: bool = False, stdin=None, base: str | None = None) -> DataFrame:
    """A query as a lazy DataFrame. ``ordered``: sorted in the language's row order."""
    return plan(spark, text, stdin, base).dataframe(ordered)


def pipe(df: DataFrame, text: str, ordered: bool = False, base: str | None = None) -> DataFrame:
    """``df`` through operations, as ``filter {...} | select a, b``."""
    spark = configured(df.sparkSession)
    once = lambda source: prepare(spark, source, None, base)
    return bind_operations(FrameSource(df), parse_pipe(text), once).dataframe(ordered)
