"""URL filters by host-suffix and path-prefix expressions.

Each URL's host gives its suffixes at label bounds, its path the prefixes of the lengths that rules have. Every pair is an
expression; the first bytes of its SHA-256 are the key of an equi-join with the rules, the full digest confirms a match, and
the longest rule wins. What is expanded is each distinct host and path stem once, so a host with most URLs costs one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (action, host, path)
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Rules whose texts have up to so many bytes are broadcast, with some 150 bytes more for each rule; more are joined by a shuffle.
MAX_BROADCAST_BYTES = 16 << 20
#: Hosts and stems with over HOT pages, and over a MOST_HOT-th of all (so there are fewer than that), are split into DEALS parts for
#: the join with what was found for them.
HOT, MOST_HOT, DEALS = 10_000, 10_000, 64


def url_parts(url):
    """(host, path) columns. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path:
    from there up to ``?``, ``#`` or the end. Both are empty if the URL is null or has no ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (host and path of the winning rule, or null) and ``verdict`` to each row.

    A rule (action, host, path) fits its host and every subdomain, if the path starts with the rule's. The longest rule
    string wins; of equal lengths the one with the longer host, then ``block``. No rule: ``default``. Null and malformed
    URLs have empty host and path and get ``default``. Rules with nulls are ignored, repeated ones count once. Other columns
    pass through; columns of the names above are replaced (a URL column of such a name is read first); names beginning with
    ``_`` are reserved. An empty table stays empty. A very long host costs time in proportion to its length: only its last
    labels, as many as a rule has, are expanded.
    """
    rules = rules.dropna(subset=["action", "host", "path"]).select("action", ascii_lower(F.col("host")).alias("host"), "path").distinct()
    depth = F.size(F.split("host", r"\.", -1))
    size = F.sum(F.octet_length("host") + F.octet_length("path") + 150)
    bounds = rules.agg(size, F.max(F.length("path")), F.sort_array(F.collect_set(F.length("path"))), F.max(depth)).first()
    count, longest, lengths, labels_most = bounds[0] or 0, bounds[1] or 0, bounds[2] or [], bounds[3] or 1
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    known = rules.select(
        F.concat("host", "path").alias("rule"), "action", F.length(F.concat("host", "path")).alias("_len"),
        F.length("host").alias("_hostlen"), digest(F.col("host"), F.col("path")).alias("_digest"),
    )
    known = known.withColumn("_prefix", F.substring("_digest", 1, 2 * prefix_bytes))
    host, path = url_parts(F.col(url))
    pages = pages.withColumns({"_host": host, "_path": path}).drop("host", "path", "rule", "verdict")
    pages = pages.withColumnsRenamed({"_host": "host", "_path": "path"})
    pages = pages.withColumn("_stem", F.left(F.col("path"), F.lit(longest)))
    salt = [c for c, kind in pages.dtypes if kind in ("bigint", "int", "string")]
    targets = pages.groupBy("host", "_stem").agg(F.count(F.lit(1)).alias("_n"))
    # only suffixes of as many labels as a rule has: the rest of a host, however long, plays no part
    near = F.substring_index("host", ".", -labels_most)
    labels = F.split(near, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.left(F.col("_stem"), n))
    pairs = targets.withColumn("_prefixes", F.array_distinct(prefixes)).withColumn("_host", F.explode(suffixes))
    pairs = pairs.withColumn("_path", F.explode("_prefixes")).withColumn("_full", digest(F.col("_host"), F.col("_path")))
    pairs = pairs.select("host", "_stem", "_n", "_full", F.substring("_full", 1, 2 * prefix_bytes).alias("_prefix"))
    found = pairs.join(F.broadcast(known) if count <= MAX_BROADCAST_BYTES else known, "_prefix").where("_full = _digest")
    best = F.max(F.struct("_len", "_hostlen", F.col("action") == "block", "rule", "action"))
    found = found.groupBy("host", "_stem").agg(best.alias("_best"), F.first("_n").alias("_n"))
    # A host may hold most rows. What was found for a frequent one goes to all DEALS of its pages, what was found for another to all
    # of its pages in one: the deal of a page is its own for the first kind (fewer than MOST_HOT, so a broadcast), and 0 for the second.
    found = found.withColumn("_deals", F.when(F.col("_n") > max(HOT, pages.count() // MOST_HOT), F.lit(DEALS)).otherwise(F.lit(1)))
    hot = found.where("_deals > 1").select("host", "_stem", F.lit(True).alias("_hot"))
    pages = pages.join(F.broadcast(hot), ["host", "_stem"], "left")
    pages = pages.withColumn("_deal", F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt), F.lit(DEALS))).otherwise(F.lit(0)).cast("int"))
    found = found.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).drop("_deals", "_n")
    out = pages.join(found, ["host", "_stem", "_deal"], "left")
    out = out.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.action", F.lit(default))})
    return out.drop("_stem", "_best", "_deal", "_hot")


def op1_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against RULES."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")
