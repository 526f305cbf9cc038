import re

import duckdb
import pytest

from pipewright.llm import urls
from pipewright.llm.queries import ORACLES

URLS = [
    None, "", "nonsense", "http://", "https://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/en", "http://example.net/en/",
    "http://badexample.net/en/", "http://a.example.com/de/x", "http://example.com/fr/de/", "http://x.org/fr/", "x://org/fr/?q", "http://org/fr?/fr/",
    "http://a..net/", "http://net/", "http://net.org/", "http://u:p@h.net:80/a", "http://e.net?x=/en/", "http://e.net#/", "a://b://c.net/", "http://ÉX.NET/Ä",
    "http://x.net/a\nb?c", "http://" + "a." * 300 + "net/" + "p/" * 2000,
]


def brute(url, rules=urls.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def rows(df):
    return {(r["id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}


@pytest.mark.parametrize("most, hot", [(urls.MAX_BROADCAST_BYTES, urls.HOT), (0, 0), (urls.MAX_BROADCAST_BYTES, 1)])
def test_odd_urls(spark, monkeypatch, most, hot):
    monkeypatch.setattr(urls, "MAX_BROADCAST_BYTES", most)
    monkeypatch.setattr(urls, "HOT", hot)
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "id long, url string, rule string")
    got = urls.filter_urls(pages, urls.rule_table(spark, urls.RULES))
    assert rows(got) == {(i, *brute(u)) for i, u in enumerate(URLS)}


def test_other_rules(spark):
    rules = [("block", "a.b", "/x"), ("allow", "b", "/xyz/"), ("block", "b", "/xyz/"), ("allow", "b", ""), (None, "b", "/")]
    pages = spark.createDataFrame([(i, f"s://{u}") for i, u in enumerate(["a.b/xyz/", "c.b/xyz/q", "b", "b/x", "a.b/xy"])], "id long, url string")
    known = [r for r in rules if r[0]]
    got = urls.filter_urls(pages, urls.rule_table(spark, rules))
    assert rows(got) == {(r["id"], *brute(r["url"], known)) for r in pages.collect()}


def test_very_long_hosts(spark):
    import time

    pages = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "example.net/en/"), (2, "http://" + "b." * 100_000 + "example.org/fr/x")], "id long, url string")
    start = time.monotonic()
    got = {r["id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(pages, urls.rule_table(spark, urls.RULES)).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("org/fr/", "allow")} and time.monotonic() - start < 30


def test_url_column_named_like_an_output(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "id long, host string")
    assert rows(urls.filter_urls(pages, urls.rule_table(spark, urls.RULES), url="host")) == {(1, "a.net", "/x", "net/", "block")}


def test_empty(spark):
    pages = spark.createDataFrame([], "id long, url string")
    assert urls.filter_urls(pages, urls.rule_table(spark, urls.RULES)).collect() == []
    some = spark.createDataFrame([(1, "http://net/")], "id long, url string")
    assert rows(urls.filter_urls(some, urls.rule_table(spark, []))) == {(1, "net", "/", None, "allow")}


def test_query_matches_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{data}/pages.parquet'")
    want = set(con.sql(ORACLES["op1_filter_urls"]).fetchall())
    assert {tuple(r) for r in urls.op1_filter_urls(spark, data).collect()} == want
