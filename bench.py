"""Times the headline queries: one warm-up, then the median of BENCH_RUNS runs, each to the end of the plan.

BENCH_SF_DIR: the tables (default sf0.1); BENCH_CPUS: threads. Prints one JSON line; the session start stands apart.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from pipewright.api import plan, run

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

#: The operations that the baseline names, on the driver's tables.
BENCH = {
    "int_filter_count": "{d}/lineitem.parquet | filter {{ l_linenumber > 3 }} | count",
    "append_transform": "{d}/lineitem.parquet | transform x = l_linenumber * 2 + 1",
    "dead_transform_count": "{d}/lineitem.parquet | transform x = upper(l_returnflag) | count",
    "string_contains": "{d}/part.parquet | filter {{ str_contains(p_name, \"1\") }} | count",
    "upper": "{d}/part.parquet | transform u = upper(p_name)",
    "regex_filter": "{d}/documents.parquet | filter {{ matches(text, \"[A-Z][a-z]+tion\") }} | count",
    "nested_strings": "{d}/part.parquet | transform x = upper(substr(trim(p_name), 0, 5)) + lower(p_brand)",
    "path_filter": "{d}/lineitem.parquet | transform r = struct(n = l_linenumber, f = l_returnflag) | filter {{ r.n > 3 and r.f == \"R\" }} | count",
    "distinct_one": "{d}/lineitem.parquet | distinct l_suppkey",
    "distinct_two": "{d}/lineitem.parquet | distinct l_suppkey, l_returnflag",
    "distinct_row": "{d}/orders.parquet | distinct",
    "group_only": "{d}/orders.parquet | group o_custkey",
    "group_reduce": "{d}/lineitem.parquet | group l_suppkey | reduce n = count(), q = sum(l_quantity), p = avg(l_extendedprice) | remove grouped",
    "transform_group_filter": "{d}/lineitem.parquet | transform v = l_extendedprice * l_discount | group l_returnflag | reduce s = sum(v), n = count() | remove grouped | filter {{ n > 10 }}",
    "join_count": "{d}/lineitem.parquet | join {d}/orders.parquet on l_orderkey == o_orderkey | count",
    "join_select_filter": "{d}/lineitem.parquet | transform v = l_quantity * 2 | join {d}/orders.parquet on l_orderkey == o_orderkey | select v, o_totalprice | filter {{ o_totalprice > 100000 }}",
    "pricing_summary": None,
    "shipping_priority": None,
    "local_suppliers": None,
    "forecast_revenue": None,
    "sort_head": None,
}


def main() -> None:
    from pipewright.queries import PIPELINES

    began = time.perf_counter()
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter() - began
    wide = spark.range(1).selectExpr(*[f"id AS c{i}" for i in range(1024)])
    wide.write.mode("overwrite").parquet(path := f"/tmp/pipewright-bench-{os.getpid()}.parquet")
    texts = {n: (t or PIPELINES[n][0]).format(d=SF_DIR) for n, t in BENCH.items()}
    jobs = {n: (lambda t=t: run(spark, t).write.format("noop").mode("overwrite").save()) for n, t in texts.items()}
    jobs["planner_1024_columns"] = lambda: plan(spark, f"{path} | filter {{ c1 > 3 }} | transform x = c2 + c3, c4 = c5 * 2 | select x, c4, c1000 | sort x | head 5").schema
    seconds = {}
    for name, job in jobs.items():
        job()
        took = []
        for _ in range(RUNS):
            t = time.perf_counter()
            job()
            took.append(time.perf_counter() - t)
        seconds[name] = round(statistics.median(took), 4)
    import shutil

    shutil.rmtree(path, ignore_errors=True)
    out = {"metric": "total of median seconds, warm", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "session_start": round(start, 2), "sf": os.path.basename(SF_DIR.rstrip("/"))}
    print(json.dumps(out))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
