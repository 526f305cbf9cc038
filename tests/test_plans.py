"""What Spark is asked to do: pruned scans, pushed filters, partial aggregates, no work that nobody reads."""

import re

import pytest

from pipewright.api import plan, run


def explained(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def read(text):
    return [sorted(x.split(":")[0] for x in m.split(",") if x) for m in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def test_pruned_and_pushed(spark, data):
    text = explained(run(spark, f"{data}/lineitem.parquet | filter {{ l_orderkey > 100 and l_returnflag == \"R\" }} | transform x = l_quantity * 2 | select l_orderkey, x"))
    assert read(text) == [["l_orderkey", "l_quantity", "l_returnflag"]]
    assert "GreaterThan(l_orderkey,100)" in text and "EqualTo(l_returnflag,R)" in text and "Exchange" not in text


def test_fused_group_reduce(spark, data):
    text = explained(run(spark, f"{data}/lineitem.parquet | group l_returnflag | reduce n = count(), q = sum(l_quantity) | remove grouped"))
    assert read(text) == [["l_quantity", "l_returnflag"]] and "collect_list" not in text and "partial_sum" in text
    assert text.count("Exchange (") == 2 or text.count("Exchange") >= 1


def test_dropped_rows_are_not_collected(spark, data):
    for stage in ("group l_returnflag | select l_returnflag", "group l_returnflag | count", "group l_returnflag | reduce n = count() | select n"):
        text = explained(run(spark, f"{data}/lineitem.parquet | {stage}"))
        assert "collect_list" not in text and read(text) == [["l_returnflag"]]


def test_count_reads_no_column(spark, data):
    assert read(explained(run(spark, f"{data}/lineitem.parquet | transform x = year(l_shipdate) | count"))) == [[]]


def test_top_k_is_not_a_full_sort(spark, data):
    text = explained(run(spark, f"{data}/orders.parquet | sort -o_totalprice | transform x = o_totalprice * 2 | head 5 | select x"))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_join_reads_what_is_used(spark, data):
    text = explained(run(spark, f"{data}/orders.parquet | join {data}/customer.parquet on o_custkey == c_custkey | select o_orderkey, c_name"))
    assert read(text) == [["o_custkey", "o_orderkey"], ["c_custkey", "c_name"]]
    assert read(explained(run(spark, f"{data}/orders.parquet | join {data}/customer.parquet on o_custkey == c_custkey | count"))) == [["o_custkey"], ["c_custkey"]]


def test_no_order_without_need(spark, data):
    for stage in ("distinct o_custkey", "sort o_custkey", "group o_custkey | reduce n = count() | remove grouped", "sort o_custkey | count"):
        text = explained(run(spark, f"{data}/orders.parquet | {stage}"))
        assert "row_index" not in text and "rangepartitioning" not in text and "Sort (" not in text


def test_no_python_in_hot_paths(spark, data):
    from pipewright.queries import FILES, PIPELINES, QUERIES

    for name, query in QUERIES.items():
        if name not in PIPELINES and not FILES[name][1].split()[0].endswith((".csv", ".parquet")) or "json" in name:
            continue  # JSON and Avro are decoded in Arrow batches
        text = explained(query(spark, data))
        assert not re.search("Python|Pandas|MapInArrow", text), name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_one_pass_through_rows(spark, data):
    text = explained(run(spark, f"{data}/part.parquet | filter {{ p_size > 3 }} | transform a = p_size + 1 | rename a = b | filter {{ b < 40 }} | remove p_name | transform c = b * 2 | select c"))
    assert text.count("* Project") == 1 and text.count("* Filter") == 1 and "WholeStageCodegen" in text or "* Project" in text


def test_csv_demand(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,z\n")
    source = plan(spark, "a.csv with infer_rows=1 | select x | count", base=str(tmp_path))
    assert source.demands(False)[0][0] == set()
    assert run(spark, "a.csv with infer_rows=1 | select y | count", base=str(tmp_path)).first()[0] == 2
    with pytest.raises(Exception, match="y"):
        run(spark, "a.csv with infer_rows=1 | select y", base=str(tmp_path)).collect()


def test_head_opens_the_first_files_only(spark, data, tmp_path):
    nation = spark.read.parquet(f"{data}/customer.parquet")
    nation.orderBy("c_custkey").repartitionByRange(6, "c_custkey").write.parquet(str(tmp_path / "many"))
    for i in range(3):
        nation.orderBy("c_custkey").coalesce(1).write.parquet(str(tmp_path / f"d{i}"))
        next((tmp_path / f"d{i}").glob("part-*")).rename(tmp_path / f"{i}.parquet")
    want = [r[0] for r in nation.orderBy("c_custkey").collect()]
    rows = nation.count()
    for source, n, files in ((f"{tmp_path}/many with format=parquet", 5, 1), (f"{tmp_path}/many with format=parquet", rows - 1, 6), (f"{tmp_path}/?.parquet", rows + 1, 2), (f"{tmp_path}/0.parquet", 7, 1)):
        df = run(spark, f"{source} | select c_custkey | head {n}", ordered=True)
        assert len(df.inputFiles()) == files, source
        assert [r[0] for r in df.collect()] == (want * 3)[:n]
    assert run(spark, f"{tmp_path}/many with format=parquet | head 0").count() == 0
