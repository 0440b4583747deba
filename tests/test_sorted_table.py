"""Sorted tables: files in order, lookups that read one file, hot and null keys, changed files."""

import os

from lexmill.sources import sorted_table as T


def table(spark, path, rows, files=8):
    T.write_sorted(spark.createDataFrame(rows, "k long, v string"), "k", path, files)


def files_read(df):
    """Files that the plan's scans read, by their metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, stack = 0, [plan]
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
            continue
        metric = node.metrics().get("numFiles")
        total += metric.get().value() if metric.isDefined() else 0
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


def test_files_are_ranges_in_order(spark, tmp_path):
    table(spark, f"{tmp_path}/t", [((i * 7919) % 5000, f"v{i}") for i in range(5000)])
    ranges = sorted((r.low, r.high, r.rows) for r in T.manifest(spark, f"{tmp_path}/t").collect())
    assert len(ranges) == 8 and sum(r[2] for r in ranges) == 5000 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    for f in sorted(os.listdir(f"{tmp_path}/t/data")):
        if f.endswith(".parquet"):
            keys = [r.k for r in spark.read.parquet(f"{tmp_path}/t/data/{f}").collect()]
            assert keys == sorted(keys)


def test_a_lookup_reads_one_file(spark, tmp_path):
    table(spark, f"{tmp_path}/t", [(i * 2, f"v{i}") for i in range(4000)])
    one = T.lookup(spark, f"{tmp_path}/t", "k", [4242])
    assert [tuple(r) for r in one.collect()] == [(4242, "v2121")] and files_read(T.lookup(spark, f"{tmp_path}/t", "k", [4242])) == 1
    assert T.lookup(spark, f"{tmp_path}/t", "k", [-5, 99_999, None]).count() == 0 and T.lookup(spark, f"{tmp_path}/t", "k", []).count() == 0
    assert T.lookup(spark, f"{tmp_path}/t", "k", [4243]).count() == 0
    few = spark.createDataFrame([(0,), (2,), (4,), (4,), (None,), (7,)], "x long")
    found = T.lookup_all(spark, f"{tmp_path}/t", "k", few)
    assert sorted(r.k for r in found.collect()) == [0, 2, 4]
    assert files_read(T.lookup_all(spark, f"{tmp_path}/t", "k", few)) == 1


def test_a_hot_key_spans_files_and_nulls_stay(spark, tmp_path):
    rows = [(7 if i % 3 == 0 else i, f"v{i}") for i in range(6000)] + [(None, "none")] * 5
    table(spark, f"{tmp_path}/t", rows)
    stats = T.manifest(spark, f"{tmp_path}/t").collect()
    assert max(r.rows for r in stats) < 1600 and sum(r.nulls for r in stats) == 5
    hot = T.lookup(spark, f"{tmp_path}/t", "k", [7])
    assert hot.count() == sum(k == 7 for k, _ in rows) and spark.read.parquet(f"{tmp_path}/t/data").count() == len(rows)
    table(spark, f"{tmp_path}/e", [])
    assert T.lookup(spark, f"{tmp_path}/e", "k", [1]).count() == 0


def test_changed_files_are_named(spark, tmp_path):
    table(spark, f"{tmp_path}/t", [(i, "v") for i in range(400)], files=4)
    assert T.changed(spark, "k", f"{tmp_path}/t").collect() == []
    names = sorted(f for f in os.listdir(f"{tmp_path}/t/data") if f.endswith(".parquet"))
    os.remove(f"{tmp_path}/t/data/{names[0]}")
    spark.createDataFrame([(1, "new")], "k long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t/data")
    got = {r.name: r.state for r in T.changed(spark, "k", f"{tmp_path}/t").collect()}
    assert got.pop(names[0]) == "missing" and list(got.values()) == ["added"]
