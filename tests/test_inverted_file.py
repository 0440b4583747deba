"""The inverted file as a table: recall and rows read over a table with clusters, exact search, ordinals, blocks."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import inverted_file as I

SCHEMA = "id long, v array<double>"


@pytest.fixture(scope="module")
def table():
    """60 directions with 30 to 90 rows around each."""
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(60, 24))
    heads /= np.linalg.norm(heads, axis=1, keepdims=True)
    sizes = rng.integers(30, 90, 60)
    x = np.vstack([h + rng.normal(size=(n, 24)) * 0.08 for h, n in zip(heads, sizes, strict=True)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], SCHEMA).repartition(5)
    centres = I.train(df, 80)
    return df, I.lay_out(df, centres, f"{tmp_path_factory.mktemp('ivf')}/t", block=40)


def exact_int8(x, queries, k):
    q = np.rint(np.clip(x, -1, 1) * 127)
    out = {}
    for i in queries:
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:k]
        out[i] = [(j, s[j]) for j in order]
    return out


def test_training_equals_plain_numpy(spark, table):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], SCHEMA).repartition(7)
    first = [r.id for r in df.select("id", F.md5(F.concat_ws(":", F.lit(13), F.col("id").cast("string"))).alias("h")).orderBy("h").limit(16).collect()]
    c = table[first]
    for _ in range(3):
        near = np.argmax(table @ c.T, 1)
        c = np.array([s / np.linalg.norm(s) if (s := table[near == j].sum(0)).any() else c[j] for j in range(16)])
    assert np.allclose(I.train(df, 16, iterations=3, tolerance=0), c)


def test_recall_and_rows_read(spark, table, index):
    df, found = index
    queries = df.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    want = exact_int8(table, range(0, len(table), 20), 10)
    got = {}
    for r in I.search(queries, found, 10, 8).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert min(len({j for j, _ in w} & got[i]) for i, w in want.items()) >= 9
    shares = {r.query_id: r.share for r in I.rows_read(queries, found, 8).collect()}
    assert len(shares) == len(want) and max(shares.values()) <= 0.25 and np.mean(list(shares.values())) <= 0.15


@pytest.mark.parametrize("probes", [1, 3, 80])
def test_exact_search(table, index, probes):
    df, found = index
    queries = df.filter("id % 60 = 7").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    want = exact_int8(table, range(7, len(table), 60), 10)
    got = {}
    for r in I.search(queries, found, 10, probes, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got == want


def test_blocks_ordinals_and_lookup(spark, table, index):
    df, found = index
    rows = found.read(spark).collect()
    assert sorted(r.id for r in rows) == list(range(len(table)))
    by = {}
    for r in rows:
        by.setdefault(r.cluster, []).append(r)
    assert all(sorted(r.ordinal for r in some) == list(range(len(some))) for some in by.values())
    large = max(by, key=lambda c: len(by[c]))
    assert len({r.block for r in by[large]}) > 1 and all(found.rows[c] == len(some) for c, some in by.items())
    wanted = by[large][len(by[large]) // 2]
    one = I.lookup(found, spark, large, wanted.ordinal)
    assert [(r.id, r.payload) for r in one.collect()] == [(wanted.id, wanted.payload)]
    assert re.search(rf"PartitionFilters: \[isnotnull\(cluster#\d+\), \(cluster#\d+ = {large}\)\]", one._jdf.queryExecution().toString())
    assert np.frombuffer(wanted.payload, np.int8).tolist() == np.rint(table[wanted.id] * 127).astype(int).tolist()


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    found = I.lay_out(none, I.train(none, 4), f"{tmp_path}/t")
    assert found.read(spark).count() == 0
    assert I.search(none.select(F.col("id").alias("query_id"), F.col("v").alias("q")), found, 3, 2, exact=True).count() == 0


def test_a_block_of_neighbours_holds_few_scores():
    """Two thousand queries against twenty thousand rows once took a matrix of 320 MB."""
    import tracemalloc

    import numpy as np

    from lexmill.operators.vectors import block_best

    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(20_000, 4)), 1)  # with ties
    ids, queries = rng.permutation(20_000), np.arange(0, 20_000, 10)
    q = v[np.argsort(ids)[queries]]
    tracemalloc.start()
    found = block_best(queries, q, ids, v, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 2**20 and len(found) == 5 * len(queries)
    for n in range(0, len(queries), 400):
        s = q[n] @ v.T
        order = [i for i in np.lexsort((ids, -np.round(s, 9))) if ids[i] != queries[n]][:5]
        assert found["id"][5 * n : 5 * n + 5].tolist() == ids[order].tolist()


def test_probed_clusters_are_searched_without_a_row_for_each_pair(spark):
    import numpy as np

    from lexmill.operators import vectors

    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 5))
    centres = v[:7]
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    found = vectors.ivf_search(base.filter("id % 20 = 0"), base, centres, 4, 3)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    near = np.argsort(-(v @ centres.T), axis=1, kind="stable")
    for n in range(0, 400, 20):
        probed = [i for i in range(400) if i != n and near[i, 0] in near[n, :3]]
        assert got.get(n, []) == sorted(probed, key=lambda i: (-round(float(v[n] @ v[i]), 9), i))[:4]
