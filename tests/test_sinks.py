"""Sinks and checked sources."""

import json
import os

import pytest

from lexmill.sources import snapshots as S


def test_publish_replaces_as_a_whole(spark, tmp_path):
    path = f"{tmp_path}/out"
    S.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError):
        S.publish(spark.range(1, 4), path, lambda df: S.require_dense(df, "id"))
    assert spark.read.parquet(path).count() == 5
    S.publish(spark.read.parquet(path).filter("id < 3"), path, lambda df: S.require_dense(df, "id"))  # from itself
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2]
    assert os.listdir(tmp_path) == ["out"] and any(".zstd." in f for f in os.listdir(path))


@pytest.mark.parametrize("ids, ok", [([], True), ([0], True), ([1, 0, 2], True), ([0, 2], False), ([0, 0, 1], False), ([0, None], False), ([-1, 0], False)])
def test_dense(spark, ids, ok):
    df = spark.createDataFrame([(i,) for i in ids], "v long")
    if ok:
        assert S.require_dense(df, "v").count() == len(ids)
    else:
        with pytest.raises(ValueError):
            S.require_dense(df, "v")


def test_missing_shards_are_named(spark, tmp_path):
    S.write_parquet(spark.range(3), f"{tmp_path}/a")
    S.write_parquet(spark.range(2).selectExpr("id", "'x' AS more"), f"{tmp_path}/b")
    assert S.require_shards(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).count() == 5
    with pytest.raises(FileNotFoundError, match="/c, .*/d"):
        S.require_shards(spark, [f"{tmp_path}/{x}" for x in "acd"])


def test_json_keeps_nulls(spark, tmp_path):
    S.write_json(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), f"{tmp_path}/j")
    part = next(f for f in os.listdir(f"{tmp_path}/j") if f.startswith("part-"))
    assert json.loads(open(f"{tmp_path}/j/{part}").read()) == {"a": 1, "b": None}


def test_parquet_by_folder(spark, tmp_path):
    S.write_parquet(spark.range(6).selectExpr("id", "id % 2 AS g"), f"{tmp_path}/p", ["g"])
    assert {"g=0", "g=1"} <= set(os.listdir(f"{tmp_path}/p")) and spark.read.parquet(f"{tmp_path}/p").filter("g = 1").count() == 3
