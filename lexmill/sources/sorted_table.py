"""Sorted tables with point lookups: ranges of a key in files, a manifest of each file's least and greatest key and digest.

Rows go to files by ranges of (key, hash of the row), so a key of many rows spans files instead of filling one, and are
sorted in them. A lookup reads the manifest, then only the files whose range holds a wanted key; Parquet skips row groups
in these by their statistics. Rows with a null key are kept, and are found by no lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a manifest that are compared with keys by a broadcast; about 100 bytes each.
MANIFEST_ROWS = 100_000


def write_sorted(df: DataFrame, key: str, path: str, files: int) -> None:
    """path/data in about `files` sorted files, and path/manifest."""
    spark = df.sparkSession
    salted = df.withColumn("_salt", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    ordered = salted.repartitionByRange(files, F.col(key), F.col("_salt")).sortWithinPartitions(key, "_salt").drop("_salt")
    ordered.write.option("compression", "zstd").parquet(f"{path}/data")
    _ranges(spark, key, path).coalesce(1).write.parquet(f"{path}/manifest")


def _ranges(spark: SparkSession, key: str, path: str) -> DataFrame:
    """name, rows, low, high, nulls, bytes, sha256 of the files there now."""
    rows = spark.read.parquet(f"{path}/data").select(F.col(key).alias("k"), F.col("_metadata.file_name").alias("name"))
    ranges = rows.groupBy("name").agg(F.count("*").alias("rows"), F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.when(F.col("k").isNull(), 1)).alias("nulls"))
    digests = spark.read.format("binaryFile").load(f"{path}/data/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return digests.join(ranges, "name", "left")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def changed(spark: SparkSession, key: str, path: str) -> DataFrame:
    """name, state of files that are not as the manifest says: missing, added or changed."""
    then, now = manifest(spark, path), _ranges(spark, key, path)
    both = then.select("name", F.struct(*then.columns[1:]).alias("a")).join(now.select("name", F.struct(*then.columns[1:]).alias("b")), "name", "full_outer")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("name", state.alias("state")).filter("state is not null")


def _read(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    whole = spark.read.parquet(f"{path}/data")
    if not names:
        return whole.limit(0)
    return spark.read.schema(whole.schema).parquet(*[f"{path}/data/{n}" for n in names])


def _within(value: Column) -> Column:
    return (F.col("low") <= value) & (value <= F.col("high"))


def lookup(spark: SparkSession, path: str, key: str, values: Sequence) -> DataFrame:
    """All rows whose key is one of a few values."""
    wanted = [v for v in values if v is not None]
    holds = F.lit(False)
    for v in wanted:
        holds |= _within(F.lit(v))
    names = sorted(r.name for r in manifest(spark, path).filter(holds).select("name").collect())  # files, not rows
    return _read(spark, path, names).filter(F.col(key).isin(wanted))


def lookup_all(spark: SparkSession, path: str, key: str, keys: DataFrame) -> DataFrame:
    """All rows whose key is among the keys (one column) of another table, read from the files that hold any."""
    found = keys.select(F.col(keys.columns[0]).alias("_key")).distinct()
    ranges = manifest(spark, path).select("name", "low", "high")
    if ranges.count() <= MANIFEST_ROWS:
        names = sorted(r.name for r in found.join(F.broadcast(ranges), _within(F.col("_key"))).select("name").distinct().collect())  # files, not rows
        rows = _read(spark, path, names)
    else:
        rows = spark.read.parquet(f"{path}/data")
    return rows.join(found, rows[key] == found["_key"], "left_semi")
