"""Sources and sinks: snapshot readers, bucketed and sharded writers, manifests, exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.hashing import bucket, sha_shard


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet shards as one relation; columns are merged by name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines (gzip too). Strict reading fails on a bad line; tolerant reading keeps it in _corrupt."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt string")
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_snapshot(spark: SparkSession, path: str, record: str) -> DataFrame:
    """A JSON document with a list of records."""
    return spark.read.schema(f"records array<struct<{record}>>").option("multiLine", "true").json(path).select(F.inline("records"))


def pick_evenly(paths: list[str], k: int) -> list[str]:
    """k of n paths, evenly spaced, first and last included."""
    n = len(paths)
    if k >= n or k <= 0:
        return list(paths)
    return [paths[round(i * (n - 1) / (k - 1))] if k > 1 else paths[0] for i in range(k)]


def write_buckets(df: DataFrame, key: str, path: str, buckets: int = 1024) -> None:
    """JSON lines in folders by FNV bucket of the key."""
    df.withColumn("bucket", bucket(F.col(key), buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def write_shards(df: DataFrame, key: str, order: list[str], path: str) -> None:
    """Gzip JSON lines in 256 folders by SHA-256 of the key, rows in order."""
    sharded = df.withColumn("shard", sha_shard(F.col(key).cast("string")))
    sharded.repartition("shard").sortWithinPartitions("shard", *order).write.mode("overwrite").option("compression", "gzip").partitionBy("shard").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def bibtex(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """One entry per row: fields maps BibTeX names to columns; braces and backslashes are dropped."""
    clean = lambda c: F.regexp_replace(F.col(c).cast("string"), r"[{}\\]", "")
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"  {name} = {{"), clean(c), F.lit("}"))) for name, c in fields.items()]
    return df.select(F.col(key), F.concat(F.lit("@article{"), F.col(key).cast("string"), F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}")).alias("entry"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet in zstd, in folders by the columns of `by` (a file a task and folder: hot values stay spread)."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def require_dense(df: DataFrame, id_col: str) -> DataFrame:
    """The same rows if their ids are 0 to n - 1, each once; else ValueError. The ids are checked in one pass of their own."""
    n, distinct, lo, hi, nulls = df.agg(F.count(id_col), F.countDistinct(id_col), F.min(id_col), F.max(id_col), F.count(F.when(F.col(id_col).isNull(), 1))).first()
    if nulls or n != distinct or n and (lo, hi) != (0, n - 1):
        raise ValueError(f"{id_col} is not dense: {n} rows, {distinct} distinct, {nulls} null, from {lo} to {hi}")
    return df


def require_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """read_shards, but a path without files is an error that names every missing one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    missing = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            missing.append(path)
    if missing:
        raise FileNotFoundError(f"shards are missing: {', '.join(missing)}")
    return read_shards(spark, paths)


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], object] | None = None) -> None:
    """Replaces a Parquet folder as a whole: written beside it, read again, checked, then renamed into place.

    Whatever fails before the renames, a check that raises included, leaves the published folder as it was and removes the
    staged one. A previous version is kept aside until the new one stands, and put back if the rename fails.
    """
    spark = df.sparkSession
    make, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    run = uuid.uuid4().hex
    target, staged, old = make(path), make(f"{path.rstrip('/')}.staged-{run}"), make(f"{path.rstrip('/')}.old-{run}")
    fs = target.getFileSystem(conf)
    try:
        write_parquet(df, staged.toString())
        if check is not None:
            check(spark.read.parquet(staged.toString()))
        before = fs.exists(target)
        if before and not fs.rename(target, old):
            raise OSError(f"{path} cannot be moved aside")
        if not fs.rename(staged, target):
            if before:
                fs.rename(old, target)
            raise OSError(f"{path} cannot be put in place")
        if before:
            fs.delete(old, True)
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)
