"""Inverted file of vectors as a table: spherical k-means over all rows, int8 payloads in a folder per cluster and block.

Training adds up each task's vectors per cluster and reduces the sums by cluster, so only the centroids (clusters by
dimensions) reach the driver. A cluster of many rows is written as several blocks, each with its ordinals in order. A
search reads the folders of the clusters that some query probes, and nothing else; scores of a block against its queries
are one matrix product, of which k rows per query leave. With `exact`, clusters that were not probed are searched too
where the angle between query and centroid, less the cluster's radius, could still bring a row among the k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators.merge import cut_lineage
from lexmill.operators.vectors import block_best, ranked

#: Rows of a block, and queries that meet it at once.
BLOCK, QUERIES = 20_000, 2_000


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float) if len(column) else np.zeros((0, 0))


def train(vectors: DataFrame, clusters: int, iterations: int = 10, seed: int = 13, tolerance: float = 1e-3) -> np.ndarray:
    """Centroids of unit vectors (id, v), one a row; the first ones are the rows of the least seeded hashes."""
    first = vectors.select("v", F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))).alias("h"), "id").orderBy("h", "id").limit(clusters)
    centres = np.array([r.v for r in first.collect()], float)  # a row a cluster
    for _ in range(iterations if len(centres) else 0):

        def add(batches: Iterator[pa.RecordBatch], at: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(at), np.zeros(len(at), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0))
                    near = np.argmax(x @ at.T, axis=1)
                    np.add.at(total, near, x)
                    n += np.bincount(near, minlength=len(at))
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(list(total[seen]), pa.list_(pa.float64()))], names=["cluster", "total"])

        def merge(key: tuple, parts: pa.Table) -> pa.Table:
            return pa.table({"cluster": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([np.sum(parts["total"].to_pylist(), axis=0)], pa.list_(pa.float64()))})

        sums = vectors.select("v").mapInArrow(add, "cluster int, total array<double>").groupBy("cluster").applyInArrow(merge, "cluster int, total array<double>").collect()
        new = centres.copy()
        for r in sums:
            norm = np.linalg.norm(r.total)
            if norm > 0:
                new[r.cluster] = np.array(r.total) / norm
        moved, centres = np.abs(new - centres).max(), new
        if moved < tolerance:
            break
    return centres


@dataclass(frozen=True)
class Index:
    """Where the table lies, its centroids, and per cluster its rows, greatest angle and greatest norm."""

    path: str
    centres: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    norm: np.ndarray

    def read(self, spark) -> DataFrame:
        """id, ordinal, payload (signed bytes), cluster, block."""
        kind = next(f for f in spark.read.parquet(self.path).schema if f.name == "id").dataType.simpleString()
        return spark.read.schema(f"id {kind}, ordinal long, payload binary, cluster int, block int").parquet(self.path)


def _placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, payload, cluster, angle to the centroid and norm of every row's int8 vector."""
    kind = dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                near = np.argmax(x @ centres.T, axis=1)
                q = np.rint(np.clip(x, -1, 1) * 127).astype(np.int8)
                norm = np.linalg.norm(q.astype(float), axis=1)
                angle = np.arccos(np.clip((q * centres[near]).sum(1) / np.maximum(norm, 1e-12), -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(near, pa.int32()), pa.array(angle), pa.array(norm)], names=["id", "payload", "cluster", "angle", "norm"])

    return vectors.select("id", "v").mapInArrow(run, f"id {kind}, payload binary, cluster int, angle double, norm double")


def lay_out(vectors: DataFrame, centres: np.ndarray, path: str, block: int = BLOCK) -> Index:
    """Writes vectors (id, v) as int8 rows by cluster and block; ordinals count a cluster's rows from 0 by block, then id."""
    spark = vectors.sparkSession
    placed = _placed(vectors, centres)
    each = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.max("norm").alias("norm")).collect()  # a row a cluster
    rows, radius, norm = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
    for r in each:
        rows[r.cluster], radius[r.cluster], norm[r.cluster] = r.n, r.angle, r.norm
    parts = F.array(*[F.lit(int(-(-n // block)) or 1) for n in rows])
    dealt = placed.select("id", "payload", "cluster", F.pmod(F.xxhash64("id"), F.get(parts, F.col("cluster")).cast("long")).cast("int").alias("block"))
    sizes = dealt.groupBy("cluster", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("cluster").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("cluster").alias("c"), F.col("block").alias("b"), before.alias("before"))
    numbered = dealt.withColumn("nth", F.row_number().over(W.partitionBy("cluster", "block").orderBy("id")))
    joined = numbered.join(offsets, (F.col("cluster") == F.col("c")) & (F.col("block") == F.col("b")))
    out = joined.select("id", (F.col("before") + F.col("nth") - 1).alias("ordinal"), "payload", "cluster", "block").repartition("cluster", "block").sortWithinPartitions("cluster", "block", "ordinal")
    if len(centres):
        out.write.mode("errorifexists").partitionBy("cluster", "block").parquet(path)
    else:
        vectors.select("id", F.lit(0).cast("long").alias("ordinal"), F.lit(b"").alias("payload"), F.lit(0).alias("cluster"), F.lit(0).alias("block")).limit(0).write.parquet(path)
    return Index(path, centres, rows, radius, norm)


def _asked(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """query_id, payload, cluster, first (one of the nearest `probes`), bound: what a row of the cluster can score at most."""
    kind = dict(queries.dtypes)["query_id"]
    full = np.flatnonzero(index.rows)
    centres = index.centres[full]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(full):
                continue
            q = np.rint(np.clip(_matrix(batch.column(1)), -1, 1) * 127).astype(np.int8)
            norm = np.linalg.norm(q.astype(float), axis=1, keepdims=True)
            cosine = (q @ centres.T) / np.maximum(norm, 1e-12)
            angle = np.maximum(np.arccos(np.clip(cosine, -1, 1)) - index.radius[full] - 1e-9, 0)
            bound = norm * index.norm[full] * np.maximum(np.cos(angle), 0)
            order = np.argsort(-cosine, axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(len(full))[None, :], axis=1)
            n = len(q)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), len(full)))), pa.array([b for r in q for b in [r.tobytes()] * len(full)], pa.binary()), pa.array(np.tile(full, n), pa.int32()), pa.array((place < probes).ravel()), pa.array(bound.ravel())],
                names=["query_id", "payload", "cluster", "first", "bound"],
            )

    return queries.select("query_id", "q").mapInArrow(run, f"query_id {kind}, payload binary, cluster int, first boolean, bound double")


def _scan(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, id, score of the k best rows of each block for each query that asks its cluster."""
    spark = asked.sparkSession
    probed = [r.cluster for r in asked.select("cluster").distinct().collect()]  # at most all clusters
    rows = index.read(spark).filter(F.col("cluster").isin(probed))
    kinds = dict(asked.dtypes)["query_id"], dict(rows.dtypes)["id"]
    blocks = rows.select("cluster", "block").distinct().select(F.col("cluster").alias("c"), F.col("block").alias("b"))
    chunk = F.pmod(F.xxhash64("query_id"), F.greatest(F.lit(1), F.ceil(F.col("asks") / QUERIES))).cast("int")
    counted = asked.groupBy("cluster").agg(F.count("*").alias("asks"))
    dealt = asked.join(counted, "cluster").withColumn("chunk", chunk).join(blocks, F.col("cluster") == F.col("c")).select("query_id", F.col("payload").alias("p"), "cluster", F.col("b").alias("block"), "chunk")
    copies = rows.join(counted, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.greatest(F.lit(1), F.ceil(F.col("asks") / QUERIES)) - 1).cast("int")))).select("id", "payload", "cluster", "block", "chunk")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["query_id"][:0], "id": right["id"][:0], "score": np.zeros(0)})
        q = np.frombuffer(b"".join(left["p"]), np.int8).reshape(len(left), -1).astype(np.float64)
        v = np.frombuffer(b"".join(right["payload"]), np.int8).reshape(len(right), -1).astype(np.float64)
        return block_best(left["query_id"].to_numpy(), q, right["id"].to_numpy(), v, k)

    key = ["cluster", "block", "chunk"]
    return dealt.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(best, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def search(queries: DataFrame, index: Index, k: int, probes: int, exact: bool = False) -> DataFrame:
    """query_id, id, score, rank: the k best rows by the product of int8 vectors, without the query's own id.

    queries: query_id, q (unit vectors), a stated set. Of the rows of the nearest `probes` clusters, or with `exact` of all.
    """
    asked = _asked(queries, index, probes)
    found = ranked(_scan(asked.filter("first").select("query_id", "payload", "cluster"), index, k), k)
    if not exact:
        return found
    have = cut_lineage(found.select("query_id", "id", "score"))
    worst = have.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).withColumnRenamed("query_id", "of")
    more = asked.filter("not first").join(worst, F.col("query_id") == F.col("of"), "left").filter((F.coalesce("n", F.lit(0)) < k) | (F.col("bound") >= F.col("least") - 1e-6))
    return ranked(have.union(_scan(more.select("query_id", "payload", "cluster"), index, k)), k)


def rows_read(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """query_id, share: the part of all rows that a query's nearest clusters hold."""
    sizes = F.array(*[F.lit(int(n)) for n in index.rows])
    asked = _asked(queries, index, probes).filter("first")
    return asked.groupBy("query_id").agg((F.sum(F.get(sizes, F.col("cluster"))) / int(index.rows.sum())).alias("share"))


def lookup(index: Index, spark, cluster: int, ordinal: int) -> DataFrame:
    """The row of a cluster and ordinal: only that cluster's folder is read."""
    return index.read(spark).filter((F.col("cluster") == cluster) & (F.col("ordinal") == ordinal))
