"""Vector queries over embeddings. Queries are the rows whose id is divisible by 20, against all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexmill.operators import inverted_file
from lexmill.operators import vectors as V
from lexmill.operators.merge import shared_folder
from lexmill.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _base(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.unit(F.col("embedding")).alias("v"), "label")


_SQL_UNIT = "SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings"
_SQL_KNN = """
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT q.id AS query_id, b.id AS id, list_dot_product({q}, {b}) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product({q}, {b}), 9) DESC, b.id) AS rank
FROM u q JOIN u b ON q.id <> b.id WHERE q.id % 20 = 0) WHERE rank <= 10"""


@query(f"SELECT id, round(v[1], 6) AS first, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM ({_SQL_UNIT})")
def vec_normalise(spark, d):
    return _base(spark, d).select("id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.sqrt(V.dot(F.col("v"), F.col("v"))), 6).alias("norm"))


@query("""
SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: CAST(round_even(greatest(-1.0, least(1.0, CAST(x AS DOUBLE))) * 127, 0) AS INTEGER)), ',') AS q FROM embeddings""")
def vec_quantise(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array_join(V.int8(F.col("embedding")).cast("array<string>"), ",").alias("q"))


@query(f"WITH u AS ({_SQL_UNIT})" + _SQL_KNN.format(q="q.v", b="b.v"))
def knn_exact(spark, d):
    base = _base(spark, d)
    found = V.neighbours(base.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), base, 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH w AS ({_SQL_UNIT}), u AS (SELECT id, list_transform(v, lambda x: round_even(greatest(-1.0, least(1.0, x)) * 127, 0)) AS v FROM w)" + _SQL_KNN.format(q="q.v", b="b.v"))
def knn_int8(spark, d):
    base = _base(spark, d).select("id", V.int8(F.col("v")).alias("v"))
    found = V.neighbours(base.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), base, 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def ivf_recall(spark, d):
    """Recall at 10 of an inverted file of 16 clusters, 12 of them probed (these vectors hardly cluster), by query; the tests hold its mean over 0.9."""
    base = _base(spark, d).select("id", "v")
    queries = base.filter("id % 20 = 0")
    centres = V.train_centroids(base, 16)
    exact = V.neighbours(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), base, 10)
    return V.recall(V.ivf_search(queries, base, centres, 10, 12), exact)


@query(f"WITH w AS ({_SQL_UNIT}), u AS (SELECT id, list_transform(v, lambda x: round_even(greatest(-1.0, least(1.0, x)) * 127, 0)) AS v FROM w)" + _SQL_KNN.format(q="q.v", b="b.v"))
def inverted_file_search(spark, d):
    """The ten nearest int8 vectors from an inverted file of 256 clusters, 32 probed first, then every cluster whose bound could add one."""
    base = _base(spark, d).select("id", "v")
    index = inverted_file.lay_out(base, inverted_file.train(base, 256), f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    queries = base.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = inverted_file.search(queries, index, 10, 32, exact=True)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def cluster_lookup(spark, d):
    """Every vector's cluster and its place in it."""
    from pyspark.sql import Window as W

    base = _base(spark, d).select("id", "v")
    placed = V.assign(base, V.train_centroids(base, 16)).select("id", "cluster")
    return placed.withColumn("ordinal", F.row_number().over(W.partitionBy("cluster").orderBy("id")) - 1)


@query(f"""
WITH u AS ({_SQL_UNIT}), k AS (SELECT q.id AS seed, q.label AS ql, b.id AS target, b.label AS bl, list_dot_product(q.v, b.v) AS score FROM u q JOIN u b ON q.id <> b.id WHERE q.id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, target) AS r FROM k)
SELECT seed, target, round(score, 6) AS score, CASE WHEN ql = bl THEN 'semantic+topic' ELSE 'semantic' END AS relation, CASE WHEN score >= 0.62 THEN 'high' WHEN score >= 0.42 THEN 'medium' ELSE 'low' END AS confidence FROM t WHERE r <= 24 AND score >= 0.1""")
def related_index(spark, d):
    base = _base(spark, d)
    found = V.neighbours(base.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), base, 24).filter("score >= 0.1")
    labels = base.select("id", "label")
    joined = found.join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(labels, "id")
    confidence = F.when(F.col("score") >= 0.62, "high").when(F.col("score") >= 0.42, "medium").otherwise("low")
    return joined.select(F.col("query_id").alias("seed"), F.col("id").alias("target"), F.round("score", 6).alias("score"), F.when(F.col("ql") == F.col("label"), "semantic+topic").otherwise("semantic").alias("relation"), confidence.alias("confidence"))


@query("""
SELECT label, count(*) AS n, round(avg(embedding[1]), 6) AS mean_first FROM embeddings GROUP BY label""")
def topic_summary(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("mean_first"))
