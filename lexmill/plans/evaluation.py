"""Ranked retrieval measured against judgments: a source is a query, longer documents rank first, labels judge."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators import evaluate as E
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


def _judgments(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    grade = F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") * 2 + (F.col("n_chars") > 1000).cast("int"))
    return labels.join(docs.select("doc_id", "source", "n_chars"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), grade.alias("grade"))


_SQL_J = "j AS (SELECT source AS query_id, l.doc_id AS id, CASE WHEN toxic = 1 THEN 0 ELSE quality * 2 + CAST(n_chars > 1000 AS INT) END AS grade FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _run(spark, d, order, judged_only=True):
    docs = table(spark, d, "documents")
    if judged_only:
        docs = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("source").orderBy(*order))
    return docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), rank.alias("rank")).filter("rank <= 20")


def _sql_run(name: str, order: str, judged_only: bool = True) -> str:
    where = "WHERE doc_id IN (SELECT doc_id FROM labels)" if judged_only else ""
    return f"{name} AS (SELECT * FROM (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY {order}) AS rank FROM documents {where}) WHERE rank <= 20)"


def _sql_metrics(run: str, out: str) -> str:
    return f"""
{out}_i AS (SELECT query_id, sum((power(2.0, grade) - 1) / log2(r + 1)) FILTER (WHERE r <= 10) AS idcg, count(*) FILTER (WHERE grade > 0) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS r FROM j) GROUP BY query_id),
{out}_p AS (SELECT r.query_id, count(*) AS depth, count(grade) AS judged, count(*) FILTER (WHERE grade > 0) AS hits, coalesce(sum((power(2.0, grade) - 1) / log2(rank + 1)), 0) AS dcg, min(rank) FILTER (WHERE grade > 0) AS first, count(*) FILTER (WHERE grade > 0 AND rank <= 5) AS hits5 FROM {run} r LEFT JOIN j ON r.query_id = j.query_id AND r.id = j.id WHERE rank <= 10 GROUP BY r.query_id),
{out} AS (SELECT p.query_id, judged, CASE WHEN judged = depth THEN hits / 10 END AS precision, CASE WHEN judged = depth AND relevant > 0 THEN hits / relevant END AS recall, CASE WHEN judged = depth AND idcg > 0 THEN dcg / idcg END AS ndcg, CASE WHEN judged = depth THEN coalesce(1 / first, 0.0) END AS mrr, CASE WHEN judged = depth THEN hits5 / 5 END AS precision5, judged / depth AS coverage FROM {out}_p p LEFT JOIN {out}_i i ON p.query_id = i.query_id)"""


_ROUNDED = "query_id, judged, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr"


def _rounded(df):
    return df.select("query_id", "judged", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "mrr")])


@query(f"WITH {_SQL_J}, {_sql_run('a', 'n_chars DESC NULLS LAST, doc_id')}, {_sql_metrics('a', 'm')} SELECT {_ROUNDED} FROM m")
def ir_metrics(spark, d):
    return _rounded(E.ranking_metrics(_run(spark, d, [F.desc_nulls_last("n_chars"), "doc_id"]), _judgments(spark, d)))


@query(f"WITH {_SQL_J}, {_sql_run('a', 'n_chars DESC NULLS LAST, doc_id', False)}, {_sql_metrics('a', 'm')} SELECT {_ROUNDED} FROM m")
def ir_metrics_unjudged(spark, d):
    """As ir_metrics over all documents: a query with an unjudged row in its first ten has no metrics."""
    return _rounded(E.ranking_metrics(_run(spark, d, [F.desc_nulls_last("n_chars"), "doc_id"], False), _judgments(spark, d)))


@query(f"""
WITH g AS (SELECT source AS query_id, l.doc_id AS id, CASE WHEN toxic = 1 THEN 0 ELSE quality + CAST(lang = 'en' AS INT) END AS discipline FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
{_sql_run('a', 'doc_id % 16, doc_id', False)},
q AS (SELECT r.query_id, count(*) AS depth, count(discipline) AS judged, count(*) FILTER (WHERE discipline = 2) AS core FROM a r LEFT JOIN g ON g.query_id = r.query_id AND g.id = r.id WHERE rank <= 10 GROUP BY r.query_id)
SELECT left(query_id, 4) AS "group", count(*) AS queries, count(*) FILTER (WHERE judged = depth) AS complete, round(avg(CASE WHEN judged = depth THEN core / depth END), 6) AS discipline_precision, round(avg(judged / depth), 6) AS coverage FROM q GROUP BY ALL""")
def discipline_precision(spark, d):
    """Share of the first ten that are wholly of the discipline, where all ten are judged, by kind of query."""
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    discipline = labels.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + (F.col("lang") == "en").cast("int")).alias("discipline"))
    judged = _judgments(spark, d).join(discipline, "id")
    metrics = E.ranking_metrics(_run(spark, d, [F.col("doc_id") % 16, "doc_id"], False), judged)
    return E.macro_means(metrics, F.substring("query_id", 1, 4), ["discipline_precision", "coverage"]).select("group", "queries", "complete", F.round("discipline_precision", 6).alias("discipline_precision"), F.round("coverage", 6).alias("coverage"))


_MACRO = ("precision5", "precision", "recall", "ndcg", "mrr", "coverage")


@query(f"""
WITH {_SQL_J}, {_sql_run('a', 'doc_id % 16, doc_id', False)}, {_sql_metrics('a', 'm')}
SELECT CASE WHEN length(query_id) % 2 = 0 THEN 'even' ELSE 'odd' END AS "group", count(*) AS queries, count(*) FILTER (WHERE coverage = 1) AS complete, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _MACRO)} FROM m GROUP BY ALL""")
def macro_metrics(spark, d):
    """Means over the queries of a kind, beside how many are judged in full."""
    metrics = E.ranking_metrics(_run(spark, d, [F.col("doc_id") % 16, "doc_id"], False), _judgments(spark, d))
    group = F.when(F.length("query_id") % 2 == 0, "even").otherwise("odd")
    return E.macro_means(metrics, group, list(_MACRO)).select("group", "queries", "complete", *[F.round(c, 6).alias(c) for c in _MACRO])


@query("""
WITH p AS (SELECT quality = 1 AS a, n_chars > 800 AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id), s AS (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS agreement, avg(CAST(a AS DOUBLE)) AS x, avg(CAST(b AS DOUBLE)) AS y FROM p)
SELECT n, round(agreement, 6) AS agreement, round((agreement - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 6) AS kappa FROM s""")
def binary_kappa(spark, d):
    pairs = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return E.kappa(pairs, F.col("quality") == 1, F.col("n_chars") > 800).select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(f"""
WITH {_SQL_J}, {_sql_run('a', 'n_chars DESC NULLS LAST, doc_id')}, {_sql_run('b', 'doc_id')}, {_sql_metrics('a', 'm')}, {_sql_metrics('b', 'w')}
SELECT count(*) AS n, round(avg(w.ndcg - m.ndcg), 6) AS mean_delta, count(*) FILTER (WHERE w.ndcg > m.ndcg) AS rose, count(*) FILTER (WHERE w.ndcg < m.ndcg) AS fell, count(*) FILTER (WHERE w.ndcg = m.ndcg) AS same FROM m JOIN w USING (query_id) WHERE m.ndcg IS NOT NULL AND w.ndcg IS NOT NULL""")
def paired_delta(spark, d):
    j = _judgments(spark, d)
    a, b = (E.ranking_metrics(_run(spark, d, order), j) for order in ([F.desc_nulls_last("n_chars"), "doc_id"], ["doc_id"]))
    return E.paired_delta(a, b, "query_id", "ndcg").withColumn("mean_delta", F.round("mean_delta", 6))


@query("""
SELECT doc_id, round(share, 6) AS share, CASE WHEN share >= 0.8 THEN 3 WHEN share >= 0.5 THEN 2 WHEN share >= 0.2 THEN 1 ELSE 0 END AS grade FROM (SELECT l.doc_id, cume_dist() OVER (PARTITION BY lang ORDER BY n_chars) AS share FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""")
def percentile_buckets(spark, d):
    rows = table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return E.percentile_grade(rows, "lang", "n_chars").select("doc_id", F.round("share", 6).alias("share"), "grade")


@query(f"""
WITH {_SQL_J}, {_sql_run('a', 'doc_id')}, p AS (SELECT a.query_id, count(*) FILTER (WHERE rank <= 10 AND NOT coalesce(grade > 0, FALSE)) AS false_positives, count(*) FILTER (WHERE rank > 10 AND coalesce(grade > 0, FALSE)) AS trapped, count(*) FILTER (WHERE rank <= 10 AND coalesce(grade > 0, FALSE)) AS hits FROM a LEFT JOIN j ON a.query_id = j.query_id AND a.id = j.id GROUP BY a.query_id)
SELECT query_id, false_positives, trapped, least(false_positives, trapped) AS swaps, round((hits + least(false_positives, trapped)) / 10, 6) AS oracle_precision FROM p""")
def error_analysis(spark, d):
    return E.error_analysis(_run(spark, d, ["doc_id"]), _judgments(spark, d)).withColumn("oracle_precision", F.round("oracle_precision", 6))


PROFILES = [("length", 1.0, 0.0), ("even", 0.5, 0.5), ("fresh", 0.1, 0.9)]


@query(f"""
WITH {_SQL_J}, w(profile, wl, wi) AS (VALUES {", ".join(f"('{p}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for p, a, b in PROFILES)}),
s AS (SELECT profile, query_id, grade, row_number() OVER (PARTITION BY profile, query_id ORDER BY round(wl * least(1.0, n_chars / 5000.0) + wi * (doc_id % 97) / 97.0, 9) DESC, doc_id) AS r FROM j JOIN documents ON doc_id = id CROSS JOIN w)
SELECT profile, count(DISTINCT query_id) AS queries, round(avg(CASE WHEN grade > 0 THEN 1.0 ELSE 0.0 END), 6) AS precision FROM s WHERE r <= 10 GROUP BY profile""")
def ranking_simulation(spark, d):
    profiles = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(a).alias("wl"), F.lit(b).alias("wi")) for p, a, b in PROFILES]))
    rows = _judgments(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id").select("*", profiles.alias("w"))
    score = F.round(F.col("w.wl") * F.least(F.lit(1.0), F.col("n_chars") / 5000.0) + F.col("w.wi") * (F.col("id") % 97) / 97.0, 9)
    top = rows.withColumn("r", F.row_number().over(W.partitionBy("w.profile", "query_id").orderBy(F.desc(score), "id"))).filter("r <= 10")
    return top.groupBy(F.col("w.profile").alias("profile")).agg(F.countDistinct("query_id").alias("queries"), F.round(F.avg(F.when(F.col("grade") > 0, 1.0).otherwise(0.0)), 6).alias("precision"))
