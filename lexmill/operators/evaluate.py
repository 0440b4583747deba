"""Evaluation of ranked results against graded judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranking_metrics(run: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """Per query_id: judged, precision, recall, ndcg, mrr at k, precision at 5, judged share of the first k. run(query_id, id, rank), judgments(query_id, id, grade).

    Precision, recall, nDCG and MRR are null unless every row of the first k is judged. Gain 2^g - 1, discount log2(rank + 1).
    Where judgments have a `discipline` of 0 to 2, discipline_precision is the share of the first k that are wholly of it.
    """
    core = F.col("discipline") == 2 if "discipline" in judgments.columns else None
    joined = run.filter(F.col("rank") <= k).join(judgments, ["query_id", "id"], "left")
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    ideal = judgments.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "id")))
    best = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, gain(F.col("grade"), F.col("r")))).alias("idcg"), F.count(F.when(F.col("grade") > 0, 1)).alias("relevant"))
    relevant = F.col("grade") > 0
    per = joined.groupBy("query_id").agg(
        F.count("*").alias("depth"), F.count("grade").alias("judged"), F.count(F.when(relevant, 1)).alias("hits"),
        F.coalesce(F.sum(gain(F.col("grade"), F.col("rank"))), F.lit(0.0)).alias("dcg"), F.min(F.when(relevant, F.col("rank"))).alias("first"),
        F.count(F.when(relevant & (F.col("rank") <= 5), 1)).alias("hits5"), *([F.count(F.when(core, 1)).alias("core")] if core is not None else []),
    ).join(best, "query_id", "left")
    full = F.col("judged") == F.col("depth")
    return per.select(
        "query_id", "judged", F.when(full, F.col("hits") / k).alias("precision"), F.when(full & (F.col("relevant") > 0), F.col("hits") / F.col("relevant")).alias("recall"),
        F.when(full & (F.col("idcg") > 0), F.col("dcg") / F.col("idcg")).alias("ndcg"), F.when(full, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(full, F.col("hits5") / 5).alias("precision5"), (F.col("judged") / F.col("depth")).alias("coverage"),
        *([F.when(full, F.col("core") / F.col("depth")).alias("discipline_precision")] if core is not None else []),
    )


def macro_means(metrics: DataFrame, group: Column, columns: list[str]) -> DataFrame:
    """group, queries, complete (all judged) and the mean of each metric over the queries that have it."""
    means = [F.avg(c).alias(c) for c in columns]
    return metrics.groupBy(group.alias("group")).agg(F.count("*").alias("queries"), F.count(F.when(F.col("coverage") == 1, 1)).alias("complete"), *means)


def kappa(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """n, agreement and Cohen's kappa of two binary judgments; one row."""
    n, x, y, both = F.count("*"), F.avg(a.cast("double")), F.avg(b.cast("double")), F.avg((a == b).cast("double"))
    row = pairs.agg(n.alias("n"), both.alias("agreement"), (x * y + (1 - x) * (1 - y)).alias("chance"))
    return row.select("n", "agreement", F.when(F.col("chance") < 1, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))


def paired_delta(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """One row: pairs, mean difference b - a, and how many rose, fell or stayed."""
    both = a.select(key, F.col(metric).alias("x")).join(b.select(key, F.col(metric).alias("y")), key).filter("x is not null and y is not null")
    d = F.col("y") - F.col("x")
    return both.agg(F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.count(F.when(d > 0, 1)).alias("rose"), F.count(F.when(d < 0, 1)).alias("fell"), F.count(F.when(d == 0, 1)).alias("same"))


def percentile_grade(scored: DataFrame, query: str, score: str) -> DataFrame:
    """Grades 3, 2, 1, 0 by the share of a query's scores at most one's own: .80, .50, .20."""
    share = F.cume_dist().over(W.partitionBy(query).orderBy(score))
    return scored.withColumn("share", share).withColumn("grade", F.when(F.col("share") >= 0.8, 3).when(F.col("share") >= 0.5, 2).when(F.col("share") >= 0.2, 1).otherwise(0))


def error_analysis(run: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """Per query: false positives in the first k, relevant rows trapped in the next k, swaps that would mend, best precision."""
    joined = run.filter(F.col("rank") <= 2 * k).join(judgments, ["query_id", "id"], "left").withColumn("ok", F.coalesce(F.col("grade") > 0, F.lit(False)))
    false, trapped = F.count(F.when((F.col("rank") <= k) & ~F.col("ok"), 1)), F.count(F.when((F.col("rank") > k) & F.col("ok"), 1))
    per = joined.groupBy("query_id").agg(false.alias("false_positives"), trapped.alias("trapped"), F.count(F.when((F.col("rank") <= k) & F.col("ok"), 1)).alias("hits"))
    swaps = F.least("false_positives", "trapped")
    return per.select("query_id", "false_positives", "trapped", swaps.alias("swaps"), ((F.col("hits") + swaps) / k).alias("oracle_precision"))
