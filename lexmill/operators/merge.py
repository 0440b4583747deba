"""Merging of records: components of links, staged matching by keys, merged values, reconciliation of inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, or a temporary one for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lexmill-')}")
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """id, root (the least id of its component) for both ends (a, b) of every link.

    Least labels spread along links and jump to their label's label, so rounds grow with the logarithm of the width.
    """
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("next"))
        new = cut_lineage(lower.join(jump, "root", "left").select("id", "old", F.least("root", "next").alias("root")))
        labels = new.select("id", "root")
        if new.filter("old <> root").isEmpty():
            return labels


def veto(links: DataFrame, records: DataFrame, id_col: str, anchor: str) -> DataFrame:
    """Links without those whose ends have different anchors."""
    known = records.filter(F.col(anchor).isNotNull()).select(F.col(id_col).alias("_i"), F.col(anchor).alias("_x"))
    a, b = known.select(F.col("_i").alias("a"), F.col("_x").alias("_xa")), known.select(F.col("_i").alias("b"), F.col("_x").alias("_xb"))
    return links.join(a, "a", "left").join(b, "b", "left").filter("_xa is null or _xb is null or _xa = _xb").select(*links.columns)


def staged_match(new: DataFrame, old: DataFrame, new_id: str, old_id: str, keys: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """new_id, old_id, stage: the first key in order that finds an old record (its least id); null without one.

    Each stage looks only at what earlier stages left, and matches do not chain.
    """
    out, left = None, new
    for stage, (of_new, of_old) in keys.items():
        table = old.select(of_old.alias("_k"), F.col(old_id)).filter("_k is not null").groupBy("_k").agg(F.min(old_id).alias(old_id))
        keyed = left.withColumn("_k", of_new)
        hit = keyed.join(table, "_k").select(new_id, old_id, F.lit(stage).alias("stage"))
        out = hit if out is None else out.unionByName(hit)
        left = keyed.join(table.select("_k"), "_k", "left_anti").drop("_k")
    return out.unionByName(left.select(new_id, F.lit(None).cast(dict(old.dtypes)[old_id]).alias(old_id), F.lit("new").alias("stage")))


def merged(records: DataFrame, key: Sequence[str], longest: Sequence[str] = (), any_true: Sequence[str] = (), most: Sequence[str] = (), sets: Sequence[str] = ()) -> DataFrame:
    """One row per key: the longest text (least among ties), true if any is, the greatest number, sorted distinct values."""
    parts = [F.max_by(F.col(c), F.struct(F.length(c), F.reverse(c))).alias(c) for c in longest]
    parts += [F.bool_or(c).alias(c) for c in any_true] + [F.max(c).alias(c) for c in most] + [F.array_sort(F.collect_set(c)).alias(c) for c in sets]
    return records.groupBy(*key).agg(F.count("*").alias("records"), *parts)


def reconcile(left: DataFrame, right: DataFrame, exact: Sequence[str], loose: Sequence[str]) -> DataFrame:
    """Rows of both inventories by the exact key with where they are found, and a review flag where exactly one row of
    each side that has no exact match agrees on the loose key; flagged rows are not merged."""
    l, r = (df.select(*exact).distinct() for df in (left, right))
    both = l.withColumn("in_left", F.lit(True)).join(r.withColumn("in_right", F.lit(True)), list(exact), "full_outer").na.fill(False, ["in_left", "in_right"])
    lone = both.filter("not (in_left and in_right)")
    review = lone.groupBy(*loose).agg(F.count(F.when(F.col("in_left"), 1)).alias("_l"), F.count(F.when(F.col("in_right"), 1)).alias("_r")).filter("_l = 1 and _r = 1").select(*loose, F.lit(True).alias("_review"))
    joined = both.join(review, list(loose), "left")
    return joined.select(*exact, "in_left", "in_right", (F.coalesce("_review", F.lit(False)) & ~(F.col("in_left") & F.col("in_right"))).alias("review"))


def partition_check(rows: DataFrame, found: str, truth: str) -> DataFrame:
    """One row: groups of the found partition that mix truths, and truths that are split over groups."""
    mixes = rows.groupBy(found).agg(F.countDistinct(truth).alias("k")).agg(F.count("*").alias("groups"), F.count(F.when(F.col("k") > 1, 1)).alias("false_merges"))
    splits = rows.groupBy(truth).agg(F.countDistinct(found).alias("k")).agg(F.count("*").alias("truths"), F.count(F.when(F.col("k") > 1, 1)).alias("false_splits"))
    return mixes.crossJoin(splits)  # one row each


def stratified(rows: DataFrame, strata: Sequence[str], id_col: str, n: int, seed: str) -> DataFrame:
    """n rows per stratum in the order of seeded hashes of their ids."""
    from pyspark.sql import Window as W

    key = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*strata).orderBy(key, id_col))).filter(F.col("_r") <= n).drop("_r")
