"""Relational operators: versions, best rows, conditional aggregates, ordered lists, histograms, rules, set changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_version(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    by = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(by)).filter("_rn = 1").drop("_rn")


def best_id(df: DataFrame, keys: Sequence[str], id_col: str, score_col: str, where: Column | None = None) -> DataFrame:
    """Id of the best score per key, the least id among ties; null ids and scores never win. Partial sums, no window."""
    kept = df.filter(F.col(id_col).isNotNull() & F.col(score_col).isNotNull())
    if where is not None:
        kept = kept.filter(where)
    best = F.max_by(F.struct(id_col, score_col), F.struct(F.col(score_col), -F.col(id_col)))
    return kept.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col(f"_b.{id_col}").alias("best_id"), F.col(f"_b.{score_col}").alias("best_score"))


def filtered_aggregates(df: DataFrame, keys: Sequence[str], parts: Mapping[str, tuple[str, Column, Column]]) -> DataFrame:
    """name -> (count|sum|max|min|avg, value, condition): one pass, each aggregate over the rows of its condition."""
    fn = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}
    return df.groupBy(*keys).agg(*[fn[how](F.when(cond, value)).alias(name) for name, (how, value, cond) in parts.items()])


def histogram(df: DataFrame, value: Column, width: float, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.floor(value / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def ordered_list(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: str, alias: str) -> DataFrame:
    """Items of each key in order; a key's rows meet in one row, so the list must fit there."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(item).alias("_item"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["_item"]).alias(alias))


def first_rule(df: DataFrame, rules: Sequence[tuple[str, Column]], default: str, alias: str) -> DataFrame:
    """The label of the first rule that holds."""
    out = None
    for label, cond in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return df.withColumn(alias, F.lit(default) if out is None else out.otherwise(default))


#: Rules that are broadcast at once.
RULE_BLOCK = 10_000


def rule_join(df: DataFrame, rules: DataFrame, matches: Column, id_col: str, priority: str, rule_id: str, columns: Sequence[str]) -> DataFrame:
    """Each row with the matching rule of highest priority (least id among ties), null where none matches.

    rules are counted and broadcast in blocks of at most about RULE_BLOCK rows, so a broadcast stays bounded; what each
    block finds is reduced to its best rule before the blocks meet.
    """
    blocks = -(-rules.count() // RULE_BLOCK)
    place = F.struct(-F.coalesce(F.col(priority).cast("long"), F.lit(-(2**40))), F.col(rule_id))
    best = F.min(F.struct(place.alias("_at"), F.struct(rule_id, *columns).alias("_b")))
    found = df.select(id_col).distinct().select(id_col, F.lit(None).cast(rules.select(F.struct(place.alias("_at"), F.struct(rule_id, *columns).alias("_b"))).schema[0].dataType).alias("_m"))
    for i in range(blocks):
        some = rules if blocks == 1 else rules.filter(F.pmod(F.xxhash64(rule_id), F.lit(blocks)) == i)
        found = found.unionByName(df.join(F.broadcast(some), matches).groupBy(id_col).agg(best.alias("_m")))
    picked = found.groupBy(id_col).agg(F.min("_m").alias("_m")).select(id_col, F.col("_m._b").alias("_b"))
    return picked.select(id_col, F.col(f"_b.{rule_id}").alias(rule_id), *[F.col(f"_b.{c}").alias(c) for c in columns])


def facet_counts(df: DataFrame, facets: Mapping[str, Column]) -> DataFrame:
    """facet, value, n of several facets in one pass."""
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value")) for name, value in facets.items()])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change (added, removed, changed) of the rows that differ; equal rows are left out."""
    columns = [c for c in old.columns if c != key]
    a = old.select(F.col(key).alias("_a"), F.struct(*columns).alias("_old"))
    b = new.select(F.col(key).alias("_b"), F.struct(*columns).alias("_new"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), change.alias("change")).filter("change is not null")


def overlay(base: DataFrame, curated: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Curated values prevail where they are there; curated keys are unique."""
    extra = curated.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_c_{c}") for c in columns])
    joined = base.join(extra, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(f"_c_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def keep_previous(new: DataFrame, previous: DataFrame, source: str) -> DataFrame:
    """The new rows, and the previous rows of sources that have none now."""
    return new.unionByName(previous.join(new.select(source).distinct(), source, "left_anti"))


#: Keys that one part of an allocation numbers.
PART_KEYS = 200_000


def allocate_ids(groups: DataFrame, registry: DataFrame, key: str, id_col: str, part_keys: int = PART_KEYS) -> DataFrame:
    """Registered ids stay; new keys get the following numbers in the order of the MD5 of their text, then of the keys.

    The new keys are counted and cut by their hash into parts of about `part_keys`; part sizes are summed first, and only
    then are keys numbered within their part, so numbers run through without one task that sorts all of them.
    """
    top = registry.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    fresh = groups.select(key).filter(F.col(key).isNotNull()).distinct().join(registry, key, "left_anti").withColumn("_h", F.md5(F.col(key).cast("string")))
    parts = max(1, -(-fresh.count() // part_keys))
    fresh = fresh.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.lit(parts) / F.lit(2**32)))
    sizes = fresh.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).alias("_before"))  # a row a part
    numbered = fresh.join(before, "_b").crossJoin(F.broadcast(top))  # one row
    place = F.row_number().over(W.partitionBy("_b").orderBy("_h", key))
    return registry.select(key, id_col).unionByName(numbered.select(key, (F.col("_top") + F.col("_before") + place).cast("long").alias(id_col)))


# By how much a new snapshot may have fewer or more rows of a group than the last one, in percent.
SHRINK, GROW = 10, 50


def snapshot_problems(new: DataFrame, old: DataFrame, key: str, required: Sequence[str], group: Column, shrink: int = SHRINK, grow: int = GROW) -> DataFrame:
    """rule, subject, n: what forbids publishing a snapshot; no rows if nothing does.

    Keys that repeat, required fields that are null or blank, and groups that lost more than `shrink` or gained more than
    `grow` percent of their rows (n is the change), vanished groups included; groups that are new may have any size.
    """
    repeated = new.groupBy(F.col(key).cast("string").alias("subject")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated key").alias("rule"), "subject", "n")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    counts = new.agg(*[F.count(F.when(blank(c), 1)).alias(c) for c in required])
    missing = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).alias("n")) for c in required])).alias("m")).select(F.lit("missing field").alias("rule"), "m.subject", "m.n").filter("n > 0")
    was, now = (df.groupBy(F.coalesce(group.cast("string"), F.lit("")).alias("subject")).agg(F.count("*").alias(n)) for df, n in ((old, "was"), (new, "now")))
    both = was.join(now, "subject", "left").withColumn("now", F.coalesce("now", F.lit(0)))
    change = (F.col("now") - F.col("was")).alias("n")
    shrunk = both.filter(F.col("now") * 100 < F.col("was") * (100 - shrink)).select(F.lit("shrunk").alias("rule"), "subject", change)
    grown = both.filter(F.col("now") * 100 > F.col("was") * (100 + grow)).select(F.lit("grown").alias("rule"), "subject", change)
    return repeated.union(missing).union(shrunk).union(grown)


def violations(checks: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """rule, n_rows, n_violations per check: (table, condition that must hold)."""
    out = None
    for name, (df, holds) in checks.items():
        row = df.agg(F.lit(name).alias("rule"), F.count("*").alias("n_rows"), F.count(F.when(~F.coalesce(holds, F.lit(False)), 1)).alias("n_violations"))
        out = row if out is None else out.unionByName(row)
    return out


#: Rows of a small table that every row of another meets, by a broadcast.
SMALL_ROWS = 1_000


def join_rows(df: DataFrame, few: DataFrame) -> DataFrame:
    """Every row of df with every row of a table of at most SMALL_ROWS rows, which are counted first; ValueError beyond."""
    if few.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        raise ValueError(f"a table of more than {SMALL_ROWS} rows is no small table")
    return df.crossJoin(F.broadcast(few))
