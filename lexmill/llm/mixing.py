"""Mixing sources to target weights: a token budget falls down a tree of domain, language and source.

A node's tokens go to its children by weight. A child takes at most what it can give (its tokens times `max_epochs`);
what it cannot take goes to its siblings by their weights, and only what all siblings together cannot take is missing
at the parent, whose own siblings get it. For one node this is filling water to a level, which sorting the children by
capacity over weight gives in closed form with window sums, in whole numbers.

A leaf takes whole epochs, then a prefix of one more: its documents in the order of a MD5 of seed, epoch and id, as far
as their tokens fit. The prefix is one key per leaf: sums per leaf and three hex digits of the key find the digits at
which the budget ends, and only those few rows are summed one by one, so no leaf is ever sorted in one task.

A weight of 0 anywhere on a leaf's path: nothing of it is taken, and its siblings get what it would have.

Null or missing domain, language, source: as the empty name. Null text: no tokens; a document without tokens is taken
with its neighbours in the order. Very long texts are counted whole; one that does not fit ends its leaf's prefix. Rows
with equal ids have equal keys and are taken together. Empty table: no rows. Columns keep their places and values
whatever their names: while documents are mixed they are known by their positions.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.llm.common import join_lookup, materialise

LEVELS = ("mix_domain", "mix_lang", "mix_source")


@dataclass(frozen=True)
class Plan:
    """Whole-number weights per name of a level, `other` for names not listed; budget in percent of the tokens there."""

    domains: Mapping[str, int] = field(default_factory=dict)
    languages: Mapping[str, int] = field(default_factory=dict)
    sources: Mapping[str, int] = field(default_factory=dict)
    other: int = 10
    budget_percent: int = 100
    max_epochs: int = 2
    seed: int = 11

    def weight(self, level: int) -> Column:
        out = F.lit(self.other)
        for name, n in (self.domains, self.languages, self.sources)[level].items():
            out = F.when(F.col(LEVELS[level]) == name, n).otherwise(out)
        return out.cast("long")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _named(docs: DataFrame, domain: Column, lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(x.cast("string"), F.lit("")).alias(level) for level, x in zip(LEVELS, (domain, F.col(lang_col), F.col(source_col)), strict=True)]


def fill(children: DataFrame, parent: list[str], weight: Column) -> DataFrame:
    """children(.., cap, budget of the parent) with the share each gets; weights are positive, all of a parent's rows carry its budget."""
    weighted = children.withColumn("w", weight)
    ratio = F.col("cap") / F.col("w")
    all_of = W.partitionBy(*parent, F.lit(0))
    # peers of equal capacity over weight are full together, so sums that include them decide alike
    upto = all_of.orderBy(ratio)
    summed = weighted.withColumn("cap_to", F.sum("cap").over(upto)).withColumn("w_to", F.sum("w").over(upto)).withColumn("w_all", F.sum("w").over(all_of))
    full = F.col("cap_to").cast("decimal(38,0)") * F.col("w") + F.col("cap").cast("decimal(38,0)") * (F.col("w_all") - F.col("w_to")) <= F.col("budget").cast("decimal(38,0)") * F.col("w")
    marked = summed.withColumn("full", full)
    left = marked.withColumn("cap_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_of), F.lit(0))).withColumn("w_open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(all_of), F.lit(0)))
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("least(cap, cast((cast(budget as decimal(38,0)) - cap_full) * w div w_open as bigint))"))
    return left.withColumn("share", share.cast("long")).drop("w", "cap_to", "w_to", "w_all", "full", "cap_full", "w_open", "budget")


def leaf_budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """LEVELS, tokens, share of every leaf that can be given any: a weight of 0 on its path takes its tokens out of every
    node's capacity, though not out of what the budget is a percentage of. leaves: LEVELS, tokens."""
    wanted = reduce(Column.__and__, [plan.weight(i) > 0 for i in range(len(LEVELS))])
    every = leaves.withColumn("every", F.sum("tokens").over(W.partitionBy(F.lit(0))))
    capped = every.filter((F.col("tokens") > 0) & wanted).withColumn("cap", F.col("tokens") * plan.max_epochs)
    out = None
    for i in range(len(LEVELS)):
        keys = list(LEVELS[: i + 1])
        nodes = capped.groupBy(*keys).agg(F.sum("cap").cast("long").alias("cap"), F.sum("tokens").cast("long").alias("tokens"), F.first("every").alias("every"))
        if out is None:
            nodes = nodes.withColumn("budget", F.floor(F.col("every") * plan.budget_percent / 100).cast("long"))
        else:
            nodes = nodes.join(out.select(*keys[:-1], F.col("share").alias("budget")), keys[:-1])
        out = fill(nodes, keys[:-1], plan.weight(i))
    return out.select(*LEVELS, "tokens", "share")


def order_key(plan: Plan, doc_id: Column, epoch: Column) -> Column:
    """The place of a document in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(plan.seed), F.coalesce(epoch, F.lit(0)).cast("string"), doc_id.cast("string")))


def cuts(docs: DataFrame, plan: Plan, domain: Column, id_col: str, lang_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents' ids, leaves, keys and tokens; and per leaf its whole epochs and the last key of the prefix of one more."""
    counted = materialise(docs.select(F.col(id_col).alias("mix_id"), *_named(docs, domain, lang_col, source_col), count_words(F.col(text_col)).alias("mix_tokens")), "mix")
    leaves = materialise(leaf_budgets(counted.groupBy(*LEVELS).agg(F.sum("mix_tokens").alias("tokens")), plan), "mix-leaves")
    leaves = materialise(leaves.select(*LEVELS, F.expr("share div tokens").alias("epochs"), (F.col("share") % F.col("tokens")).alias("rest")), "mix-epochs")
    narrow = join_lookup(counted, leaves.select(*LEVELS, F.col("epochs").alias("mix_epoch")), list(LEVELS)).withColumn("mix_key", order_key(plan, F.col("mix_id"), F.col("mix_epoch")))
    parts = materialise(narrow.groupBy(*LEVELS, F.substring("mix_key", 1, 3).alias("digits")).agg(F.sum("mix_tokens").alias("tokens")), "mix-parts")
    placed = parts.withColumn("upto", F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("digits"))).join(leaves, list(LEVELS))
    edge = materialise(placed.filter("upto > rest").groupBy(*LEVELS, "epochs", "rest").agg(F.min(F.struct("digits", (F.col("upto") - F.col("tokens")).alias("before"))).alias("at")).select(*LEVELS, "epochs", "rest", "at.digits", "at.before"), "mix-edges")
    inside = join_lookup(narrow.withColumn("digits", F.substring("mix_key", 1, 3)), edge, [*LEVELS, "digits"], "inner")
    run = F.col("before") + F.sum("mix_tokens").over(W.partitionBy(*LEVELS).orderBy("mix_key"))
    ends = inside.withColumn("run", run).filter("run <= rest").groupBy(*LEVELS).agg(F.max("mix_key").alias("end"))
    # no document at the edge fits: the prefix ends with the digits before, and "3fa" sorts under any key "3fa..."
    out = edge.join(ends, list(LEVELS), "left").select(*LEVELS, "epochs", F.when(F.col("rest") > 0, F.coalesce("end", "digits")).otherwise("").alias("last_key"))
    return narrow, materialise(out.withColumnsRenamed({"epochs": "mix_epochs", "last_key": "mix_last_key"}), "mix-cuts")


def copies(key: Column) -> Column:
    """How often a document is taken."""
    return (F.coalesce(F.col("mix_epochs"), F.lit(0)) + F.when(key <= F.col("mix_last_key"), 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, plan: Plan, domain: Column, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: id, domain, language, source (empty for null), tokens, copies."""
    narrow, ends = cuts(docs, plan, domain, id_col, lang_col, source_col, text_col)
    joined = join_lookup(narrow, ends, list(LEVELS))
    return joined.select(F.col("mix_id").alias(id_col), *[F.col(x).alias(x.removeprefix("mix_")) for x in LEVELS], F.col("mix_tokens").alias("n_tokens"), copies(F.col("mix_key")).alias("copies"))


def mix(docs: DataFrame, plan: Plan, domain: Column, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents taken, each as often as it is taken, with their columns; texts are not shuffled."""
    _, ends = cuts(docs, plan, domain, id_col, lang_col, source_col, text_col)
    own = [f"own_{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)], *_named(docs, domain, lang_col, source_col), F.col(id_col).cast("string").alias("mix_id"))
    joined = join_lookup(keyed, ends, list(LEVELS))
    taken = joined.withColumn("mix_copies", copies(order_key(plan, F.col("mix_id"), F.col("mix_epochs"))).cast("int")).filter("mix_copies > 0")
    return taken.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies")))).select(*own).toDF(*docs.columns)
