"""Curation by tables and rules that the caller gives: labels, candidates, contributions, variants, issues, indexes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators.relational import join_rows

#: Labels that a record gets from rules at most.
MOST_LABELS = 8


def label_by_rules(records: DataFrame, text: Column, rules: Sequence[tuple[str, str]], editorial: Column, most: int = MOST_LABELS) -> DataFrame:
    """records with labels (array) and provenance: editorial labels (an array, null for none) prevail, else those of the
    ordered (pattern, label) rules that the text matches, each once, the first `most`; `derived` or `none`."""
    derived = F.slice(F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(pattern), label) for pattern, label in rules]))), 1, most)
    given = F.size(F.coalesce(editorial, F.array().cast("array<string>"))) > 0
    return records.withColumn("labels", F.when(given, editorial).otherwise(derived)).withColumn("provenance", F.when(given, "editorial").when(F.size(derived) > 0, "derived").otherwise("none"))


def contributions(facts: DataFrame, work: str, name: Column, role: str, clash: Sequence[str] = ("author", "supervisor")) -> DataFrame:
    """work, name, roles (sorted, each once), collision: whether one name has all of the roles that exclude each other."""
    roles = F.array_sort(F.collect_set(role))
    wanted = F.array(*map(F.lit, clash))
    return facts.groupBy(work, name.alias("name")).agg(roles.alias("roles")).withColumn("collision", F.size(F.array_intersect("roles", wanted)) == len(clash))


def best_variant(records: DataFrame, id_col: str, variants: Mapping[str, Column], hints: Mapping[str, Sequence[tuple[str, int]]]) -> DataFrame:
    """id, variant, score: the variant of most points for the hints that it holds, then the longest, then the least name;
    `first` where no variant holds a hint. hints: per variant, (phrase, points)."""
    scored = [(v, reduce(Column.__add__, [x.contains(phrase).cast("int") * points for phrase, points in hints.get(v, ())], F.lit(0)), x) for v, x in variants.items()]
    best = F.array_min(F.array(*[F.struct((-F.coalesce(s, F.lit(0))).alias("s"), (-F.coalesce(F.length(x), F.lit(0))).alias("n"), F.lit(v).alias("v")) for v, s, x in scored]))
    return records.select(id_col, F.when(best["s"] < 0, best["v"]).otherwise("first").alias("variant"), (-best["s"]).alias("score"))


def issue_order(records: DataFrame, issue: str, year: str) -> DataFrame:
    """issue, n, newest, place: identified issues first, then by newest year, size and name. A row an issue."""
    per = records.groupBy(issue).agg(F.count("*").alias("n"), F.max(year).alias("newest"))
    by = W.partitionBy(F.lit(0)).orderBy(F.col(issue).isNull(), F.desc("newest"), F.desc("n"), issue)
    return per.withColumn("place", F.row_number().over(by))


def admission(candidates: DataFrame, base: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """rule, n: candidates that exist already, lack a required field, repeat a key, and those that may join (none of it)."""
    whole = reduce(Column.__and__, [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in required], F.lit(True))
    per = candidates.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(~whole, 1)).alias("incomplete"))
    known = per.join(base.select(key).distinct().withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    counts = known.agg(
        F.sum(F.when(F.col("known"), F.col("n"))).alias("exists already"), F.sum("incomplete").alias("incomplete"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("repeated"),
        F.count(F.when(~F.col("known") & (F.col("n") == 1) & (F.col("incomplete") == 0), 1)).alias("admitted"),
    )
    names = ("exists already", "incomplete", "repeated", "admitted")
    return counts.select(F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias("n")) for x in names])).alias("x")).select("x.rule", "x.n")


def topic_scores(topics: DataFrame, topic: Sequence[str], signals: Sequence[tuple[Column, str]], evidence: Column, anchor: Column, least: int = 8) -> DataFrame:
    """topic, score, works of topics that reach `least`: 8 for each signal phrase that a field holds, 4 if all rows have
    the anchor, at most 2 for distinct evidence."""
    held = reduce(Column.__add__, [F.max(x.contains(phrase).cast("int")) for x, phrase in signals])
    score = 4 * F.bool_and(anchor).cast("int") + 8 * held + F.least(F.lit(2), F.count_distinct(evidence))
    return topics.groupBy(*topic).agg(score.alias("score"), F.count("*").alias("works")).filter(F.col("score") >= least)


def source_hits(records: DataFrame, source: str, text: Column, expansions: DataFrame) -> DataFrame:
    """query, weight, source, hits: each expansion (query, weight) asked of each source; a source without hits has zero.

    Expansions are a query's few; they are broadcast if they are, and the records are read once.
    """
    asked = join_rows(records.select(source, text.alias("_text")), expansions.select("query", "weight"))
    return asked.groupBy("query", "weight", source).agg(F.count(F.when(F.col("_text").contains(F.col("query")), 1)).alias("hits"))


def related_canon(works: DataFrame, person: str, concept: str, persons: DataFrame, concepts: DataFrame) -> DataFrame:
    """works whose person is among a query's persons, with concept_overlap: 1 if their concept is among its concepts."""
    mine = works.join(persons.select(F.col(persons.columns[0]).alias(person)).distinct(), person, "left_semi")
    shared = concepts.select(F.col(concepts.columns[0]).alias(concept)).distinct().withColumn("_c", F.lit(1))
    return mine.join(shared, concept, "left").withColumn("concept_overlap", F.coalesce("_c", F.lit(0))).drop("_c")


def index_state(index: DataFrame, bucket: str, right: Column, works: str, least: float = 0.95) -> DataFrame:
    """bucket, n, misplaced (rows whose bucket is not `right`), works, coverage (share with works), enough."""
    share = F.avg(F.when(F.col(works) > 0, 1.0).otherwise(0.0))
    return index.groupBy(bucket).agg(F.count("*").alias("n"), F.count(F.when(~F.col(bucket).eqNullSafe(right), 1)).alias("misplaced"), F.sum(works).alias("works"), F.round(share, 6).alias("coverage"), (share >= least).alias("enough"))


def reasons(builders: Sequence[Column], most: int = 6) -> Column:
    """The first distinct reasons of builders in their order; each builder is an array, nulls say nothing."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.array_compact(F.flatten(F.array(*[F.coalesce(b, none) for b in builders])))), 1, most)


def result_reasons(title: Column, authors: Column, by_author: Column, persons: Mapping[str, Sequence[str]], concepts: Mapping[str, Sequence[str]], works: Sequence[str], topics: Column, journal: Column, outside: Column, queries: Column, providers: Column, doi: Column, year: Column, is_open: Column) -> Sequence[Column]:
    """Builders in the order of an explanation: authorship, persons, concepts, works, discipline, queries, providers, bibliography.

    title is folded, names by which persons and concepts are known are too; topics, journal and outside are percentages;
    authors, queries and providers are arrays.
    """
    holds = lambda names: reduce(Column.__or__, [title.contains(n) for n in names], F.lit(False))
    many = F.size(providers)
    return (
        F.array(F.when(by_author & (F.size(authors) > 0), F.concat(F.lit("by the person asked for: "), F.array_join(authors, ", ")))),
        F.array(*[F.when(holds(names), F.lit(f"title names {who}")) for who, names in persons.items()]),
        F.array(*[F.when(holds(names), F.lit(f"title has the concept {what}")) for what, names in concepts.items()]),
        F.array(*[F.when(title.contains(w), F.lit(f"is the work {w}")) for w in works]),
        F.array(F.when(topics >= 35, "topics of the discipline"), F.when(journal >= 30, "journal of the discipline"), F.when(outside > 0, "signals of other disciplines")),
        F.array(F.when(F.size(queries) == 1, F.concat(F.lit("found by "), F.get(queries, F.lit(0)))).when(F.size(queries) > 1, F.concat(F.lit("found by "), F.size(queries).cast("string"), F.lit(" variants of the query")))),
        F.array(F.when(many == 1, F.concat(F.lit("from "), F.get(providers, F.lit(0)))).when(many > 1, F.concat(F.lit("identified by "), F.array_join(providers, " and ")))),
        F.array(F.when(doi.isNotNull() & (doi != ""), "has a DOI"), F.when((F.size(authors) > 0) & year.isNotNull(), "authors and date are known"), F.when(is_open, "open access")),
    )
