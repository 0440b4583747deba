"""Query understanding: entities by alias phrases, areas by weighted evidence, expansions that keep what was asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lexmill.functions import ranking, text


def detect(queries: DataFrame, id_col: str, text_col: str, aliases: DataFrame) -> DataFrame:
    """(id, entity, kind, alias): aliases that stand in a text as whole words; the longest alias of an entity wins.

    Texts give their word n-grams of the lengths that the table's aliases have, which join the folded aliases: no text
    meets an alias that it does not hold.
    """
    known = aliases.select("entity", "kind", text.fold(F.col("alias")).alias("alias")).filter("alias <> ''")
    lengths = sorted(r[0] for r in known.select(F.size(F.split("alias", " "))).distinct().collect())  # a number or few
    words = queries.select(F.col(id_col).alias("id"), text.tokens(F.col(text_col)).alias("w"))

    def grams_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))

    none = F.array().cast("array<string>")
    spans = F.array_distinct(F.flatten(F.array(none, *[F.when(F.size("w") >= n, grams_of(n)).otherwise(none) for n in lengths])))
    found = words.select("id", F.explode(spans).alias("alias")).join(known, "alias")
    best = F.max_by(F.struct("alias", "kind"), F.struct(F.length("alias"), F.col("alias")))
    return found.groupBy("id", "entity").agg(best.alias("b")).select("id", "entity", "b.kind", "b.alias")


def infer_areas(detected: DataFrame, areas: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, area, confidence, reasons): evidence summed by the kind of entity, at most 1."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("kind")]
    rows = detected.join(areas, "entity").withColumn("weight", F.coalesce(weight, F.lit(0.0)))
    return rows.groupBy("id", "area").agg(F.least(F.lit(1.0), F.round(F.sum("weight"), 6)).alias("confidence"), F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("reasons"))


def expansions(queries: DataFrame, detected: DataFrame, translations: DataFrame, most: int = 6) -> DataFrame:
    """(id, query, kind, weight): the original, and it with one detected alias replaced by a translation of its entity.

    What an expansion keeps of the original's other words is all of them; weights fall, equal texts are given once.
    """
    from pyspark.sql import Window as W

    original = queries.select("id", text.fold(F.col("query")).alias("query"), F.lit("original").alias("kind"), F.lit(1.0).alias("weight"))
    swapped = F.trim(F.replace(F.concat(F.lit(" "), F.col("query"), F.lit(" ")), F.concat(F.lit(" "), F.col("alias"), F.lit(" ")), F.concat(F.lit(" "), F.col("label"), F.lit(" "))))
    other = original.select("id", "query").join(detected.select("id", "entity", "alias"), "id").join(translations.select("entity", text.fold(F.col("label")).alias("label"), "weight"), "entity")
    made = other.filter("label <> alias").select("id", swapped.alias("query"), F.lit("translation").alias("kind"), "weight")
    rows = original.unionByName(made)
    best = rows.groupBy("id", "query").agg(F.max_by(F.struct("kind", "weight"), F.struct(F.col("weight"), F.col("kind"))).alias("b")).select("id", "query", "b.kind", "b.weight")
    return best.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("weight"), "query"))).filter(F.col("_r") <= most).drop("_r")


def understood(queries: DataFrame, aliases: DataFrame, areas: DataFrame, translations: DataFrame, weights: dict[str, float], most: int = 6) -> DataFrame:
    """One row per query (id, query) with all that a ranking needs to know of it, from tables alone.

    original: folded; expansions: (query, weight), best first, the original not among them; persons and concepts: all
    folded aliases of each detected entity of that kind, entities in order; works: the aliases of detected works; areas:
    (area, confidence, terms), terms being the folded aliases of the area's own entities of kind `area`. Nothing
    detected: empty arrays.
    """
    found = detect(queries, "id", "query", aliases)
    names = aliases.select("entity", "kind", text.fold(F.col("alias")).alias("alias")).filter("alias <> ''").groupBy("entity").agg(F.array_sort(F.collect_set("alias")).alias("names"), F.min("kind").alias("of"))
    known = found.select("id", "entity", "kind").join(names.select("entity", "names"), "entity")
    of_kind = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("entity", "names")))), lambda x: x["names"])
    entities = known.groupBy("id").agg(of_kind("person").alias("persons"), of_kind("concept").alias("concepts"), F.array_sort(F.array_distinct(F.flatten(of_kind("work")))).alias("works"))
    wider = expansions(queries, found, translations, most + 1).filter("kind <> 'original'")
    other = wider.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "query"))), 1, most).alias("e")).select("id", F.transform("e", lambda x: F.struct(x["query"].alias("query"), (-x["w"]).alias("weight"))).alias("expansions"))
    terms = areas.join(names.filter("of = 'area'"), "entity").groupBy("area").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("terms"))
    inferred = infer_areas(found, areas, weights).join(terms, "area", "left")
    none = F.array().cast("array<string>")
    by_area = inferred.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("area", "confidence", F.coalesce("terms", none).alias("terms")))).alias("areas"))
    out = queries.select("id", text.fold(F.col("query")).alias("original"))
    for part in (other, entities, by_area):
        out = out.join(part, "id", "left")
    empty = {"expansions": "array<struct<query: string, weight: double>>", "persons": "array<array<string>>", "concepts": "array<array<string>>", "works": "array<string>", "areas": "array<struct<area: string, confidence: double, terms: array<string>>>"}
    return out.select("id", "original", *[F.coalesce(F.col(c).cast(kind), F.array().cast(kind)).alias(c) for c, kind in empty.items()])


def as_understood(row: Row, area_terms: Sequence[Sequence[str]] = (), domain_terms: Sequence[Sequence[str]] = ()) -> ranking.Understood:
    """A row of `understood` as the ranking profile takes it."""
    return ranking.Understood(
        original=row.original, expansions=tuple((e.query, e.weight) for e in row.expansions), persons=tuple(map(tuple, row.persons)), concepts=tuple(map(tuple, row.concepts)), works=tuple(row.works),
        areas=tuple((tuple(a.terms), a.confidence) for a in row.areas if a.terms), area_terms=tuple(map(tuple, area_terms)), domain_terms=tuple(map(tuple, domain_terms)),
    )
