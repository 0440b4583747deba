"""Answers of services, made up of works and customers as pages of payloads, and the records read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.plans.inputs import WORKS, registry, relation
from lexmill.sources import responses as R

QUERIES, ORACLE, query = registry()
C = F.col


def _pages(rows: DataFrame, item: Column, wrap: str, by: str = "id div 50") -> DataFrame:
    """(page, body): items of fifty works as one JSON text, in the order of ids; wrap holds %s for the list."""
    listed = rows.groupBy(F.expr(by).alias("page")).agg(F.sort_array(F.collect_list(F.struct("id", item.alias("item")))).alias("items"))
    before, after = wrap.split("%s")
    return listed.select("page", F.concat(F.lit(before), F.to_json(C("items.item")), F.lit(after)).alias("body"))


def _flat(found: DataFrame, *columns: str) -> DataFrame:
    kinds = dict(found.dtypes)
    return found.select("page", C("rank").cast("long").alias("rank"), *[F.array_join(c, ";").alias(c) if kinds[c].startswith("array") else C(c) for c in columns])


_SQL_RANK = "id // 50 AS page, row_number() OVER (PARTITION BY id // 50 ORDER BY id) AS rank"


@query(f"SELECT {_SQL_RANK}, 'W' || id AS record_id, title, author || CASE WHEN id % 3 = 0 THEN ';Second' ELSE '' END AS authors, year, doi, topic AS topics, citations AS cited_by, id % 2 = 0 AS open, CASE WHEN id % 4 = 0 THEN 'https://open/' || id ELSE 'W' || id END AS url FROM ({WORKS})")
def works_records(spark, d):
    """Works as a service of works gives them."""
    person = lambda x: F.struct(F.struct(x.alias("display_name")).alias("author"))
    own = F.concat(F.lit("W"), C("id").cast("string"))
    item = F.struct(
        own.alias("id"), C("title").alias("display_name"), F.when(C("id") % 3 == 0, F.array(person(C("author")), person(F.lit("Second")))).otherwise(F.array(person(C("author")))).alias("authorships"), C("year").alias("publication_year"),
        F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), F.array(F.struct(C("topic").alias("display_name"))).alias("topics"), C("citations").alias("cited_by_count"), F.struct((C("id") % 2 == 0).alias("is_oa")).alias("open_access"),
        F.when(C("id") % 4 == 0, F.struct(F.concat(F.lit("https://open/"), C("id").cast("string")).alias("landing_page_url"))).alias("best_oa_location"),
    )
    found = R.works_records(_pages(relation(spark, d, WORKS), item, '{"results":%s}'), "body", ["page"])
    return _flat(found, "record_id", "title", "authors", "year", "doi", "topics", "cited_by", "open", "url")


@query(f"""
SELECT page, rank, 'registry:' || coalesce(doi, 'http://r/' || id) AS record_id, 'On ' || title || ' & more' AS title, 'A. ' || author AS authors, CASE WHEN id % 2 = 0 THEN year ELSE year + 1 END AS year, CASE WHEN id % 6 = 0 THEN '97800' || id ELSE '' END AS isbn,
  topic AS journal, coalesce('https://doi.org/' || doi, 'http://r/' || id) AS url FROM (SELECT *, {_SQL_RANK} FROM ({WORKS})) WHERE id % 9 > 0 AND id % 10 <> 1""")
def registry_records(spark, d):
    """Works as a registry of DOIs gives them, with markup in titles, among journals and entries without a title."""
    parts = lambda y: F.struct(F.array(F.array(y)).alias("date-parts"))
    title = F.when(C("id") % 10 == 1, "<b> </b>").otherwise(F.concat(F.lit("<i>On</i> "), C("title"), F.lit(" &amp; more")))
    item = F.struct(
        C("doi").alias("DOI"), F.when(C("doi").isNull(), F.concat(F.lit("http://r/"), C("id").cast("string"))).alias("URL"), F.array(title).alias("title"), F.array(F.struct(F.lit("A.").alias("given"), C("author").alias("family"))).alias("author"),
        F.when(C("id") % 2 == 0, parts(C("year"))).alias("published-print"), parts(C("year") + 1).alias("issued"), F.when(C("id") % 6 == 0, F.array(F.concat(F.lit("978-00 "), C("id").cast("string")))).alias("ISBN"),
        F.array("topic").alias("container-title"), F.when(C("id") % 9 == 0, "Journal").otherwise("article").alias("type"),
    )
    found = R.registry_records(_pages(relation(spark, d, WORKS), item, '{"message":{"items":%s}}'), "body", ["page"])
    return _flat(found, "record_id", "title", "authors", "year", "isbn", "journal", "url")


_SQL_LANGUAGE = "CASE id % 5 WHEN 0 THEN 'es' WHEN 1 THEN 'de' WHEN 2 THEN 'nl' END"


@query(f"""
SELECT {_SQL_RANK}, 'archive:item ' || id AS record_id, title, author || CASE WHEN id % 2 = 0 THEN ';Editor é' ELSE '' END AS authors, CASE WHEN id % 3 = 0 THEN NULL ELSE year END AS year, {_SQL_LANGUAGE} AS language, topic || CASE WHEN id % 2 = 0 THEN ';text' ELSE '' END AS topics,
  'https://archive.org/details/item%20' || id AS url FROM ({WORKS})""")
def archive_records(spark, d):
    """Works as an archive gives them: fields are lists for every other item, years stand in dates for some."""
    even, key = C("id") % 2 == 0, F.concat(F.lit("item "), C("id").cast("string"))
    language = F.element_at(F.array(*map(F.lit, ("Spanish", "ger", "NL", "Klingon", ""))), (C("id") % 5 + 1).cast("int"))
    year = F.when(C("id") % 3 == 1, C("year").cast("string"))
    date = F.when(C("id") % 3 == 2, F.concat(C("year").cast("string"), F.lit("-05-01T00:00:00Z")))
    shared = [key.alias("identifier"), year.alias("year"), date.alias("date"), language.alias("language")]
    lists = F.to_json(F.struct(*shared, F.array("title").alias("title"), F.array("author", F.lit("Editor &eacute;")).alias("creator"), F.array("topic", F.lit("<i>text</i>")).alias("subject")))
    ones = F.to_json(F.struct(*shared, "title", C("author").alias("creator"), C("topic").alias("subject")))
    rows = relation(spark, d, WORKS)
    listed = rows.groupBy(F.expr("id div 50").alias("page")).agg(F.sort_array(F.collect_list(F.struct("id", F.when(even, lists).otherwise(ones).alias("item")))).alias("items"))
    pages = listed.select("page", F.concat(F.lit('{"response":{"docs":['), F.array_join("items.item", ","), F.lit("]}}")).alias("body"))
    return _flat(R.archive_records(pages, "body", ["page"]), "record_id", "title", "authors", "year", "language", "topics", "url")


@query(f"""
SELECT id // 50 AS page, rank, 'orcid:' || who || ':' || (10 * id) AS record_id, CASE WHEN id % 4 = 0 THEN title ELSE 'Full ' || title END AS title, year, CASE WHEN id % 4 = 0 THEN NULL ELSE doi END AS doi, CASE WHEN id % 4 <> 0 AND doi IS NOT NULL THEN 'https://doi.org/' || doi ELSE 'https://orcid.org/' || who END AS url
FROM (SELECT *, '0000-0000-0000-' || lpad(CAST(id // 50 AS VARCHAR), 4, '0') AS who, {_SQL_RANK} FROM ({WORKS})) WHERE id % 7 > 0""")
def person_records(spark, d):
    """Works as a person's public record gives them: several summaries of a work, some private."""
    value = lambda x: F.struct(x.cast("string").alias("value"))
    seen = F.when(C("id") % 7 == 0, "private").otherwise("public").alias("visibility")
    ids = F.struct(F.when(C("doi").isNotNull() & (C("id") % 4 != 0), F.array(F.struct(F.lit("DOI").alias("external-id-type"), F.concat(F.lit("doi:"), "doi").alias("external-id-value")))).alias("external-id"))
    summary = lambda n, title, more: F.struct((C("id") * 10 + n).alias("put-code"), seen, F.struct(value(title).alias("title")).alias("title"), F.struct(value(C("year")).alias("year")).alias("publication-date"), more.alias("external-ids"))
    short = F.to_json(F.struct((C("id") * 10).alias("put-code"), seen, F.struct(value(C("title")).alias("title")).alias("title")))
    full = F.to_json(summary(1, F.concat(F.lit("Full "), C("title")), ids))
    group = F.concat(F.lit('{"work-summary":['), short, F.when(C("id") % 4 == 0, F.concat(F.lit(',{"put-code":1,"visibility":"limited"},'), F.to_json(F.struct((C("id") * 10 + 2).alias("put-code"), seen, F.struct(value(C("year")).alias("year")).alias("publication-date"))))).otherwise(F.concat(F.lit(","), full)), F.lit("]}"))
    listed = relation(spark, d, WORKS).groupBy(F.expr("id div 50").alias("page")).agg(F.sort_array(F.collect_list(F.struct("id", group.alias("item")))).alias("items"))
    pages = listed.select("page", F.concat(F.lit('{"group":['), F.array_join("items.item", ","), F.lit("]}")).alias("body"), F.concat(F.lit("0000-0000-0000-"), F.lpad(C("page").cast("string"), 4, "0")).alias("who"))
    return _flat(R.person_records(pages, "body", "who", ["page"]), "record_id", "title", "year", "doi", "url")


@query("""
SELECT c_nationkey AS page, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank, '0000-0000-' || lpad(CAST(c_custkey // 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS orcid,
  CASE WHEN c_custkey % 3 = 0 THEN 'Credit, "' || c_name || '"' ELSE 'Given ' || c_name END AS name, 'Other;' || c_mktsegment AS other_names FROM customer""")
def profile_records(spark, d):
    """People as a search in CSV gives them, with quoted commas, quotes and line ends."""
    customers = relation(spark, d, "SELECT c_custkey AS id, c_nationkey AS nation, c_name AS name, c_mktsegment AS segment FROM customer")
    who = F.concat(F.lit("0000-0000-"), F.lpad(F.floor(C("id") / 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((C("id") % 10000).cast("string"), 4, "0"))
    credit = F.when(C("id") % 3 == 0, F.concat(F.lit('"Credit, ""'), C("name"), F.lit('"""'))).otherwise(F.lit(""))
    line = F.concat(who, F.lit(",Given,"), C("name"), F.lit(","), credit, F.lit(',"Other | '), C("segment"), F.lit(' ; Other"'))
    listed = customers.groupBy(C("nation").alias("page")).agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("lines"))
    pages = listed.select("page", F.concat(F.lit("orcid,given-names,family-name,credit-name,other-name\r\n"), F.array_join("lines.line", "\r\n")).alias("body"))
    return _flat(R.profile_records(pages, "body", ["page"]), "orcid", "name", "other_names")
