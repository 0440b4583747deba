"""Matching queries: one work from several records, persons, homonyms, shared authorities, saved items."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import ranking, text
from lexmill.operators import saved_works, works
from lexmill.plans.documents import sql_fold
from lexmill.plans.inputs import WORKS, registry, relation

QUERIES, ORACLE, query = registry()
C = F.col

#: Works of no, one or several authors; volumes named in several ways; DOIs that agree and differ.
RECORDS = f"""
SELECT id, CASE id % 23 WHEN 3 THEN concat(title, ' (II)') WHEN 5 THEN concat(title, ' volumen 3') WHEN 7 THEN concat(title, ' libro iv') WHEN 9 THEN 'Introducción' ELSE title END AS title,
  CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN concat(author, '; Second Writer', CAST(id % 3 AS STRING)) WHEN 2 THEN concat('First Writer', CAST(id % 3 AS STRING), '; ', author) ELSE author END AS authors, year, doi, provider, citations, abstract
FROM ({WORKS})"""
_VOLUME = "tomo|volumen|volume|vol|parte|part|book|libro|band"
_NUMERAL = "[0-9]+|[ivxlcdm]+"
_COMPARABLE = f"trim(regexp_replace(regexp_replace({sql_fold('title')} || ' ', '\\b(?:{_VOLUME}) ((?:{_NUMERAL}) )', ' \\1', 'g'), ' +', ' ', 'g'))"
_TOKENS = lambda x: f"list_sort(list_distinct(list_filter(string_split({sql_fold(x)}, ' '), lambda t: t <> '')))"
_KEYED = f"""
SELECT *, list_filter(tokens, lambda t: length(t) > 1 AND t NOT IN ({', '.join(map(repr, text.TITLE_STOPWORDS))}) AND NOT list_contains(flatten(list_transform(people, lambda x: string_split(x, ' '))), t)) AS w FROM (
  SELECT * REPLACE (lower(trim(doi)) AS doi), {_COMPARABLE} AS ct, {_TOKENS('title')} AS tokens,
    list_sort(list_distinct(list_concat(regexp_extract_all({sql_fold('title')}, '\\b(?:{_VOLUME}) ({_NUMERAL})\\b', 1), regexp_extract_all(lower(title), '\\(([ivxlcdm]+)\\)', 1)))) AS volumes,
    list_sort(list_distinct(list_filter(list_transform(string_split(authors, '; '), lambda a: array_to_string({_TOKENS('a')}, ' ')), lambda a: a <> ''))) AS people
  FROM ({RECORDS}))"""
_ENTITY = f"SELECT min(id) AS id, ct, volumes, people, year, doi, w FROM ({_KEYED}) GROUP BY ct, volumes, people, year, doi, w"
_NAMES = lambda x: f"list_filter(string_split({x}, ' '), lambda t: length(t) > 1)"
_EDGES = f"""
SELECT a, b, CASE WHEN lct = rct AND lct NOT IN ({', '.join(map(repr, text.GENERIC_TITLES))}) AND CASE WHEN people IS NULL THEN ly = ry AND least(len(lw), len(rw)) >= 2 ELSE people >= 0.67 END THEN 'equal'
    WHEN people >= 0.67 AND lct <> rct AND least(len(lw), len(rw)) >= 4 AND CASE WHEN both_ = least(len(lw), len(rw)) AND both_ >= 4 THEN 0.97 ELSE 0.7 * both_ / any_ + 0.3 * both_ / least(len(lw), len(rw)) END >= 0.88 THEN 'variant' END AS kind
FROM (SELECT l.id AS a, r.id AS b, l.ct AS lct, r.ct AS rct, l.w AS lw, r.w AS rw, l.year AS ly, r.year AS ry, len(list_intersect(l.w, r.w)) AS both_, len(list_distinct(list_concat(l.w, r.w))) AS any_,
    list_max(flatten(list_transform(l.people, lambda x: list_transform(r.people, lambda y: CASE WHEN least(len({_NAMES('x')}), len({_NAMES('y')})) = 0 THEN 0.0 ELSE len(list_intersect({_NAMES('x')}, {_NAMES('y')})) / least(len({_NAMES('x')}), len({_NAMES('y')})) END)))) AS people
  FROM ({_ENTITY}) l JOIN ({_ENTITY}) r ON l.id < r.id AND NOT (len(l.volumes) > 0 AND len(r.volumes) > 0 AND NOT list_has_any(l.volumes, r.volumes)) AND NOT (l.ct <> r.ct AND coalesce(l.doi <> r.doi, FALSE)))
WHERE kind IS NOT NULL"""
#: The fold of a component by a recursion over its entities, whose state is the list of those placed so far.
_MEMBERS = f"""
WITH RECURSIVE e AS MATERIALIZED ({_EDGES}), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(x, y) AS (SELECT a, b FROM both_ways UNION SELECT r.x, w.b FROM reach r JOIN both_ways w ON r.y = w.a),
root AS (SELECT x AS id, least(x, min(y)) AS root FROM reach GROUP BY x), ent AS MATERIALIZED ({_ENTITY}), k AS MATERIALIZED ({_KEYED}),
ordered AS MATERIALIZED (SELECT ent.id, ct, volumes, doi, root, row_number() OVER (PARTITION BY root ORDER BY ent.id) AS step, coalesce(links, []) AS links FROM ent JOIN root USING (id) LEFT JOIN (SELECT b AS id, list(a) AS links FROM e GROUP BY b) USING (id)),
fold AS (
  SELECT root, CAST(0 AS BIGINT) AS step, CAST([] AS STRUCT(id BIGINT, c BIGINT, ct VARCHAR, doi VARCHAR, volumes VARCHAR[])[]) AS placed FROM (SELECT DISTINCT root FROM root)
  UNION ALL
  SELECT f.root, o.step, list_append(f.placed, {{'id': CAST(o.id AS BIGINT), 'c': CAST(coalesce(list_min(list_filter(list_transform(list_filter(f.placed, lambda m: list_contains(o.links, m.id)), lambda m: m.c),
      lambda c: len(list_filter(f.placed, lambda m: m.c = c AND (len(m.volumes) > 0 AND len(o.volumes) > 0 AND NOT list_has_any(m.volumes, o.volumes) OR m.ct <> o.ct AND coalesce(m.doi <> o.doi, FALSE)))) = 0)), o.id) AS BIGINT),
    'ct': o.ct, 'doi': o.doi, 'volumes': o.volumes}})
  FROM fold f JOIN ordered o ON o.root = f.root AND o.step = f.step + 1),
placed AS (SELECT p.id, p.c FROM (SELECT unnest(arg_max(placed, step)) AS p FROM fold GROUP BY root))
SELECT k.*, coalesce(placed.c, ent.id) AS work_id FROM k JOIN ent ON k.ct = ent.ct AND k.volumes = ent.volumes AND k.people = ent.people AND k.year = ent.year AND k.w = ent.w AND k.doi IS NOT DISTINCT FROM ent.doi LEFT JOIN placed ON placed.id = ent.id"""


def _records(spark, d):
    return relation(spark, d, RECORDS).withColumn("authors", F.split("authors", "; "))


def _identity():
    return C("title"), C("authors"), C("year"), C("doi")



@query(_EDGES)
def same_work_edges(spark, d):
    return works.same_work_edges(works.entities(_records(spark, d), "id", *_identity()))


@query(f"SELECT id, work_id FROM ({_MEMBERS})")
def same_work_members(spark, d):
    return works.members(_records(spark, d), "id", *_identity())


@query(f"""
SELECT work_id, count(*) AS n, arg_min(title, id) AS title, string_agg(DISTINCT title, '; ' ORDER BY title) AS variants, min(year) AS year, string_agg(DISTINCT year, ',' ORDER BY year) AS years,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(authors, '; '))), lambda a: a <> ''))), '; '), '') AS authors, max(citations) AS citations, arg_max(abstract, (length(abstract), -id)) AS abstract,
  string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, coalesce(string_agg(DISTINCT doi, ',' ORDER BY doi), '') AS dois,
  string_agg(DISTINCT concat_ws('|', provider, title, year, coalesce(doi, '')), '; ' ORDER BY concat_ws('|', provider, title, year, coalesce(doi, ''))) AS appearances
FROM ({_MEMBERS}) GROUP BY work_id""")
def merged_works(spark, d):
    rows = _records(spark, d)
    out = works.merged(rows, works.members(rows, "id", *_identity()), "id")
    joined = {c: F.array_join(F.filter(c, lambda x: x.cast("string") != ""), s) for c, s in (("variants", "; "), ("years", ","), ("authors", "; "), ("providers", ","), ("dois", ","), ("appearances", "; "))}
    return out.withColumns(joined)


_CREATORS = """
SELECT c_custkey AS id, concat('Person ', CAST(c_custkey % 40 AS STRING), CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' Junior' WHEN 2 THEN ' and Others' WHEN 3 THEN 'x' ELSE ' Coord' END) AS name, CASE WHEN c_custkey % 6 = 0 THEN concat('0000-', CAST(c_custkey % 50 AS STRING)) END AS orcid FROM customer"""
_PERSONS = "SELECT n_nationkey AS person, concat('person ', CAST(n_nationkey AS STRING)) AS name, concat('0000-', CAST(n_nationkey AS STRING)) AS orcid FROM nation"


@query(f"""
WITH c AS (SELECT *, {sql_fold('name')} AS f FROM ({_CREATORS})), p AS ({_PERSONS}), m AS (
  SELECT c.id, p.person, CASE WHEN c.orcid = p.orcid THEN 4 WHEN c.orcid IS NOT NULL AND c.orcid <> p.orcid THEN NULL WHEN f = p.name THEN 3 WHEN starts_with(f, p.name || ' ') THEN CASE WHEN regexp_matches(f, '\\b(and|et al|coord|coords|eds)\\b') THEN 1 ELSE 2 END END AS score FROM c, p)
SELECT id, person, CAST(score AS INT) AS score, CASE score WHEN 4 THEN 'orcid' WHEN 3 THEN 'exact-name' WHEN 2 THEN 'name-variant' ELSE 'collective-creator' END AS evidence FROM m WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, person) = 1""")
def federated_author_match(spark, d):
    return works.best_match(relation(spark, d, _CREATORS), relation(spark, d, _PERSONS), "id", C("name"), C("orcid"))


_IDENTITY = "SELECT c_mktsegment AS name, c_custkey % 97 AS bucket, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey % 3 AS STRING) END AS orcid, c_custkey AS id FROM customer"



@query(f"""
SELECT name, bucket, count(*) AS n, CASE WHEN count(*) = 1 THEN 'resolved' WHEN count(DISTINCT orcid) = 1 AND count(orcid) = count(*) THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(*) > 1 AND count(DISTINCT orcid) = 1 AND count(orcid) = count(*) THEN 'orcid' END AS joined_by, min(id) AS candidate FROM ({_IDENTITY}) GROUP BY ALL""")
def identity_lookup(spark, d):
    """Candidates of a name are one person only if there is one, or if all carry the same ORCID."""
    agreed = (F.countDistinct("orcid") == 1) & (F.count("orcid") == F.count("*"))
    status = F.when((F.count("*") == 1) | agreed, "resolved").otherwise("ambiguous")
    return relation(spark, d, _IDENTITY).groupBy("name", "bucket").agg(F.count("*").alias("n"), status.alias("status"), F.when((F.count("*") > 1) & agreed, "orcid").alias("joined_by"), F.min("id").alias("candidate"))


@query(f"""
SELECT stratum, count(*) AS names, CAST(sum(n) AS BIGINT) AS records FROM (SELECT name, bucket, count(*) AS n, CASE WHEN count(*) = 1 THEN 'unique' WHEN bool_and(orcid IS NOT NULL) THEN 'all-identified' WHEN bool_or(orcid IS NOT NULL) THEN 'some-identified' ELSE 'unidentified' END AS stratum FROM ({_IDENTITY}) GROUP BY ALL) GROUP BY stratum""")
def name_collision_strata(spark, d):
    has = C("orcid").isNotNull()
    stratum = F.when(F.count("*") == 1, "unique").when(F.bool_and(has), "all-identified").when(F.bool_or(has), "some-identified").otherwise("unidentified")
    per = relation(spark, d, _IDENTITY).groupBy("name", "bucket").agg(F.count("*").alias("n"), stratum.alias("stratum"))
    return per.groupBy("stratum").agg(F.count("*").alias("names"), F.sum("n").alias("records"))


_AUTHORITY = "SELECT DISTINCT l_orderkey AS work, l_suppkey AS authority FROM lineitem"
_YEARS = "SELECT o_orderkey AS work, CAST(year(o_orderdate) AS INT) AS y FROM orders"


@query(f"""
WITH s AS ({_AUTHORITY}), y AS ({_YEARS}), p AS (SELECT a.work, b.work AS other, count(*) AS shared FROM s a JOIN s b ON a.authority = b.authority AND a.work <> b.work WHERE a.work % 20 = 0 GROUP BY ALL)
SELECT p.work, p.other, p.shared, CAST(row_number() OVER (PARTITION BY p.work ORDER BY shared DESC, abs(l.y - r.y), p.other) AS INT) AS place FROM p JOIN y l ON l.work = p.work JOIN y r ON r.work = p.other QUALIFY place <= 24""")
def authority_candidates(spark, d):
    """For each twentieth work, the 24 that share most authorities; then nearest in years, then by id."""
    return works.most_shared(relation(spark, d, _AUTHORITY), relation(spark, d, _YEARS), C("work") % 20 == 0, 24)


#: Saved works of forty people, by several authors, with tags.
_SAVED = f"SELECT id % 40 AS project, id, title, authors, concat(provider, '; ', CASE id % 3 WHEN 0 THEN 'read; ' WHEN 1 THEN 'later; ' ELSE '' END, 'y', CAST(year % 4 AS STRING)) AS tags FROM ({RECORDS})"


@query(f"""
WITH s AS (SELECT project, id, list_distinct(list_filter(string_split({sql_fold("title")}, ' '), lambda t: t <> '')) AS w, list_distinct(list_filter(string_split(lower(authors), '; '), lambda t: t <> '')) AS x, list_distinct(string_split(tags, '; ')) AS t FROM ({_SAVED})),
p AS (SELECT l.project, l.id AS a, r.id AS b, round(CAST(least(1.0, CASE WHEN len(list_intersect(l.w, r.w)) > 0 THEN len(list_intersect(l.w, r.w)) / len(list_distinct(list_concat(l.w, r.w))) ELSE 0 END
  + CASE WHEN list_has_any(l.x, r.x) THEN 0.34 ELSE 0.0 END + least(0.24, len(list_intersect(l.t, r.t)) * 0.08)) AS DOUBLE), 6) AS similarity FROM s l JOIN s r ON l.project = r.project AND l.id < r.id)
SELECT project, a, b, similarity FROM p WHERE similarity >= 0.12 QUALIFY row_number() OVER (PARTITION BY project, a ORDER BY similarity DESC, b) <= 4""")
def saved_work_similarity(spark, d):
    """The four works most alike each saved work, among those saved later in the same project, by any author."""
    s = relation(spark, d, _SAVED)
    words = lambda x: F.filter(x, lambda t: t != "")
    saved = s.select("project", "id", words(text.tokens(C("title"))).alias("words"), words(F.split(F.lower("authors"), "; ")).alias("authors"), F.split("tags", "; ").alias("tags"))
    return saved_works.saved_similarity(saved, "project", "id")


@query(f"""
SELECT id, CASE WHEN f = v THEN 100 WHEN length(f) > 5 AND (contains(f, v) OR contains(v, f)) THEN 90 WHEN list_contains(t, split_part(v, ' ', 2)) AND len(list_intersect(t, string_split(v, ' '))) >= 2 THEN 78 ELSE 0 END AS score FROM (SELECT id, f, 'person ' || CAST(id % 7 AS VARCHAR) AS v, string_split(f, ' ') AS t FROM (SELECT id, {sql_fold("name")} AS f FROM ({_CREATORS})))""")
def author_match_score(spark, d):
    rows = relation(spark, d, _CREATORS).select("id", text.fold(C("name")).alias("f"), F.concat(F.lit("person "), (C("id") % 7).cast("string")).alias("v"))
    t, v = F.split("f", " "), F.split("v", " ")
    surname = F.array_contains(t, F.element_at(v, -1)) & (F.size(F.array_intersect(t, v)) >= 2)
    score = F.when(C("f") == C("v"), 100).when((F.length("f") > 5) & (C("f").contains(C("v")) | C("v").contains(C("f"))), 90).when(surname, 78).otherwise(0)
    return rows.select("id", score.alias("score"))


@query(f"""
SELECT id, CASE WHEN len(list_intersect(['author', 'brand', '1'], u)) = 3 THEN CASE WHEN len(u) = 3 THEN 3 ELSE 2 END ELSE 0 END AS tier FROM (SELECT id, list_distinct(string_split({sql_fold("author")}, ' ')) AS u FROM ({WORKS}))""")
def author_match_tier(spark, d):
    return relation(spark, d, WORKS).select("id", ranking.author_tier(text.token_set(C("author")), "author brand 1").alias("tier"))


@query(f"""
WITH k AS (SELECT id, name, orcid, coalesce('orcid:' || orcid, 'name:' || {sql_fold("name")}) AS key FROM ({_CREATORS}))
SELECT key, count(*) AS n, min(id) AS first_id, string_agg(DISTINCT name, '; ' ORDER BY name) AS names FROM k GROUP BY key""")
def saved_author_merge(spark, d):
    key = F.coalesce(F.concat(F.lit("orcid:"), "orcid"), F.concat(F.lit("name:"), text.fold(C("name"))))
    return relation(spark, d, _CREATORS).groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))


@query(f"""
WITH t AS (SELECT {_COMPARABLE} AS ct, author, id FROM ({WORKS})), named AS (SELECT DISTINCT ct, split_part(author, ' ', 2) AS surname FROM t WHERE id % 2 = 0)
SELECT t.id, count(*) AS corroborated FROM t JOIN named n ON t.ct = n.ct AND n.surname = split_part(t.author, ' ', 2) WHERE t.id % 2 = 1 GROUP BY t.id""")
def surname_corroboration(spark, d):
    """Records of one source whose surname is confirmed by an equal title in the other."""
    t = relation(spark, d, WORKS).select("id", works.comparable(C("title")).alias("ct"), F.element_at(F.split("author", " "), 2).alias("surname"))
    named = t.filter("id % 2 = 0").select("ct", "surname").distinct()
    return t.filter("id % 2 = 1").join(named, ["ct", "surname"]).groupBy("id").agg(F.count("*").alias("corroborated"))
