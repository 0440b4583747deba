"""Research graph queries: catalogues, archives, identities, contributions, snapshots, institutional indexes, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.functions import text
from lexmill.operators import atlas, folds, projection
from lexmill.operators import vectors as V
from lexmill.operators.merge import cut_lineage
from lexmill.plans.corpus import _sql_kept
from lexmill.plans.inputs import WORKS, dealt, registry, relation
from lexmill.plans.vectors import _SQL_UNIT, _base
from lexmill.session import table

QUERIES, ORACLE, query = registry()
C = F.col


def _sql_plain(x: str) -> str:
    return _sql_kept(x, "a-z0-9")


_CATALOGUE = f"""
SELECT 'main' AS source, id - CASE WHEN id % 22 = 0 THEN 11 ELSE 0 END AS ref, title, year AS issue, CASE WHEN id % 3 > 0 THEN author END AS author FROM ({WORKS}) WHERE id % 5 > 0
UNION ALL SELECT 'other', id, title, year, CASE WHEN id % 7 = 0 THEN 'Somebody Else' ELSE author END FROM ({WORKS}) WHERE id % 4 > 0
UNION ALL SELECT 'other', id, title, year, author FROM ({WORKS}) WHERE id % 44 = 1"""


@query(f"""
WITH c AS MATERIALIZED (SELECT *, {_sql_plain('title')} AS key FROM ({_CATALOGUE})), m AS (SELECT r.id, c.* FROM (SELECT id, {_sql_plain('title')} AS rk, year FROM ({WORKS})) r JOIN c ON r.rk = c.key AND r.year = c.issue WHERE length(c.key) >= 14),
s AS (SELECT id, count(*) > count(DISTINCT source || ref) AS repeated, count(DISTINCT author) AS authors, count(DISTINCT ref) FILTER (source = 'main') AS main, arg_min(ref, (source <> 'main', author IS NULL, source, ref)) AS ref FROM m GROUP BY id)
SELECT w.id, status, CASE WHEN status = 'verified' THEN ref END AS ref FROM (SELECT w.id, s.ref, CASE WHEN s.id IS NULL THEN 'no verified match' WHEN repeated THEN 'repeated identity' WHEN authors > 1 THEN 'conflicting authors' WHEN main > 1 THEN 'ambiguous' ELSE 'verified' END AS status FROM ({WORKS}) w LEFT JOIN s ON s.id = w.id) w""")
def catalogue_match(spark, d):
    key = text.fold_plain(C("title")).alias("key")
    records = relation(spark, d, WORKS).select("id", key, C("year").alias("issue"))
    return atlas.catalogue_match(records, relation(spark, d, _CATALOGUE).select("source", "ref", key, "issue", "author"), "id", "main")


_ARCHIVE = f"SELECT id, CASE WHEN id % 8 < 2 THEN concat('Work ', topic, ' ', CAST(id % 16 AS STRING), ' ', author) ELSE title END AS title, year, CASE WHEN doi IS NOT NULL AND id % 40 < 20 THEN concat(doi, '/', CAST(id % 7 AS STRING)) END AS doi, CASE WHEN id % 3 > 0 THEN abstract END AS abstract, id % 10 = 0 AS curated, provider FROM ({WORKS})"
_ARCHIVE_MEMBERS = f"""
WITH RECURSIVE r AS MATERIALIZED (SELECT *, {_sql_plain('title')} AS t FROM ({_ARCHIVE})), k AS (SELECT id, 'd' || doi AS k FROM r WHERE doi IS NOT NULL UNION ALL SELECT id, 't' || t || ':' || year FROM r WHERE t <> '' UNION ALL SELECT id, 'a' || t FROM r WHERE t <> '' AND t IN (SELECT t FROM r WHERE curated)),
e AS MATERIALIZED (SELECT id AS a, min(id) OVER (PARTITION BY k) AS b FROM k), w AS MATERIALIZED (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), reach(x, y) AS (SELECT a, b FROM w UNION SELECT r.x, w.b FROM reach r JOIN w ON r.y = w.a),
root AS (SELECT x AS id, least(x, min(y)) AS root FROM reach GROUP BY x), m AS (SELECT r.*, coalesce(root.root, r.id) AS work FROM r LEFT JOIN root ON root.id = r.id)"""


@query(f"""{_ARCHIVE_MEMBERS}
SELECT work, count(*) AS records, arg_min(id, (NOT curated, doi IS NULL, abstract IS NULL, id)) AS main, arg_min(title, (NOT curated, doi IS NULL, abstract IS NULL, id)) AS title, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers, count(DISTINCT title) AS titles FROM m GROUP BY work""")
def archive_merge(spark, d):
    """Archives of a person's works as one: a curated row leads, then one with DOI, then one with abstract."""
    rows = relation(spark, d, _ARCHIVE)
    folded = text.fold_plain(C("title"))
    named = F.when(folded != "", folded)
    found = atlas.archive_merge(rows, "id", [C("doi"), F.concat(named, F.lit(":"), C("year").cast("string"))], named, C("curated"))
    lead = F.struct(~C("curated"), C("doi").isNull(), C("abstract").isNull(), "id")
    return rows.join(found, "id").groupBy(C("root").alias("work")).agg(F.count("*").alias("records"), F.min_by("id", lead).alias("main"), F.min_by("title", lead).alias("title"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), F.countDistinct("title").alias("titles"))


@query()
def archive_fold(spark, d):
    """The same archives folded per person in the order of ids: a record between two works joins one. Tested against loops."""
    rows = relation(spark, d, _ARCHIVE.replace(", provider FROM", ", provider, author FROM"))
    has = lambda c: C(c).isNotNull().alias(c)
    return folds.archive_fold(rows.select("id", C("doi").alias("key"), text.fold_plain(C("title")).alias("title"), "year", "curated", has("doi"), has("abstract"), "author"), C("author"), "id", [C("id")])


@query(f"SELECT id, title FROM ({WORKS}) WHERE contains({_sql_plain('title')}, 'ring') AND upper(left({_sql_plain('title')}, 1)) = 'S'")
def author_work_filter(spark, d):
    """A person's works by a part of the title and an initial."""
    folded = text.fold_plain(C("title"))
    return relation(spark, d, WORKS).filter(folded.contains("ring") & (F.upper(F.substring(folded, 1, 1)) == "S")).select("id", "title")


_THESES = f"SELECT id, title, CASE WHEN id % 6 > 0 THEN year END AS y FROM ({WORKS})"


@query(f"""
WITH s AS ({_THESES}) SELECT sort, place, id FROM (SELECT 'title' AS sort, row_number() OVER (ORDER BY title, id) AS place, id FROM s UNION ALL SELECT 'oldest', row_number() OVER (ORDER BY coalesce(y, 9999), title, id), id FROM s UNION ALL SELECT 'newest', row_number() OVER (ORDER BY coalesce(y, 0) DESC, title, id), id FROM s) WHERE place <= 25""")
def thesis_sorts(spark, d):
    """The first page of each of three orders: a top-k each, no global sort; places are numbered among 25 rows."""
    s, out = relation(spark, d, _THESES), None
    for name, first in {"title": [], "oldest": [F.coalesce("y", F.lit(9999)).asc()], "newest": [F.coalesce("y", F.lit(0)).desc()]}.items():
        order = [*first, F.asc("title"), F.asc("id")]
        page = s.orderBy(*order).limit(25).select(F.lit(name).alias("sort"), F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).cast("long").alias("place"), "id")
        out = page if out is None else out.unionByName(page)
    return out


_RAW = "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_discount AS DOUBLE) * 14 - 0.2 END AS raw FROM lineitem"


@query(f"""
SELECT id, line, score, CAST(floor(score * 100 + 0.5) AS BIGINT) AS percent, CASE WHEN score >= 0.8 THEN 'strong' ELSE 'supporting' END AS strength FROM (SELECT id, line, CASE WHEN raw IS NULL THEN 0.0 ELSE round(greatest(0.0, least(1.0, raw)), 6) END AS score FROM ({_RAW}))""")
def semantic_strength(spark, d):
    """Scores held in 0 to 1 (0 where there is none), as percentages and as words."""
    score = F.when(C("raw").isNull() | F.isnan("raw"), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), C("raw"))), 6))
    rows = relation(spark, d, _RAW).select("id", "line", score.alias("score"))
    return rows.select("*", F.floor(C("score") * 100 + 0.5).cast("long").alias("percent"), F.when(C("score") >= 0.8, "strong").otherwise("supporting").alias("strength"))


@query("""
SELECT l_orderkey AS node, l_linenumber AS place, p_partkey AS target, CAST(l_discount AS DOUBLE) AS similarity FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 10 WHERE l_linenumber <> 3""")
def neighbour_entries(spark, d):
    """Nodes hold their neighbours' keys and similarities in two arrays; entries without a node or a number go."""
    line = F.array_sort(F.collect_list(F.struct(C("l_linenumber").alias("n"), C("l_partkey").alias("ref"), F.when(C("l_linenumber") != 3, C("l_discount").cast("double")).alias("value"))))
    nodes = table(spark, d, "lineitem").groupBy(C("l_orderkey").alias("node")).agg(line.alias("l")).select("node", C("l.n").alias("n"), C("l.ref").alias("refs"), C("l.value").alias("values"))
    entries = nodes.select("node", F.inline(F.arrays_zip("n", "refs", "values"))).filter("values is not null")
    known = table(spark, d, "part").filter("p_size > 10").select(C("p_partkey").alias("target"))
    return entries.join(known, C("refs") == C("target")).select("node", C("n").alias("place"), "target", C("values").alias("similarity"))


_PEOPLE = "SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE concat('person ', CAST(c_custkey % 97 AS STRING)) END AS name, CASE WHEN c_custkey % 6 = 0 THEN concat('0000-', CAST(c_custkey % 210 AS STRING)) END AS anchor, c_nationkey % 3 AS context FROM customer"


@query(f"""
WITH p AS ({_PEOPLE}), c AS (SELECT name, anchor, context, min(id) AS id FROM p WHERE name <> '' GROUP BY ALL), h AS (SELECT *, first_value(struct_pack(id := id, anchor := anchor, context := context)) OVER (PARTITION BY name ORDER BY id) AS head FROM c)
SELECT 'anchor' AS kind, m AS a, id AS b, 'confirmed' AS status FROM (SELECT id, min(id) OVER (PARTITION BY anchor) AS m FROM p WHERE anchor IS NOT NULL) WHERE id <> m
UNION ALL SELECT 'name', head.id, id, CASE WHEN anchor = head.anchor THEN 'confirmed' WHEN anchor <> head.anchor THEN 'rejected' WHEN context = head.context THEN 'probable' ELSE 'unresolved' END FROM h WHERE id <> head.id""")
def authority_merges(spark, d):
    return atlas.authority_merges(relation(spark, d, _PEOPLE))


_SEEN = "SELECT concat('person ', CAST(o_custkey % 53 AS STRING)) AS name, CASE WHEN o_custkey % 4 = 0 THEN concat('0000-', CAST(o_custkey % 53 % 50 AS STRING)) WHEN o_custkey % 371 = 1 THEN '0000-x' END AS anchor, o_orderkey AS work, o_orderpriority AS provider FROM orders"


@query(f"""
WITH o AS ({_SEEN}), n AS (SELECT name, min(anchor) AS lo, max(anchor) AS hi FROM o GROUP BY name)
SELECT authority, array_to_string(list_sort(list(DISTINCT name)), ';') AS names, count(DISTINCT work) AS works, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers, bool_or(coalesce(lo < hi, FALSE)) AS conflict FROM (SELECT o.*, lo, hi, coalesce(anchor, CASE WHEN lo = hi THEN lo END, 'name:' || name) AS authority FROM o JOIN n USING (name)) GROUP BY authority""")
def identity_graph(spark, d):
    return atlas.identity_graph(relation(spark, d, _SEEN))


_MENTIONS = "SELECT concat('person ', CAST(l_suppkey % 97 AS STRING)) AS name, l_orderkey % 400 AS work, l_linenumber AS ref FROM lineitem"
_AUTHORITIES = "SELECT s_suppkey AS id, concat('person ', CAST(s_suppkey % 80 AS STRING)) AS name FROM supplier"
_CONTRIBUTIONS = f"SELECT authority, work, count(DISTINCT ref) AS evidence FROM ({_MENTIONS}) m JOIN (SELECT name, min(id) AS authority FROM ({_AUTHORITIES}) GROUP BY name HAVING count(*) = 1) p ON m.name = p.name GROUP BY authority, work"


@query(f"SELECT authority, work, 'edge:contribution:' || left(sha256(authority || '|' || work), 20) AS edge_id, evidence FROM ({_CONTRIBUTIONS})")
def authority_contributions(spark, d):
    return atlas.contributions(relation(spark, d, _MENTIONS), relation(spark, d, _AUTHORITIES))


@query(f"SELECT authority, count(*) AS works, CAST(sum(evidence) AS BIGINT) AS evidence, CAST(sum(people - 1) AS BIGINT) AS coauthorships, max(people) - 1 AS most FROM (SELECT *, count(*) OVER (PARTITION BY work) AS people FROM ({_CONTRIBUTIONS})) GROUP BY authority")
def authority_enrichment(spark, d):
    """Works and co-authorships of each authority, counted per work instead of listed as pairs."""
    edges = atlas.contributions(relation(spark, d, _MENTIONS), relation(spark, d, _AUTHORITIES))
    people = edges.groupBy("work").agg(F.count("*").alias("people"))
    return edges.join(people, "work").groupBy("authority").agg(F.count("*").alias("works"), F.sum("evidence").alias("evidence"), F.sum(C("people") - 1).alias("coauthorships"), (F.max("people") - 1).alias("most"))


_GRAPH_WORKS = f"SELECT CASE WHEN doi IS NULL THEN concat('id:', CAST(id AS STRING)) ELSE concat('doi:', doi) END AS key, title FROM ({WORKS})"
_GRAPH_HITS = "SELECT concat('q', CAST(l_orderkey % 25 AS STRING)) AS query, CASE WHEN l_partkey % 5 = 0 THEN concat('doi:10.1234/', CAST(l_partkey % 50 AS STRING)) ELSE concat('id:', CAST(l_partkey AS STRING)) END AS key, CAST(l_discount AS DOUBLE) AS score, l_returnflag AS provider FROM lineitem WHERE l_linenumber = 1"
_GRAPH = f"""
WITH n AS MATERIALIZED (SELECT key, min(title) AS title, count(*) AS records, 'work:' || left(sha256(key), 20) AS node_id FROM ({_GRAPH_WORKS}) GROUP BY key),
e AS MATERIALIZED (SELECT *, 'edge:query:' || left(sha256(query || '|' || node_id), 20) AS edge_id FROM (SELECT query, node_id, max(score) AS score, count(DISTINCT provider) AS evidence FROM ({_GRAPH_HITS}) h JOIN n USING (key) GROUP BY query, node_id))"""


@query(f"{_GRAPH} SELECT edge_id, query, n.node_id, title, records, score, evidence FROM e JOIN n ON n.node_id = e.node_id")
def graph_edges(spark, d):
    nodes, edges, _ = atlas.snapshot(relation(spark, d, _GRAPH_WORKS), relation(spark, d, _GRAPH_HITS))
    return edges.join(nodes.drop("key"), "node_id")


@query(f"""{_GRAPH}
SELECT nodes, records, edges, evidence, reached, xor(x, y) AS signature FROM (SELECT count(*) AS nodes, CAST(sum(records) AS BIGINT) AS records, bit_xor(CAST('0x' || left(sha256(node_id), 12) AS BIGINT)) AS x FROM n), (SELECT count(*) AS edges, CAST(sum(evidence) AS BIGINT) AS evidence, count(DISTINCT node_id) AS reached, bit_xor(CAST('0x' || left(sha256(edge_id), 12) AS BIGINT)) AS y FROM e)""")
def graph_diagnostics(spark, d):
    return atlas.snapshot(relation(spark, d, _GRAPH_WORKS), relation(spark, d, _GRAPH_HITS))[2]


_RECORDS = f"SELECT id, title, author, year, provider, topic, CASE WHEN id % 4 = 0 THEN concat('20.500/', CAST(id % 60 AS STRING)) END AS handle, CASE id % 5 WHEN 0 THEN 'exclude' WHEN 1 THEN 'review' ELSE 'include' END AS verdict FROM ({WORKS})"
_PRIORITY = {"registry": 0, "archive": 1, "journals": 2}
_SQL_PRIORITY = "CASE provider " + " ".join(f"WHEN '{p}' THEN {n}" for p, n in _PRIORITY.items()) + " ELSE 9 END"
_CANONICAL = f"""
SELECT identity, arg_min(id, (p, id)) AS id, arg_min(title, (p, id)) AS title, min(year) AS year, arg_min(provider, (p, id)) AS provider, count(*) AS sources, array_to_string(list_sort(list(DISTINCT author)), ';') AS authors, CASE WHEN bool_or(verdict = 'include') THEN 'include' WHEN bool_and(verdict = 'exclude') THEN 'exclude' ELSE 'review' END AS status FROM (SELECT *, {_SQL_PRIORITY} AS p, coalesce('handle:' || handle, 'source:' || id) AS identity FROM ({_RECORDS})) GROUP BY identity"""


def _canonical(spark, d):
    place = F.coalesce(F.create_map(*[F.lit(x) for kv in _PRIORITY.items() for x in kv])[C("provider")], F.lit(9))
    identity = F.coalesce(F.concat(F.lit("handle:"), "handle"), F.concat(F.lit("source:"), C("id").cast("string")))
    first = lambda c: F.min_by(c, F.struct("p", "id")).alias(c)
    status = F.when(F.bool_or(C("verdict") == "include"), "include").when(F.bool_and(C("verdict") == "exclude"), "exclude").otherwise("review")
    rows = relation(spark, d, _RECORDS).withColumn("p", place).withColumn("identity", identity)
    return rows.groupBy("identity").agg(first("id"), first("title"), F.min("year").alias("year"), first("provider"), F.count("*").alias("sources"), F.array_join(F.array_sort(F.collect_set("author")), ";").alias("authors"), status.alias("status"))


@query(_CANONICAL)
def canonical_corpus(spark, d):
    """Records grouped by persistent handle, else by source: the first provider leads, authors are gathered."""
    return _canonical(spark, d)


_EVIDENCE = "SELECT l_partkey AS id, CASE WHEN l_linenumber % 4 = 0 THEN 'javascript:x' WHEN l_linenumber % 4 = 1 THEN NULL ELSE concat('https://site', CAST(l_suppkey % 5 AS STRING), '.example/') END AS url, lower(l_returnflag) AS kind FROM lineitem"


@query(f"""
WITH c AS ({_CANONICAL}), e AS (SELECT id, array_to_string(list_sort(coalesce(list(DISTINCT url) FILTER (regexp_matches(url, '^https?://')), [])), ' ') AS urls, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM ({_EVIDENCE}) GROUP BY id)
SELECT 'reference:' || left(sha256(provider || '|' || c.id), 20) AS public_id, title, year, status, urls, kinds FROM c LEFT JOIN e ON e.id = c.id AND status = 'review' WHERE status <> 'exclude'""")
def public_index(spark, d):
    """What may be shown: admitted records, and those under review with what corroborates them (web addresses only)."""
    safe = F.array_sort(F.collect_set(F.when(C("url").rlike("^https?://"), C("url"))))
    evidence = relation(spark, d, _EVIDENCE).groupBy("id").agg(F.array_join(safe, " ").alias("urls"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    shown = _canonical(spark, d).filter("status <> 'exclude'")
    joined = shown.join(evidence.withColumn("status", F.lit("review")), ["id", "status"], "left")
    return joined.select(atlas.stable_id("reference:", C("provider"), C("id")).alias("public_id"), "title", "year", "status", "urls", "kinds")


_EXPECTED = "SELECT lower(p_type) AS topic, CAST(5 + max(p_size) % 30 AS BIGINT) AS expected FROM part WHERE p_size % 7 > 0 GROUP BY lower(p_type)"


@query(f"""
SELECT topic, expected, coalesce(observed, 0) AS observed, round(coalesce(observed, 0) / expected, 6) AS coverage, CASE WHEN expected IS NULL THEN 'unlisted' WHEN observed IS NULL THEN 'absent' WHEN observed >= expected THEN 'complete' WHEN 2 * observed >= expected THEN 'partial' ELSE 'thin' END AS state FROM (SELECT * FROM ({_EXPECTED})) FULL JOIN (SELECT topic, count(*) AS observed FROM ({WORKS}) WHERE provider = 'archive' GROUP BY topic) USING (topic)""")
def coverage_ledger(spark, d):
    """Works seen of each listed programme against those expected."""
    seen = relation(spark, d, WORKS).filter("provider = 'archive'").groupBy("topic").agg(F.count("*").alias("o"))
    both = relation(spark, d, _EXPECTED).join(seen, "topic", "full_outer").withColumn("observed", F.coalesce("o", F.lit(0)))
    state = F.when(C("expected").isNull(), "unlisted").when(C("o").isNull(), "absent").when(C("o") >= C("expected"), "complete").when(2 * C("o") >= C("expected"), "partial").otherwise("thin")
    return both.select("topic", "expected", "observed", F.round(C("observed") / C("expected"), 6).alias("coverage"), state.alias("state"))


@query(f"""
SELECT topic, count(*) FILTER (verdict = 'include') AS include, count(*) FILTER (verdict = 'review') AS review, count(*) FILTER (verdict = 'exclude') AS exclude, count(*) AS total, count(*) FILTER (verdict = 'review') = 0 AS closed FROM ({_RECORDS}) GROUP BY topic""")
def scope_matrix(spark, d):
    """Verdicts per programme, and whether none is open."""
    wide = relation(spark, d, _RECORDS).groupBy("topic").pivot("verdict", ["include", "review", "exclude"]).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumn("total", C("include") + C("review") + C("exclude")).withColumn("closed", C("review") == 0)


_FIELDS = {"title": 4.2, "topic": 3.1, "author": 1.8, "abstract": 1.0}


@query(f"""
WITH w AS MATERIALIZED (SELECT * FROM ({WORKS})), t AS (SELECT id, token, sum(weight) AS w FROM ({' UNION ALL '.join(f"SELECT id, unnest(string_split({_sql_plain(f)}, ' ')) AS token, CAST({x} AS DOUBLE) AS weight FROM w" for f, x in _FIELDS.items())}) WHERE token <> '' GROUP BY id, token),
v AS (SELECT id, token, (1 + ln(greatest(w, 1e-9))) * (ln(((SELECT count(*) FROM w) + 1) / (count(*) OVER (PARTITION BY token) + 1)) + 1) AS raw FROM t)
SELECT id, token, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)), 6) AS value FROM v""")
def weighted_vectors(spark, d):
    rows = relation(spark, d, WORKS).select("id", *[F.split(text.fold_plain(C(f)), " ").alias(f) for f in _FIELDS])
    return atlas.weighted_vectors(rows, "id", _FIELDS).select("id", "token", F.round("value", 6).alias("value"))


_STEMS = {"econom": "economy", "promo": "promotion", "ring": "jewellery", "bolt": "fastener", "context": "context"}


@query(f"""
SELECT id, array_to_string(list_sort(list_distinct(list_filter([{', '.join(f"CASE WHEN contains(title, '{s}') AND NOT contains(topic, '{s}') AND NOT contains(topic, '{x}') THEN '{x}' END" for s, x in _STEMS.items())}], lambda x: x IS NOT NULL))), ',') AS labels FROM ({WORKS})""")
def stem_labels(spark, d):
    return relation(spark, d, WORKS).select("id", F.array_join(text.stem_labels(C("title"), C("topic"), _STEMS), ",").alias("labels"))


_TITLES = f"SELECT id, CASE id % 20 WHEN 0 THEN 'Introducción' WHEN 1 THEN ' Reseña.' WHEN 2 THEN concat('The ', title) ELSE title END AS title FROM ({WORKS})"


@query(f"""
SELECT id, {_sql_plain('title')} IN ({', '.join(f"'{x}'" for x in text.GENERIC_TITLES)}) AS generic, array_to_string(list_filter(w, lambda t, i: list_position(w, t) = i), ' ') AS words FROM (SELECT id, title, list_filter(string_split({_sql_plain('title')}, ' '), lambda t: t <> '' AND t NOT IN ({', '.join(f"'{x}'" for x in text.TITLE_STOPWORDS)})) AS w FROM ({_TITLES}))""")
def generic_titles(spark, d):
    return relation(spark, d, _TITLES).select("id", text.is_generic_title(C("title")).alias("generic"), F.array_join(text.title_words(C("title")), " ").alias("words"))


_ASKED = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat('plato and ', lower(c_mktsegment)) WHEN 1 THEN concat('Hannah Arendt y Plato & ', lower(c_mktsegment)) ELSE concat('about ', lower(c_mktsegment)) END AS q FROM customer"


@query(f"""
SELECT id, array_to_string(list_transform(s, lambda x: x || '=' || CASE WHEN x = 'plato' OR x = 'Plato' THEN 'Plato' WHEN x = 'Hannah Arendt' THEN 'Hannah Arendt' ELSE '' END), ';') AS people FROM (SELECT id, regexp_split_to_array(q, '\\s+(?:y|e|and|et|und|&)\\s+') AS s FROM ({_ASKED})) WHERE len(s) > 1""")
def people_queries(spark, d):
    """Queries for several persons, parted, with the known names that they mean."""
    asked = relation(spark, d, _ASKED).select("id", text.split_people(C("q"), ["Plato", "Hannah Arendt"]).alias("p")).filter(F.size("p") > 1)
    return asked.select("id", F.array_join(F.transform("p", lambda x: F.concat(x["input"], F.lit("="), F.coalesce(x["canonical"], F.lit("")))), ";").alias("people"))


@query("""
SELECT quality, count(*) AS n, round(avg(CASE WHEN h = s THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN abs(h - s) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_one FROM (SELECT quality, doc_id % 4 AS h, doc_id * 7 % 11 % 4 AS s FROM labels) GROUP BY quality""")
def graded_agreement(spark, d):
    """Two graders of 0 to 3: equal grades, and grades at most one apart."""
    rows = table(spark, d, "labels").select("quality", (C("doc_id") % 4).alias("h"), (C("doc_id") * 7 % 11 % 4).alias("s"))
    share = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 6)
    return rows.groupBy("quality").agg(F.count("*").alias("n"), share(C("h") == C("s")).alias("exact"), share(F.abs(C("h") - C("s")) <= 1).alias("within_one"))


@query(f"""
WITH u AS MATERIALIZED ({_SQL_UNIT}), k AS (SELECT q.id AS seed, b.id AS id, list_dot_product(q.v, b.v) AS score FROM u q JOIN u b ON q.id <> b.id WHERE q.id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, b.v), 9) DESC, b.id) <= 48),
m AS (SELECT seed, id // 3 * 3 AS target, max(score) AS score FROM k WHERE seed // 3 <> id // 3 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, target) AS rank FROM m)
SELECT seed, target, round(score, 6) AS score, rank FROM r WHERE rank <= 24""")
def related_representatives(spark, d):
    """Neighbours as representatives of their identities (here runs of three ids), the seed's own left out."""
    base = _base(spark, d)
    found = V.neighbours(base.filter("id % 20 = 0").select(C("id").alias("query_id"), C("v").alias("q")), base, 48)
    identity = base.select("id", F.expr("id div 3").alias("identity"))
    return atlas.remapped(found, identity, 24).select("seed", "target", F.round("score", 6).alias("score"), C("rank").cast("long").alias("rank"))


@query()
def text_map(spark, d):
    """Groups and a map of works by their words: cluster, label, how alike a work's eight nearest are in topic, how true its place is.

    Every twentieth work is asked for; groups, directions and labels come from all. Iterative, so without SQL.
    """
    rows = dealt(relation(spark, d, WORKS)).withColumn("body", F.concat_ws(" ", "title", "abstract", "topic"))
    vectors = cut_lineage(projection.term_vectors(rows, "id", "body"))
    packed = cut_lineage(projection.pack(vectors))
    terms = vectors.agg(F.coalesce(F.max("at") + 1, F.lit(0)).alias("n")).first()["n"]
    mapped = cut_lineage(projection.project(packed, projection.directions(packed, terms, 64)))
    groups = V.assign(mapped.select("id", "v"), V.train_centroids(mapped.select("id", "v"), 12)).select("id", "cluster")
    asked = mapped.filter("id % 20 = 0")
    near = cut_lineage(V.neighbours(asked.select(C("id").alias("query_id"), C("v").alias("q")), mapped.select("id", "v"), 8))
    topics = rows.select("id", "topic")
    same = near.join(topics.withColumnsRenamed({"id": "query_id", "topic": "own"}), "query_id").join(topics, "id").groupBy(C("query_id").alias("id")).agg(F.round(F.avg((C("own") == C("topic")).cast("double")), 6).alias("same_topic"))
    kept = projection.preserved(asked, mapped, 8, near).select("id", F.round("kept", 6).alias("kept"))
    return groups.join(same, "id").join(kept, "id").join(projection.labels(vectors, groups), "cluster").select("id", "cluster", "label", "same_topic", "kept")
