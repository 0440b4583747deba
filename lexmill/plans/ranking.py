"""Ranking queries: the parts of the profile, its total with adjustments and floors, local search, label shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import ranking as K
from lexmill.functions import scoring, text
from lexmill.operators import curation
from lexmill.plans.documents import sql_fold
from lexmill.plans.inputs import WORKS, dealt, registry, relation

QUERIES, ORACLE, query = registry()
C = F.col

#: One understood query over the works; every part of the profile has something to find.
Q = K.Understood(
    original="small ring of economy", expansions=(("ring economy in context", 0.95), ("large gear studies", 0.9), ("small ring", 0.98)), persons=(("ring", "rings"), ("gear",)), concepts=(("economy studies", "small economy"), ("promo context",)),
    works=("small ring of economy in context",), related=((("large gear", "gear of promo"), True), (("bolt of standard",), False)), areas=((("economy", "economics"), 0.9), (("promo",), 0.3), (("standard goods",), 0.5)),
    area_terms=(("economy", "promo"),), domain_terms=(("ring", "gear"),),
)

#: The works, some with titles of fourteen words and more; what was asked for, the original first.
_LONG = f"""
SELECT id, concat(title, CASE id % 5 WHEN 0 THEN ' or what the old masters said about the many sides of one matter and its long history until today' WHEN 1 THEN ' and how several readers took it up again after' ELSE '' END) AS title, author, year, doi, provider, citations, abstract, topic
FROM ({WORKS})"""
ASKED = (Q.original, *(x for x, _ in Q.expansions))
_ROWS = f"""
SELECT *, list_distinct(string_split(ft, ' ')) AS t, {sql_fold("abstract")} AS fa, {sql_fold("topic")} AS fp, {sql_fold("author")} AS fu FROM (SELECT *, {sql_fold("title")} AS ft FROM ({_LONG}))"""


def _cov(words: str, t: str = "t") -> str:
    wanted = sorted(set(words.split()))
    return f"(len(list_intersect([{', '.join(map(repr, wanted))}], {t})) / {float(len(wanted))})"


def _has(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def _best() -> tuple[str, str]:
    scores = [f"{_cov(x)} * {w}" for x, w in Q.expansions]
    top = f"greatest({', '.join(scores)})"
    arms = " ".join(f"WHEN {s} = {top} THEN {w}" for s, (_, w) in zip(scores, Q.expansions, strict=True))
    return top, f"CASE WHEN {top} = 0 THEN 0.0 {arms} END"


_SCORE, _WEIGHT = _best()
_CONCEPT = [f"greatest({', '.join(_cov(v) for v in names)})" for names in Q.concepts]
_SQL_Q = f"""least(1.0, greatest(0.0, {_cov(Q.original)} * 0.2 + {_SCORE} * 0.45 + CASE WHEN {' OR '.join(_has('ft', a) for a in Q.persons)} THEN 0.2 ELSE 0.0 END + {' + '.join(f"CASE WHEN {c} >= 0.6 THEN {c} * 0.1 ELSE 0.0 END" for c in _CONCEPT)} + {_WEIGHT} * 0.1))"""
_SQL_P = f"""least(1.0, greatest(0.0, {' + '.join(f"CASE WHEN {_has('ft', a)} THEN 0.3 ELSE 0.0 END" for a in Q.persons)}
  + {' + '.join(f"CASE WHEN {_has('ft', n)} THEN 0.25 WHEN {c} >= 0.6 THEN {c} * 0.25 ELSE 0.0 END" for n, c in zip(Q.concepts, _CONCEPT, strict=True))} + {' + '.join(f"CASE WHEN contains(ft, '{w}') THEN 0.5 ELSE 0.0 END" for w in Q.works)}
  + {' + '.join(f"CASE WHEN {_has('ft', n)} THEN {0.5 if s else 0.35} ELSE 0.0 END" for n, s in Q.related)} + {' + '.join("CASE WHEN " + " OR ".join(f"contains(fp, '{n}') OR contains('{n}', fp)" for n in names) + f" THEN {0.08 * c} ELSE 0.0 END" for names, c in Q.areas if c >= 0.4)}))"""
_SQL_PARTS = "CASE WHEN contains(fp, 'economy') THEN 0.55 WHEN contains(fp, 'standard') THEN 0.35 ELSE 0.0 END AS topics, CASE WHEN provider = 'journals' THEN 0.35 ELSE 0.0 END AS journal, CASE WHEN contains(ft, 'ring') THEN 0.1 ELSE 0.0 END AS person, CASE WHEN contains(fp, 'promo') THEN 0.65 ELSE 0.0 END AS outside, CASE WHEN provider = 'registry' THEN 0.35 ELSE 0.0 END AS outside_journal"
_SQL_D = "least(1.0, greatest(0.0, 0.15 + (topics + journal + person + 0.0 + 0.0) - least(1.0, greatest(0.0, outside + outside_journal)) * CASE WHEN topics >= 0.55 OR journal >= 0.35 THEN 0.3 WHEN topics + journal + person + 0.0 + 0.0 >= 0.35 THEN 0.65 ELSE 1.0 END))"


def _rows(spark, d):
    rows = dealt(relation(spark, d, _LONG)).withColumn("ft", text.fold(C("title"))).withColumn("t", F.array_distinct(F.split("ft", " ")))
    return rows.withColumn("fa", text.fold(C("abstract"))).withColumn("fp", text.fold(C("topic"))).withColumn("fu", text.fold(C("author")))


def _discipline():
    yes = lambda cond, x: F.when(cond, x).otherwise(0.0)
    topics = F.when(C("fp").contains("economy"), 0.55).when(C("fp").contains("standard"), 0.35).otherwise(0.0)
    return K.discipline(topics, yes(C("provider") == "journals", 0.35), yes(C("ft").contains("ring"), 0.1), F.lit(0.0), F.lit(0.0), yes(C("fp").contains("promo"), 0.65), yes(C("provider") == "registry", 0.35))


@query(f"SELECT id, round(CAST({_SQL_Q} AS DOUBLE), 6) AS q FROM ({_ROWS})")
def rank_q(spark, d):
    return _rows(spark, d).select("id", F.round(K.query_match(C("ft"), C("t"), Q), 6).alias("q"))


@query(f"SELECT id, round(CAST({_SQL_P} AS DOUBLE), 6) AS p FROM ({_ROWS})")
def rank_p(spark, d):
    return _rows(spark, d).select("id", F.round(K.domain_match(C("ft"), C("t"), C("fp"), Q), 6).alias("p"))


@query(f"SELECT id, round(CAST({_SQL_D} AS DOUBLE), 6) AS d FROM (SELECT *, {_SQL_PARTS} FROM ({_ROWS}))")
def rank_d(spark, d):
    return _rows(spark, d).select("id", F.round(_discipline(), 6).alias("d"))


_SQL_CONJ = f"CASE WHEN {_has('x', Q.area_terms[0])} AND {_has('x', Q.domain_terms[0])} THEN 'both' WHEN {_has('x', Q.area_terms[0])} THEN 'area-only' WHEN {_has('x', Q.domain_terms[0])} THEN 'domain-only' ELSE 'neither' END"


@query(f"""
SELECT id, round(CAST(cov * 4 + CASE provider WHEN 'journals' THEN 5 WHEN 'archive' THEN 3 ELSE CASE WHEN cov < 0.5 THEN -2 ELSE 0 END END AS DOUBLE), 6) AS adjustment, bucket, CAST(CASE bucket WHEN 'both' THEN 2 WHEN 'area-only' THEN -2 WHEN 'neither' THEN -1 ELSE 0 END AS INT) AS points
FROM (SELECT *, {_cov(Q.original)} AS cov, {_SQL_CONJ} AS bucket FROM (SELECT *, ft || ' ' || fa AS x FROM ({_ROWS})))""")
def rank_adjustments(spark, d):
    adjustment = K.source_adjustment(K.covered(Q.original, C("t")), F.array("provider"), "journals", "archive", "registry")
    both = K.conjunction(F.concat_ws(" ", "ft", "fa"), F.trim("abstract") != "", Q)
    return _rows(spark, d).select("id", F.round(adjustment, 6).alias("adjustment"), both["bucket"].alias("bucket"), both["points"].alias("points"))


_AUTHOR = "author brand 1 2"
_SQL_TOTAL = f"""
WITH r AS MATERIALIZED ({_ROWS}) SELECT id, author_tier, score, CASE WHEN score >= 85 THEN 'P1' WHEN score >= 65 THEN 'P2' WHEN score >= 40 THEN 'P3' ELSE 'P4' END AS level FROM (
  SELECT id, author_tier, greatest(least(100, greatest(0, base + CAST(floor(cov * 4 + CASE provider WHEN 'journals' THEN 5 WHEN 'archive' THEN 3 ELSE CASE WHEN cov < 0.5 THEN -2 ELSE 0 END END) AS INT))), CASE author_tier WHEN 3 THEN 95 WHEN 2 THEN 90 ELSE 0 END) AS score FROM (
    SELECT id, provider, cov, CASE WHEN len(list_intersect(string_split('{_AUTHOR}', ' '), u)) = 4 THEN CASE WHEN len(u) = 4 THEN 3 ELSE 2 END ELSE 0 END AS author_tier,
      CAST(greatest(0, least(100, round((CAST({_SQL_Q} AS DOUBLE) * 0.28 + CAST({_SQL_P} AS DOUBLE) * 0.3 + CAST({_SQL_D} AS DOUBLE) * 0.2 + (0.75 * least(1.0, 0.2 + 0.25 * (asked_by - 1)) + 0.25 * least(1.0, 0.5 * (found_by - 1))) * 0.1 + CAST(CASE WHEN doi IS NOT NULL THEN 0.35 ELSE 0.0 END + 0.2 AS DOUBLE) * 0.08 + least(1.0, greatest(0.0, log10(citations + 1) / 4)) * 0.04
        - CASE WHEN len(t) >= 20 THEN 0.05 ELSE 0.0 END - CASE WHEN len(t) >= 14 AND cov < 1 THEN 0.1 ELSE 0.0 END) * 100, 0))) AS INT) AS base
    FROM (SELECT *, greatest(1, {' + '.join(f"CAST({_cov(x)} >= 0.5 AS INT)" for x in ASKED)}) AS asked_by, (SELECT count(DISTINCT provider) FROM r AS o WHERE o.ft = r.ft) AS found_by, {_cov(Q.original)} AS cov, list_distinct(string_split(fu, ' ')) AS u, {_SQL_PARTS} FROM r)))"""


def _totals(spark, d):
    """S counts the providers that have a title and the expansions that it answers by half; long titles that cover little lose."""
    rows = _rows(spark, d)
    rows = rows.join(rows.groupBy("ft").agg(F.countDistinct("provider").alias("found_by")), "ft")
    asked_by = F.greatest(F.lit(1), sum(((K.covered(x, C("t")) >= 0.5).cast("int") for x in ASKED), F.lit(0)))
    cover = K.covered(Q.original, C("t"))
    parts = {
        "q": K.query_match(C("ft"), C("t"), Q), "p": K.domain_match(C("ft"), C("t"), C("fp"), Q), "d": _discipline(), "s": scoring.consensus(asked_by, C("found_by")),
        "b": scoring.completeness({"doi": (0.35, C("doi").isNotNull()), "abstract": (0.2, C("abstract").isNotNull())}), "i": scoring.impact(C("citations")),
    }
    base = scoring.total(parts, K.WEIGHTS, scoring.dispersion_penalty(F.size("t"), cover))
    points = F.floor(K.source_adjustment(cover, F.array("provider"), "journals", "archive", "registry")).cast("int")
    tier = K.author_tier(F.array_distinct(F.split("fu", " ")), _AUTHOR)
    score = K.with_author_floor(F.greatest(F.lit(0), F.least(F.lit(100), base + points)), tier)
    return rows.select("id", tier.alias("author_tier"), score.alias("score")).withColumn("level", scoring.level(C("score")))


@query(_SQL_TOTAL)
def rank_profile(spark, d):
    return _totals(spark, d)


@query(f"SELECT id, author_tier, score, level FROM ({_SQL_TOTAL}) ORDER BY author_tier DESC, score DESC, id LIMIT 50")
def rank_order(spark, d):
    return _totals(spark, d).orderBy(F.desc("author_tier"), F.desc("score"), "id").limit(50)


_LOCAL = "small ring of econ"


def _sql_match(token: str, t: str) -> str:
    return f"(list_contains({t}, '{token}'){f' OR len(list_filter({t}, lambda z: starts_with(z, {token!r}))) > 0' if len(token) >= 4 else ''})"


_FIELDS = {"title": ("t", 14), "author": ("u", 10), "topic": ("p", 7), "abstract": ("a", 2)}
_ALL = {n: "(" + " AND ".join(_sql_match(w, c) for w in _LOCAL.split()) + ")" for n, (c, _) in _FIELDS.items()}
_HITS = " + ".join(f"CASE WHEN {_sql_match(w, c)} THEN {p} ELSE 0 END" for w in _LOCAL.split() for c, p in _FIELDS.values())
_MATCHED = " + ".join("CASE WHEN " + " OR ".join(_sql_match(w, c) for c, _ in _FIELDS.values()) + " THEN 1 ELSE 0 END" for w in _LOCAL.split())


@query(f"""
SELECT id, score, year FROM (SELECT id, year, round(CAST(CASE WHEN ft = '{_LOCAL}' THEN 90 WHEN {_ALL["title"]} THEN 55 ELSE 0 END + CASE WHEN {_ALL["author"]} THEN 35 ELSE 0 END + CASE WHEN {_ALL["topic"]} THEN 20 ELSE 0 END + {_HITS} + ({_MATCHED}) / 4.0 * 22 + CASE WHEN {_ALL["title"]} THEN 22 ELSE 0 END AS DOUBLE), 3) AS score
  FROM (SELECT *, list_distinct(string_split(fu, ' ')) AS u, list_distinct(string_split(fp, ' ')) AS p, list_distinct(string_split(fa, ' ')) AS a FROM ({_ROWS}))) WHERE score > 0""")
def local_search(spark, d):
    words = lambda c: F.array_distinct(F.split(c, " "))
    rows = _rows(spark, d).withColumns({"u": words("fu"), "p": words("fp"), "a": words("fa")})
    fields = {"title": (C("t"), 14), "author": (C("u"), 10), "topic": (C("p"), 7), "abstract": (C("a"), 2)}
    score = K.local_score(_LOCAL, C("doi"), C("ft"), fields, {"title": 55, "author": 35, "topic": 20})
    # a filter over the score would be pushed below what the score is computed from, and compute all of it once more
    return rows.select("id", F.explode(F.filter(F.array(score), lambda x: x > 0)).alias("score"), "year")


@query("""
SELECT p_partkey, label, round(CAST(share AS DOUBLE), 6) AS share, CAST(CASE WHEN grade = 2 AND pct >= 0.8 THEN 3 ELSE grade END AS INT) AS grade FROM (
  SELECT p_partkey, label, share, CAST(floor(share * 3) AS INT) AS grade, cume_dist() OVER (PARTITION BY p_brand ORDER BY share) AS pct FROM (
    SELECT p_partkey, p_brand, CASE WHEN greatest(a, b, c) = a THEN 'large' WHEN greatest(a, b, c) = b THEN 'dear' ELSE 'plain' END AS label, 1.0 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))) AS share
    FROM (SELECT p_partkey, p_brand, p_size / 10.0 AS a, p_retailprice / 500 AS b, 1.5 AS c FROM part)))""")
def softmax_labels(spark, d):
    from pyspark.sql import Window as W

    from lexmill.session import table

    logits = {"large": C("p_size") / 10.0, "dear": C("p_retailprice") / 500, "plain": F.lit(1.5)}
    shares = table(spark, d, "part").select("p_partkey", "p_brand", K.softmax(logits).alias("m")).withColumn("share", F.greatest(*[C("m")[k] for k in logits]))
    label = F.coalesce(*[F.when(C("m")[k] == C("share"), F.lit(k)) for k in logits])
    graded = shares.select("p_partkey", label.alias("label"), "share", F.floor(C("share") * 3).cast("int").alias("g"), F.cume_dist().over(W.partitionBy("p_brand").orderBy("share")).alias("pct"))
    return graded.select("p_partkey", "label", F.round("share", 6).alias("share"), F.when((C("g") == 2) & (C("pct") >= 0.8), 3).otherwise(C("g")).alias("grade"))


#: Items of an archive, each with a query that finds something of it.
_ITEMS = f"""
SELECT id, title, author, topic, abstract, CASE id % 6 WHEN 0 THEN concat('The ', title) WHEN 1 THEN concat(topic, ' studies of ', author) WHEN 2 THEN 'a ring of the economy: in context' WHEN 3 THEN author WHEN 4 THEN 'notes on the other' ELSE 'of y a' END AS query FROM ({WORKS})"""
_ASKED = f"list_filter(string_split(fq, ' '), lambda t: length(t) > 1 AND t NOT IN ({', '.join(map(repr, K.ARCHIVE_STOPWORDS))}))"
_FOUND = {"title": "ft", "authors": "fu", "subjects": "fs", "description": "fd"}
_POINTS = " + ".join(f"len(list_filter(w, lambda t: contains({c}, t))) * {K.ARCHIVE_POINTS[n]}" for n, c in _FOUND.items())


@query(f"""
WITH f AS (SELECT id, {', '.join(f"{sql_fold(c)} AS {n}" for c, n in (("query", "fq"), ("title", "ft"), ("author", "fu"), ("topic", "fs"), ("abstract", "fd")))} FROM ({_ITEMS})),
u AS (SELECT *, {_ASKED} AS a FROM f), w AS (SELECT *, list_filter(a, lambda t, i: list_position(a, t) = i)[1:{K.ARCHIVE_WORDS}] AS w FROM u),
p AS (SELECT *, len(list_filter(w, lambda t: contains(ft, t))) AS nt, len(list_filter(w, lambda t: contains(fu, t))) AS nu, len(list_filter(string_split(ft, ' '), lambda t: t <> '')) AS size FROM w)
SELECT id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(CAST(greatest(0.0, {_POINTS} + len(list_filter(w, lambda t: {' OR '.join(f'contains({c}, t)' for c in _FOUND.values())})) / len(w) * 12
  + CASE WHEN len(list_filter(w, lambda t: NOT contains(concat_ws(' ', ft, fu, fs), t))) = 0 THEN 15 ELSE 0 END + CASE WHEN nt >= 2 THEN nt * 3 ELSE 0 END + CASE WHEN nu > 0 THEN 16 + nu * 3 ELSE 0 END + CASE WHEN size > 0 AND nt > 0 THEN nt / size * 20 ELSE 0 END
  - least(24, len(list_filter([{', '.join(map(repr, K.SECONDARY))}], lambda m: contains(ft, m) AND NOT contains(fq, m))) * 12)) AS DOUBLE), 3) END AS score FROM p""")
def archive_preranking(spark, d):
    """Points of an archive's items for queries, before the profile ranks them."""
    read = ("query", "title", "author", "topic", "abstract")
    rows = dealt(relation(spark, d, _ITEMS)).select("id", *[text.fold(C(c)).alias(c) for c in read])
    return rows.select("id", K.archive_score(*map(C, read)).alias("score"))


_PERSONS_NAMED, _CONCEPTS_NAMED, _WORKS_NAMED = {"Ring": ("ring", "rings"), "Gear": ("gear",)}, {"economy": ("economy", "economics")}, ("small ring of economy",)
_SEEN = f"SELECT *, CASE WHEN id % 4 = 0 THEN '' ELSE author END AS people, id % 9 = 0 AS asked, CAST(id * 7 % 60 AS INT) AS topics, CAST(id * 11 % 50 AS INT) AS journal, CAST(id % 3 AS INT) AS outside, CASE id % 3 WHEN 0 THEN provider ELSE concat(provider, '; other') END AS providers, id % 6 = 1 AS is_open FROM ({WORKS})"


@query(f"""
WITH s AS (SELECT *, {sql_fold("title")} AS ft, list_filter(string_split(people, '; '), lambda x: x <> '') AS a, string_split(providers, '; ') AS p, {' + '.join(f"CAST({_cov(x)} >= 0.5 AS INT)" for x in ASKED)} AS n FROM (SELECT *, list_distinct(string_split({sql_fold("title")}, ' ')) AS t FROM ({_SEEN}))),
r AS (SELECT id, list_filter([CASE WHEN asked AND len(a) > 0 THEN 'by the person asked for: ' || array_to_string(a, ', ') END,
  {', '.join(f"CASE WHEN {_has('ft', names)} THEN 'title names {who}' END" for who, names in _PERSONS_NAMED.items())}, {', '.join(f"CASE WHEN {_has('ft', names)} THEN 'title has the concept {what}' END" for what, names in _CONCEPTS_NAMED.items())}, {', '.join(f"CASE WHEN contains(ft, '{w}') THEN 'is the work {w}' END" for w in _WORKS_NAMED)},
  CASE WHEN topics >= 35 THEN 'topics of the discipline' END, CASE WHEN journal >= 30 THEN 'journal of the discipline' END, CASE WHEN outside > 0 THEN 'signals of other disciplines' END,
  CASE WHEN n = 1 THEN 'found by q' WHEN n > 1 THEN 'found by ' || n || ' variants of the query' END, CASE WHEN len(p) = 1 THEN 'from ' || p[1] ELSE 'identified by ' || array_to_string(p, ' and ') END,
  CASE WHEN doi IS NOT NULL THEN 'has a DOI' END, CASE WHEN len(a) > 0 AND year IS NOT NULL THEN 'authors and date are known' END, CASE WHEN is_open THEN 'open access' END], lambda x: x IS NOT NULL)[1:6] AS l FROM s)
SELECT id, array_to_string(l, ' | ') AS reasons FROM r""")
def explanations(spark, d):
    """Why a work is shown: at most six reasons, in the order of their builders."""
    rows = relation(spark, d, _SEEN).withColumn("ft", text.fold(C("title"))).withColumn("t", F.array_distinct(F.split("ft", " ")))
    found = F.array_repeat(F.lit("q"), sum(((K.covered(x, C("t")) >= 0.5).cast("int") for x in ASKED), F.lit(0)))
    people = F.filter(F.split("people", "; "), lambda x: x != "")
    builders = curation.result_reasons(C("ft"), people, C("asked"), _PERSONS_NAMED, _CONCEPTS_NAMED, _WORKS_NAMED, C("topics"), C("journal"), C("outside"), found, F.split("providers", "; "), C("doi"), C("year"), C("is_open"))
    return rows.select("id", F.array_join(curation.reasons(builders), " | ").alias("reasons"))
