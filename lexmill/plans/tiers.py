"""Tier queries: three versions of the CASE, the search filter, source types, document roles and points of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import roles, text, tiers
from lexmill.plans.documents import sql_fold
from lexmill.plans.inputs import SIGNALS, WORKS, registry, relation

QUERIES, ORACLE, query = registry()
C = F.col

_V1 = f"""
SELECT id, CASE WHEN is_phenomenology AND coalesce(hard_noise, 0) >= 0.55 AND coalesce(family, 0) < 0.2 THEN 'EXCLUDE' WHEN coalesce(family, 0) >= 0.5 OR (coalesce(family, 0) >= 0.3 AND (n_concepts >= 2 OR concept >= 0.5)) THEN 'CORE'
    WHEN coalesce(family, 0) >= 0.3 OR (n_concepts >= 2 AND concept >= 0.4) THEN 'PROBABLE' ELSE 'BORDERLINE' END AS tier,
  CASE WHEN is_phenomenology AND coalesce(hard_noise, 0) >= 0.55 AND coalesce(family, 0) < 0.2 THEN 'phenomenology-hard-science-noise' WHEN coalesce(family, 0) >= 0.5 THEN 'strong-philosophy-keyword' WHEN coalesce(family, 0) >= 0.3 AND n_concepts >= 2 THEN 'keyword-plus-multiple-concepts'
    WHEN coalesce(family, 0) >= 0.3 AND concept >= 0.5 THEN 'keyword-plus-concept-score' WHEN coalesce(family, 0) >= 0.3 THEN 'moderate-philosophy-keyword' WHEN n_concepts >= 2 AND concept >= 0.4 THEN 'multiple-philosophy-concepts' ELSE 'insufficient-corroboration' END AS reason
FROM ({SIGNALS})"""
_V2 = f"""
SELECT *, CASE WHEN reason = 'phenomenology-hard-science-noise' THEN 'EXCLUDE' WHEN reason IN ('strong-nonduplicate-corroboration', 'generic-plus-secondary-philosophy', 'corroboration-plus-multiple-concepts') THEN 'CORE' WHEN reason = 'insufficient-corroboration' THEN 'BORDERLINE' ELSE 'PROBABLE' END AS tier FROM (
  SELECT *, CASE WHEN is_phenomenology AND coalesce(hard_noise, 0) >= 0.55 AND own < 0.2 THEN 'phenomenology-hard-science-noise' WHEN own >= 0.5 AND concept >= 0.4 THEN 'strong-nonduplicate-corroboration' WHEN coalesce(keyword, 0) >= 0.35 AND coalesce(secondary, 0) >= 0.35 THEN 'generic-plus-secondary-philosophy'
    WHEN own >= 0.45 AND n_concepts >= 2 THEN 'corroboration-plus-multiple-concepts' WHEN own >= 0.25 THEN 'moderate-nonduplicate-corroboration' WHEN n_concepts >= 2 AND concept >= 0.45 THEN 'multiple-philosophy-concepts' WHEN NOT is_ambiguous AND concept >= 0.65 THEN 'strong-anchor-only' ELSE 'insufficient-corroboration' END AS reason FROM ({SIGNALS}))"""
_V31 = f"""
SELECT id, role, title, CASE WHEN reason IN ('carry-v2-high-confidence-exclude', 'phenomenology-hard-science-v3-1') THEN 'EXCLUDE' WHEN reason IN ('carry-v2-core-nonambiguous', 'context-evidence>=6') THEN 'CORE' WHEN reason LIKE '%-with-strong-philosophy' OR reason = 'context-evidence>=3' THEN 'PROBABLE' ELSE 'BORDERLINE' END AS tier, reason FROM (
  SELECT id, role, title, CASE WHEN tier = 'EXCLUDE' THEN 'carry-v2-high-confidence-exclude'
    WHEN is_phenomenology AND own < 0.2 AND NOT has_text_hits AND (coalesce(hard_noise, 0) >= 0.35 OR (coalesce(top_domain, '') IN ('physics', 'chemistry', 'materials-science', 'mathematics') AND top_domain_score >= 0.45)) THEN 'phenomenology-hard-science-v3-1'
    WHEN role = 'LOW_QUALITY' THEN 'low-quality-document' WHEN role = 'PARATEXT' THEN CASE WHEN evidence >= 6 THEN 'paratext-with-strong-philosophy' ELSE 'paratext' END WHEN role = 'EMPIRICAL_ADJACENT' THEN CASE WHEN evidence >= 6 THEN 'empirical-adjacent-with-strong-philosophy' ELSE 'empirical-adjacent' END
    WHEN tier = 'CORE' AND NOT is_ambiguous THEN 'carry-v2-core-nonambiguous' WHEN evidence >= 6 THEN 'context-evidence>=6' WHEN evidence >= 3 THEN 'context-evidence>=3' ELSE 'context-evidence<3' END AS reason FROM ({_V2}))"""


def _v2(s):
    return s.withColumn("t", tiers.tier_v2(C("is_phenomenology"), C("is_ambiguous"), C("hard_noise"), C("own"), C("keyword"), C("secondary"), C("concept"), C("n_concepts")))


def _v3(spark, d):
    t = tiers.tier_v3_1(C("t.tier"), C("role"), C("evidence"), C("is_phenomenology"), C("is_ambiguous"), C("own"), C("hard_noise"), C("top_domain"), C("top_domain_score"), C("has_text_hits"))
    return _v2(relation(spark, d, SIGNALS)).withColumn("t", t).select("id", "role", "title", "t.tier", "t.reason")


@query(_V1)
def tier_v1(spark, d):
    t = tiers.tier_v1(C("is_phenomenology"), C("hard_noise"), C("family"), C("concept"), C("n_concepts"))
    return relation(spark, d, SIGNALS).withColumn("t", t).select("id", "t.tier", "t.reason")


@query(f"SELECT id, tier, reason FROM ({_V2})")
def tier_v2(spark, d):
    return _v2(relation(spark, d, SIGNALS)).select("id", "t.tier", "t.reason")


@query(f"SELECT id, tier, reason, role FROM ({_V31})")
def tier_v3_1(spark, d):
    return _v3(spark, d).drop("title")


@query(f"SELECT id, title, tier FROM ({_V31}) WHERE tier IN ('CORE', 'PROBABLE') AND role NOT IN ('LOW_QUALITY', 'PARATEXT')")
def search_tier_filter(spark, d):
    return _v3(spark, d).filter(tiers.searchable(C("tier"), C("role"))).select("id", "title", "tier")


_TYPES = "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'Tesis de maestría' WHEN 1 THEN 'Book Chapter' WHEN 2 THEN 'Artículo' WHEN 3 THEN 'PhD Thesis' WHEN 4 THEN 'dataset' WHEN 5 THEN 'Capítulo de libro' END AS kind FROM orders"


@query(f"""
SELECT o_orderkey, CASE WHEN k LIKE '%tesis%' OR k LIKE '%thesis%' THEN 'thesis' WHEN regexp_matches(k, '^(book chapter|capitulo de libro|articulo|article|libro|book|ponencia|conference|manual)') THEN 'non-thesis' ELSE 'unknown' END AS status FROM (SELECT o_orderkey, {sql_fold("kind")} AS k FROM ({_TYPES}))""")
def source_types(spark, d):
    return relation(spark, d, _TYPES).select("o_orderkey", tiers.source_type(text.fold(C("kind"))).alias("status"))


#: Works with titles and abstracts of every role, and the signals that evidence is made of.
_STUDIES = f"""
SELECT id, CASE id % 11 WHEN 0 THEN 'Book Review: soul' WHEN 1 THEN 'Errata' WHEN 2 THEN 'A review of  rings' WHEN 3 THEN 'Préface' ELSE title END AS title,
  CASE id % 13 WHEN 0 THEN 'Click here to download' WHEN 1 THEN 'Downloads: 3, rating: 5' WHEN 2 THEN 'A phenomenological study of <i>participants</i>' WHEN 3 THEN 'Anxiety and therapy of patients' WHEN 4 THEN 'Clinical survey, oral health' WHEN 5 THEN '' WHEN 6 THEN 'Rating: good' ELSE abstract END AS abstract,
  CASE id % 4 WHEN 0 THEN 'Phenomenology (philosophy)' WHEN 1 THEN 'Existentialism' WHEN 2 THEN 'Philosophy of medicine' ELSE 'Ethics' END AS concept, id % 5 = 4 AS paratext, CAST(id % 3 AS INT) AS title_persons, CAST(id % 2 AS INT) AS abstract_persons, id % 7 = 3 AS explicit,
  CAST(id % 5 % 3 AS INT) AS title_hits, CAST(id % 9 % 4 AS INT) AS abstract_hits, id % 3 = 1 AS prior, CAST(id * 17 % 100 AS DOUBLE) / 100 AS concept_score, CAST(id % 4 AS INT) AS concepts, CASE WHEN id % 5 > 0 THEN CAST(id * 31 % 97 AS DOUBLE) / 100 END AS corroboration, CASE WHEN id % 7 > 0 THEN CAST(id * 7 % 89 AS DOUBLE) / 100 END AS keyword
FROM ({WORKS})"""
_ASCII = "trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({x})), '<[^>]*>', ' ', 'g'), '[^\\x00-\\x7F]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
_MARKS = lambda x, phrases: f"len(list_filter([{', '.join(repr(p) if chr(39) not in p else chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) for p in phrases)}], lambda p: contains({x}, p)))"
_TITLES = ", ".join("'" + p.replace("'", "''") + "'" for p in roles.PARATEXT_TITLES)


@query(f"""
WITH f AS (SELECT *, {_ASCII.format(x='title')} AS t, {_ASCII.format(x='abstract')} AS a FROM ({_STUDIES})), s AS (SELECT *, trim(t || ' ' || a) AS x, title_persons + abstract_persons = 0 AND NOT explicit AND title_hits + abstract_hits <= 1 AS alone FROM f)
SELECT id, CASE WHEN contains(x, '{roles.SPAM}') OR {_MARKS('x', roles.LOW_QUALITY)} >= 2 THEN 'LOW_QUALITY' WHEN {_MARKS('t', roles.REVIEW)} >= 1 THEN 'REVIEW' WHEN t IN ({_TITLES}) OR paratext AND a = '' THEN 'PARATEXT'
  WHEN alone AND (concept = '{roles.PHENOMENOLOGY}' AND {_MARKS('x', roles.METHOD)} >= 1 AND {_MARKS('x', roles.EMPIRICAL)} >= 1 OR concept = '{roles.EXISTENTIALISM}' AND {_MARKS('x', roles.CLINICAL)} >= 2 OR concept = '{roles.MEDICINE}' AND {_MARKS('x', roles.MEDICAL)} >= 2) THEN 'EMPIRICAL_ADJACENT' ELSE 'SCHOLARLY' END AS role FROM s""")
def document_roles(spark, d):
    """What kind of document a work is."""
    rows = relation(spark, d, _STUDIES)
    persons = F.col("title_persons") + F.col("abstract_persons")
    return rows.select("id", roles.role(text.fold_ascii(F.col("title")), text.fold_ascii(F.col("abstract")), F.col("concept"), persons, F.col("title_hits"), F.col("abstract_hits"), F.col("explicit"), F.col("paratext")).alias("role"))


_STEPS = (
    ("prior", 1, "v2-probable"), ("corroboration >= 0.50", 3, "nondup>=.50"), ("corroboration >= 0.25 AND corroboration < 0.50", 2, "nondup>=.25"), ("concepts >= 2", 1, "multi-concept"), (f"concept NOT IN {roles.COLLIDING} AND concept_score >= 0.65", 1, "strong-anchor"),
    ("keyword >= 0.50", 2, "ontology-keyword>=.50"), ("keyword >= 0.30 AND keyword < 0.50", 1, "ontology-keyword>=.30"), ("title_persons >= 1", 3, "philosopher-in-title"), ("title_persons >= 2", 1, "multiple-title-philosophers"), ("title_persons = 0 AND abstract_persons >= 1", 1, "philosopher-in-abstract"),
    ("explicit", 1, "explicit-philosophy-text"), ("title_hits >= 1", 2, "strong-title-term"), ("title_hits >= 2", 1, "multiple-title-terms"), ("abstract_hits >= 1", 1, "strong-abstract-term"), ("abstract_hits >= 3", 1, "multiple-abstract-terms"),
)


@query(f"""
SELECT id, {' + '.join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n, _ in _STEPS)} AS score, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{r}' END" for c, _, r in _STEPS)}], lambda x: x IS NOT NULL), ' ') AS reasons FROM ({_STUDIES})""")
def evidence_points(spark, d):
    """Points of evidence that a work belongs to the corpus, and their reasons."""
    c = F.col
    found = roles.evidence(c("prior"), c("concept").isin(*roles.COLLIDING), c("concept_score"), c("concepts"), c("corroboration"), c("keyword"), c("title_persons"), c("abstract_persons"), c("explicit"), c("title_hits"), c("abstract_hits"))
    return relation(spark, d, _STUDIES).select("id", found.alias("e")).select("id", "e.score", F.array_join("e.reasons", " ").alias("reasons"))
