"""Search, classification and text queries over documents, pages and benchmark passages."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from lexmill.functions import hashing, scoring, text
from lexmill.operators import graph, topk
from lexmill.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add_query(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add_query


SQL_FOLD = "trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"
SQL_TITLE = "split_part(coalesce(text, ''), chr(10), 1)"


def sql_fold(x: str) -> str:
    return SQL_FOLD.format(x=x)


QUERY_WORDS = ("ering", "thand", "ertion", "the", "license")
PHRASE = "and the"


def _scored(spark, d):
    docs = table(spark, d, "documents")
    hits = lambda c: reduce(add, [c.contains(w).cast("int") for w in QUERY_WORDS])
    folded = F.array(F.struct(text.fold(text.title_of(F.col("text"))).alias("title"), text.fold(F.col("text")).alias("body")))
    counted = F.transform(folded, lambda x: F.struct(hits(x["body"]).alias("body"), (30 * text.has_phrase(x["title"], F.lit(PHRASE)).cast("int") + 8 * hits(x["title"])).alias("title")))
    # an explode of nothing or one is a filter that Catalyst does not repeat: each text is folded once
    wanted = docs.select("doc_id", "n_chars", F.explode(F.filter(counted, lambda x: x["body"] > 0)).alias("x"))
    return wanted.select("doc_id", "n_chars", (F.col("x.title") + 3 * F.col("x.body")).cast("long").alias("score"))


_SQL_SCORED = f"""
SELECT doc_id, n_chars, CAST(30 * CAST(contains(' ' || title || ' ', ' {PHRASE} ') AS INT) + 8 * ({" + ".join(f"CAST(contains(title, '{w}') AS INT)" for w in QUERY_WORDS)}) + 3 * ({" + ".join(f"CAST(contains(body, '{w}') AS INT)" for w in QUERY_WORDS)}) AS BIGINT) AS score
FROM (SELECT doc_id, n_chars, {sql_fold(SQL_TITLE)} AS title, {sql_fold("text")} AS body FROM documents) WHERE {" OR ".join(f"contains(body, '{w}')" for w in QUERY_WORDS)}"""


@query(f"SELECT * FROM ({_SQL_SCORED}) ORDER BY score DESC, n_chars DESC NULLS LAST, doc_id LIMIT 50")
def lexical_topn(spark, d):
    return _scored(spark, d).orderBy(F.desc("score"), F.desc_nulls_last("n_chars"), "doc_id").limit(50)


@query(_SQL_SCORED)
def field_weighted_score(spark, d):
    return _scored(spark, d)


@query("""
SELECT sha256(text) AS sha256, min(doc_id) AS representative, count(*) AS copies, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def exact_dedup(spark, d):
    return table(spark, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("representative"), F.count("*").alias("copies"), F.countDistinct("source").alias("sources"))


@query(f"""
SELECT title, count(*) AS n, min(doc_id) AS representative, max(n_chars) AS longest, count(DISTINCT lang) AS langs FROM (SELECT {sql_fold(SQL_TITLE)} AS title, doc_id, n_chars, lang FROM documents) GROUP BY title""")
def title_identity_groups(spark, d):
    rows = table(spark, d, "documents").select(text.fold(text.title_of(F.col("text"))).alias("title"), "doc_id", "n_chars", "lang")
    return rows.groupBy("title").agg(F.count("*").alias("n"), F.min("doc_id").alias("representative"), F.max("n_chars").alias("longest"), F.countDistinct("lang").alias("langs"))


@query(f"""
WITH v AS (SELECT doc_id, lang, list_distinct(string_split({sql_fold("text")}, ' ')) AS w FROM documents),
c AS (SELECT doc_id, lang, {", ".join(f"len(list_intersect(w, {list(words)!r})) AS {lang}_n" for lang, words in text.FUNCTION_WORDS.items())} FROM v),
m AS (SELECT *, greatest(en_n, fr_n, de_n, es_n) AS top FROM c)
SELECT lang, CASE WHEN top = 0 OR CAST(en_n = top AS INT) + CAST(fr_n = top AS INT) + CAST(de_n = top AS INT) + CAST(es_n = top AS INT) > 1 THEN NULL WHEN en_n = top THEN 'en' WHEN fr_n = top THEN 'fr' WHEN de_n = top THEN 'de' ELSE 'es' END AS voted, count(*) AS n FROM m GROUP BY ALL""")
def lang_vote(spark, d):
    voted = text.voted_language(text.language_votes(F.col("text")))
    return table(spark, d, "documents").select("lang", voted.alias("voted")).groupBy("lang", "voted").agg(F.count("*").alias("n"))


def _sql_voted(words: str) -> str:
    count = {lang: f"len(list_intersect({words}, {list(fw)!r}))" for lang, fw in text.FUNCTION_WORDS.items()}
    top = f"greatest({', '.join(count.values())})"
    leaders = " + ".join(f"CAST({c} = {top} AS INT)" for c in count.values())
    return f"CASE WHEN {top} = 0 OR {leaders} > 1 THEN NULL {' '.join(f"WHEN {c} = {top} THEN '{lang}'" for lang, c in count.items())} END"


@query(f"""
SELECT doc_id, coalesce(CASE WHEN length(trim(title)) >= 12 THEN {_sql_voted("wt")} END, CASE WHEN length(trim(text)) >= 12 THEN {_sql_voted("wb")} END, lang) AS language FROM (
  SELECT doc_id, lang, text, title, list_distinct(string_split({sql_fold("title")}, ' ')) AS wt, list_distinct(string_split({sql_fold("text")}, ' ')) AS wb FROM (SELECT *, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents))""")
def effective_language(spark, d):
    return table(spark, d, "documents").select("doc_id", text.effective_language(text.title_of(F.col("text")), F.col("text"), F.col("lang")).alias("language"))


_ASKED = "CASE c_custkey % 6 WHEN 0 THEN 'the meaning of work and time' WHEN 1 THEN '¿qué es el tiempo de los otros?' WHEN 2 THEN 'die Größe der Zeit und das Maß' WHEN 3 THEN 'œuvre des temps' WHEN 4 THEN 'razão' ELSE 'tempus fugit' END"
_SQL_LETTERS = {"en": "0", **{k: f"3 * CAST(coalesce(regexp_matches(q, '{v}'), FALSE) AS INT)" for k, v in text.TELLING_LETTERS.items()}}


@query(f"""
SELECT id, coalesce(arg_max(lang, n) FILTER (n = top AND leaders = 1 AND n > 0), 'unknown') AS language FROM (SELECT *, count(*) FILTER (n = top) OVER (PARTITION BY id) AS leaders FROM (SELECT *, max(n) OVER (PARTITION BY id) AS top FROM ({' UNION ALL '.join(
    f"SELECT id, '{lang}' AS lang, {f'len(list_intersect(w, {list(text.FUNCTION_WORDS[lang])!r}))' if lang in text.FUNCTION_WORDS else '0'} + {letters} AS n FROM (SELECT *, list_distinct(string_split({sql_fold('q')}, ' ')) AS w FROM (SELECT c_custkey AS id, {_ASKED} AS q FROM customer))" for lang, letters in _SQL_LETTERS.items())}))) GROUP BY id""")
def query_language(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(_ASKED).alias("q"))
    return asked.select("id", text.query_language(F.col("q")).alias("language"))


@query(f"""
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(string_split({sql_fold("text")}, ' ')) AS term FROM documents) WHERE term <> '' GROUP BY term""")
def term_statistics(spark, d):
    per = table(spark, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("c"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("cf"))


@query(f"""
SELECT doc_id, md5({sql_fold("text")}) AS rebuilt_md5, len(string_split({sql_fold("text")}, ' ')) AS n_positions FROM documents WHERE {sql_fold("text")} <> ''""")
def inverted_index_rebuild(spark, d):
    """Words with their positions per document, then the text again from the index.

    Whole texts are dealt by document once; both groupings of their words then stay in the task.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, d, "documents").select("doc_id", "text").repartition(parts, "doc_id").select("doc_id", F.posexplode(text.tokens(F.col("text"))).alias("at", "word"))
    index = rows.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("at")).alias("positions"))
    again = index.select("doc_id", "word", F.explode("positions").alias("at")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    return again.select("doc_id", F.md5(F.array_join(F.transform("w", lambda x: x["word"]), " ")).alias("rebuilt_md5"), F.size("w").cast("long").alias("n_positions"))


@query(f"""
SELECT item_id, doc_id FROM benchmark, documents WHERE contains(' ' || {sql_fold("documents.text")} || ' ', ' ' || {sql_fold("benchmark.text")} || ' ') AND {sql_fold("benchmark.text")} <> ''""")
def contamination_containment(spark, d):
    """Passages that stand in documents: candidates by a passage's first five words, then the whole passage."""
    n = 5
    first = lambda words: F.array_join(F.slice(words, 1, n), " ")
    items = table(spark, d, "benchmark").select("item_id", text.fold(F.col("text")).alias("passage")).filter("passage <> ''").withColumn("key", first(F.split("passage", " ")))
    docs = table(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("body"))
    words = docs.select("doc_id", F.split("body", " ").alias("w"))

    def starts(k):
        return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, k), " ")))).alias("key")

    # only keys and ids meet the passages; the few documents that hold a passage's start bring their text after that
    keyed = words.select("doc_id", starts(n))
    short = items.select(F.size(F.split("passage", " ")).alias("k")).filter(f"k < {n}").distinct()
    if not short.isEmpty():
        for k in range(1, n):
            keyed = keyed.union(words.select("doc_id", starts(k)))
    pairs = keyed.join(items, "key").select("doc_id", "item_id", "passage").distinct()
    found = docs.join(pairs, "doc_id").filter(text.has_phrase(F.col("body"), F.col("passage")))
    return found.select("item_id", "doc_id").distinct()


# Markers by which a document gets its role and evidence.
NOTICES, INSULTS = ("license", "licence", "rights reserved"), ("idiot", "moron", "stupid", "trash")

_SQL_EVIDENCE = f"""
SELECT doc_id, lang, source, body, CAST(3 * coalesce(CAST(q = 1 AS INT), 0) + 2 * CAST(n_words >= 100 AS INT) + 1 * CAST(n_words >= 500 AS INT) + 1 * CAST(distinct_share >= 0.4 AS INT) - 2 * CAST(symbols > 20 AS INT) AS BIGINT) AS evidence, symbols, n_words,
  {" + ".join(f"CAST(contains(body, '{w}') AS INT)" for w in NOTICES)} AS notices, {" + ".join(f"CAST(contains(body, '{w}') AS INT)" for w in INSULTS)} AS insults
FROM (SELECT d.doc_id, lang, source, {sql_fold("text")} AS body, len(string_split({sql_fold("text")}, ' ')) AS n_words, len(list_distinct(string_split({sql_fold("text")}, ' '))) / len(string_split({sql_fold("text")}, ' ')) AS distinct_share,
  length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|]', '', 'g')) AS symbols, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _evidence(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select(F.col("doc_id").alias("_l"), F.col("quality").alias("q"))
    raw = F.coalesce("text", F.lit(""))
    rows = docs.join(labels, F.col("doc_id") == F.col("_l"), "left").select("doc_id", "lang", "source", "q", text.fold(F.col("text")).alias("body"), (F.length(raw) - F.length(F.regexp_replace(raw, "[#*$%&|]", ""))).alias("symbols"))
    words = F.split("body", " ")
    rows = rows.withColumn("n_words", F.size(words)).withColumn("distinct_share", F.size(F.array_distinct(words)) / F.col("n_words"))
    yes = lambda c, n: F.when(c, n).otherwise(0)
    evidence = yes(F.col("q") == 1, 3) + yes(F.col("n_words") >= 100, 2) + yes(F.col("n_words") >= 500, 1) + yes(F.col("distinct_share") >= 0.4, 1) - yes(F.col("symbols") > 20, 2)
    marks = lambda ws: reduce(add, [F.col("body").contains(w).cast("int") for w in ws])
    return rows.select("doc_id", "lang", "source", evidence.cast("long").alias("evidence"), "symbols", "n_words", marks(NOTICES).alias("notices"), marks(INSULTS).alias("insults"))


_SQL_TIER = f"""
SELECT doc_id, lang, source, CASE WHEN symbols > 60 OR n_words < 5 THEN 'EXCLUDE' WHEN evidence >= 5 THEN 'CORE' WHEN evidence >= 3 AND insults = 0 THEN 'PROBABLE' ELSE 'BORDERLINE' END AS tier,
  CASE WHEN symbols > 60 THEN 'symbols' WHEN n_words < 5 THEN 'short' WHEN evidence >= 5 THEN 'strong evidence' WHEN evidence >= 3 AND insults = 0 THEN 'some evidence' ELSE 'weak evidence' END AS reason FROM ({_SQL_EVIDENCE})"""


def _tiers(spark, d):
    answer = lambda tier, why: F.struct(F.lit(tier).alias("tier"), F.lit(why).alias("reason"))
    e = F.col("evidence")
    pick = F.when(F.col("symbols") > 60, answer("EXCLUDE", "symbols")).when(F.col("n_words") < 5, answer("EXCLUDE", "short")).when(e >= 5, answer("CORE", "strong evidence")).when((e >= 3) & (F.col("insults") == 0), answer("PROBABLE", "some evidence")).otherwise(answer("BORDERLINE", "weak evidence"))
    return _evidence(spark, d).select("doc_id", "lang", "source", pick.alias("t")).select("doc_id", "lang", "source", "t.tier", "t.reason")


@query(_SQL_TIER)
def tier_classify(spark, d):
    return _tiers(spark, d)


@query(f"SELECT lang, tier, reason, count(*) AS n FROM ({_SQL_TIER}) GROUP BY ALL")
def tier_distribution(spark, d):
    return _tiers(spark, d).groupBy("lang", "tier", "reason").agg(F.count("*").alias("n"))


@query(f"""
SELECT doc_id, evidence, CASE WHEN symbols > 60 THEN 'LOW_QUALITY' WHEN insults > 0 THEN 'REVIEW' WHEN notices > 0 AND n_words < 60 THEN 'PARATEXT' WHEN notices > 0 THEN 'ADJACENT' ELSE 'SCHOLARLY' END AS role,
  array_to_string(list_filter([CASE WHEN symbols > 60 THEN 'many symbols' END, CASE WHEN insults > 0 THEN 'insults' END, CASE WHEN notices > 0 THEN 'notice' END, CASE WHEN n_words >= 500 THEN 'long' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM ({_SQL_EVIDENCE})""")
def role_classify(spark, d):
    rows = _evidence(spark, d)
    role = F.when(F.col("symbols") > 60, "LOW_QUALITY").when(F.col("insults") > 0, "REVIEW").when((F.col("notices") > 0) & (F.col("n_words") < 60), "PARATEXT").when(F.col("notices") > 0, "ADJACENT").otherwise("SCHOLARLY")
    reasons = F.array_compact(F.array(F.when(F.col("symbols") > 60, "many symbols"), F.when(F.col("insults") > 0, "insults"), F.when(F.col("notices") > 0, "notice"), F.when(F.col("n_words") >= 500, "long")))
    return rows.select("doc_id", "evidence", role.alias("role"), F.array_join(reasons, "; ").alias("reasons"))


@query(f"""
WITH s AS (SELECT doc_id, n_chars, list_distinct(string_split({sql_fold(SQL_TITLE)}, ' ')) AS t, {sql_fold("text")} AS body FROM documents),
q AS (SELECT doc_id, len(list_intersect(['the', 'of', 'and', 'ering'], t)) / 4.0 AS title_cover, CAST(contains(body, 'the') AS INT) + CAST(contains(body, 'ering') AS INT) AS found, len(t) AS n_t, n_chars FROM s)
SELECT doc_id, CAST(greatest(0, least(100, round((0.5 * title_cover + 0.3 * (0.75 * least(1.0, 0.2 + 0.25 * (found - 1)) + 0.25 * least(1.0, 0.5 * (found - 1))) + 0.2 * least(1.0, greatest(0.0, log10(n_chars + 1) / 4)) - (CASE WHEN n_t >= 20 THEN 0.05 ELSE 0.0 END + CASE WHEN n_t >= 14 AND title_cover < 1 THEN 0.10 ELSE 0.0 END)) * 100, 0))) AS INT) AS total FROM q""")
def rank_total(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.array_distinct(text.tokens(text.title_of(F.col("text")), 0)).alias("t"), text.fold(F.col("text")).alias("body"))
    cover = F.size(F.array_intersect(F.array(*map(F.lit, ("the", "of", "and", "ering"))), "t")) / F.lit(4.0)
    found = F.col("body").contains("the").cast("int") + F.col("body").contains("ering").cast("int")
    parts = {"title": cover, "consensus": scoring.consensus(found, found), "impact": scoring.impact(F.col("n_chars"))}
    total = scoring.total(parts, {"title": 0.5, "consensus": 0.3, "impact": 0.2}, scoring.dispersion_penalty(F.size("t"), cover))
    return rows.select("doc_id", total.alias("total"))


@query(f"""
WITH s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(list_filter(string_split({sql_fold(SQL_TITLE)}, ' '), lambda x: length(x) >= 1))) AS t FROM documents),
c AS (SELECT t, min(doc_id) AS id FROM s WHERE len(t) > 0 GROUP BY t)
SELECT x.id AS a, y.id AS b, len(list_intersect(x.t, y.t)) AS shared, len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)) AS total FROM c x JOIN c y ON x.id < y.id
WHERE len(list_intersect(x.t, y.t)) * 100 >= 60 * (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))""")
def title_jaccard_edges(spark, d):
    return graph.jaccard_edges(table(spark, d, "documents"), "doc_id", text.tokens(text.title_of(F.col("text"))), 60)


@query()
def title_lexical_edges(spark, d):
    """The reference's eligibility: at least 12 % with two shared tokens, or 34 % with one."""
    tokens = text.tokens(text.title_of(F.col("text")))
    return graph.token_edges(table(spark, d, "documents"), "doc_id", tokens, topk.Jaccard(0.12, 2, 0.34))


@query(f"""
SELECT doc_id, lpad(sha256(CAST(doc_id AS VARCHAR))[1:2], 2, '0') AS shard, source, lang FROM documents""")
def sha_shards(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.sha_shard(F.col("doc_id").cast("string")).alias("shard"), "source", "lang")


@query("""
SELECT source, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest, count(DISTINCT lang) AS langs, round(avg(CASE WHEN n_chars >= 500 THEN 100.0 ELSE 0.0 END), 4) AS long_percent FROM documents GROUP BY source""")
def source_summary(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.countDistinct("lang").alias("langs"), F.round(F.avg(F.when(F.col("n_chars") >= 500, 100.0).otherwise(0.0)), 4).alias("long_percent"))


@query("""
SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS host, len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS n_links, len(list_distinct(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1))) AS n_distinct_links,
  trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages""")
def html_links(spark, d):
    links = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]*)", 1).alias("host"), F.size(links).cast("long").alias("n_links"), F.size(F.array_distinct(links)).cast("long").alias("n_distinct_links"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("""
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("text_md5"))


@query("""
SELECT host, n, pages, links FROM (SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS host, count(*) AS n, count(DISTINCT url) AS pages, sum(len(regexp_extract_all(html, '<a\\s', 0))) AS links FROM pages GROUP BY 1)""")
def host_summary(spark, d):
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]*)", 1)
    return table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("pages"), F.sum(F.regexp_count("html", F.lit(r"<a\s"))).alias("links"))


@query(f"""
SELECT doc_id FROM documents WHERE contains({sql_fold("text")}, 'the') AND contains({sql_fold("text")}, 'ering') AND lang = 'en' AND n_chars BETWEEN 200 AND 4000""")
def conjunctive_search(spark, d):
    keep = text.contains_all(F.col("text"), F.lit("The ERING")) & (F.col("lang") == "en") & F.col("n_chars").between(200, 4000)
    return table(spark, d, "documents").filter(keep).select("doc_id")


@query("""
SELECT doc_id, '@article{' || doc_id || ',' || chr(10) || '  title = {' || regexp_replace(split_part(text, chr(10), 1), '[{}\\\\]', '', 'g') || '},' || chr(10) || '  source = {' || source || '}' || chr(10) || '}' AS entry FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def bibtex_entries(spark, d):
    from lexmill.sources.snapshots import bibtex

    rows = table(spark, d, "documents").filter("text is not null and source is not null").select("doc_id", text.title_of(F.col("text")).alias("t"), "source")
    return bibtex(rows, "doc_id", {"title": "t", "source": "source"})


@query(f"""
WITH t AS (SELECT doc_id AS id, term, count(*) AS c FROM (SELECT doc_id, unnest(list_filter(string_split({sql_fold(SQL_TITLE)}, ' '), lambda x: length(x) >= 4)) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT id, term, (1 + ln(c)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM t JOIN df USING (term), n),
u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w)
SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 6) AS score, count(*) AS shared FROM u x JOIN u y ON x.term = y.term AND x.id < y.id GROUP BY ALL HAVING sum(x.w * y.w) >= 0.3 AND count(*) >= 2""")
def tfidf_edges(spark, d):
    docs = table(spark, d, "documents")
    edges = graph.cosine_edges(graph.tfidf(docs, "doc_id", text.tokens(text.title_of(F.col("text")), 4)), 0.3)
    return edges.select("a", "b", F.round("score", 6).alias("score"), "shared")


@query()
def tfidf_edges_all(spark, d):
    """The reference's eligibility on documents of all languages: cosine of at least 0.08 with two shared terms."""
    edges = graph.cosine_edges(graph.tfidf(table(spark, d, "documents"), "doc_id", text.tokens(text.title_of(F.col("text")), 4)), 0.08)
    return edges.select("a", "b", F.round("score", 6).alias("score"), "shared")
