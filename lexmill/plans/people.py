"""People and links: aliases, anchors, resolution, ledgers, co-membership, edge selection, over the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import hashing, text
from lexmill.operators import graph, resolve
from lexmill.plans.inputs import relation
from lexmill.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


SQL_FOLD = "trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"
SQL_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, octet_length(encode({x})) + 1), lambda i: CAST(('0x' || substr(hex(encode({x})), 2 * i - 1, 2)) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"


def _fnv_sql(x: str) -> str:
    return SQL_FNV.format(x=x)


@query(f"""
WITH n AS (SELECT c_custkey AS id, string_split({SQL_FOLD.format(x="c_name")}, ' ') AS t FROM customer),
a AS (SELECT id, 'full' AS kind, array_to_string(list_sort(list_distinct(t)), ' ') AS signature FROM n UNION ALL SELECT id, 'first_last', t[1] || ' ' || t[-1] FROM n UNION ALL SELECT id, 'initial', t[1][1:1] || ' ' || t[-1] FROM n UNION ALL SELECT id, 'last', t[-1] FROM n)
SELECT DISTINCT signature, kind, id, {_fnv_sql("signature")} % 1024 AS bucket FROM a WHERE signature <> ''""")
def alias_signatures(spark, d):
    return resolve.alias_index(table(spark, d, "customer"), "c_custkey", "c_name")


@query(f"SELECT p_partkey, {_fnv_sql('p_name')} AS fnv FROM part")
def fnv_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", hashing.fnv1a32(F.col("p_name")).alias("fnv"))


@query("""
SELECT key AS anchor_key, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS representative, min(c_custkey) AS least_id, count(*) AS members FROM (
  SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'anchor-' || c_nationkey || '-' || c_mktsegment ELSE 'id:' || c_custkey END AS key FROM customer) GROUP BY key""")
def entity_group_by_anchor(spark, d):
    anchor = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("anchor-"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment")))
    return resolve.group_by_anchor(table(spark, d, "customer").withColumn("anchor", anchor), "c_custkey", "anchor", "c_acctbal")


@query("""
SELECT user_id, count(DISTINCT json_extract_string(props, '$.k')) AS anchors FROM events WHERE event_type = 'signup' AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY user_id HAVING count(DISTINCT json_extract_string(props, '$.k')) > 1""")
def anchor_conflicts(spark, d):
    seen = table(spark, d, "events").filter("event_type = 'signup'").select("user_id", F.get_json_object("props", "$.k").alias("k"))
    return resolve.anchor_conflicts(seen, "user_id", "k")


_SQL_CANDIDATES = """
SELECT s_suppkey AS mention, c_custkey AS authority, CASE WHEN abs(c_acctbal - s_acctbal) > 4000 THEN 'rejected' WHEN c_custkey % 100 = s_suppkey % 100 AND c_mktsegment = 'BUILDING' THEN 'confirmed'
  WHEN abs(c_acctbal - s_acctbal) < 300 AND c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'probable' ELSE 'unresolved' END AS status
FROM supplier JOIN customer ON s_nationkey = c_nationkey AND floor(s_acctbal / 5000) = floor(c_acctbal / 5000)"""


@query(f"""
WITH c AS ({_SQL_CANDIDATES}), p AS (SELECT mention, count(*) FILTER (WHERE status = 'confirmed') AS c, count(*) FILTER (WHERE status = 'probable') AS p, count(*) FILTER (WHERE status = 'unresolved') AS u,
  min(authority) FILTER (WHERE status = 'confirmed') AS ca, min(authority) FILTER (WHERE status = 'probable') AS pa FROM c GROUP BY mention)
SELECT mention, CASE WHEN c = 1 THEN 'confirmed' WHEN c > 1 THEN 'ambiguous' WHEN p = 1 THEN 'probable' WHEN p + u > 1 THEN 'ambiguous' WHEN u = 1 THEN 'unresolved' ELSE 'rejected' END AS decision, CASE WHEN c = 1 THEN ca WHEN c = 0 AND p = 1 THEN pa END AS authority FROM p""")
def resolve_mentions(spark, d):
    """Candidates by two equal block keys, counted by status, one decision per mention.

    A status depends on equal keys and on a difference, so candidates are counted within a reach and never paired.
    """
    side = lambda t, x: table(spark, d, t).withColumns({"value": F.col(f"{x}_acctbal"), "nation": F.col(f"{x}_nationkey"), "half": F.floor(F.col(f"{x}_acctbal") / 5000)}).filter("nation is not null and half is not null")
    m = side("supplier", "s").select(F.col("s_suppkey").alias("mention"), "value", "nation", "half", (F.col("s_suppkey") % 100).alias("shared"))
    a = side("customer", "c").select(F.col("c_custkey").alias("authority"), "value", "nation", "half", (F.col("c_custkey") % 100).alias("shared"), F.col("c_mktsegment").alias("segment"))
    block = ["nation", "half"]
    named = lambda rows, n, ids="_": rows.withColumnsRenamed({"n": n, "ids": ids})
    kept = named(resolve.within(m, a, block, 4000), "kept").drop("_")
    confirmed = named(resolve.within(m, a.filter("segment = 'BUILDING'"), [*block, "shared"], 4000), "c", "ca")
    probable = named(resolve.within(m, a.filter("segment in ('MACHINERY', 'FURNITURE')"), block, 300, closed=False), "p", "pa")
    met = m.join(a.select(*block).distinct(), block, "left_semi").select("mention").distinct()
    per = met.join(kept, "mention", "left").join(confirmed, "mention", "left").join(probable, "mention", "left").fillna(0, ["kept", "c", "p"])
    c, p = F.col("c"), F.col("p")
    found = resolve.decision(c, p, F.col("kept") - c - p)
    return per.select("mention", found.alias("decision"), F.when(c == 1, F.col("ca")).when((c == 0) & (p == 1), F.col("pa")).alias("authority"))


_SQL_SIDE = """
SELECT {id} AS id, concat('Ana', CASE WHEN {id} % 4 = 0 THEN ' M' ELSE ' Maria' END, ' Soto', CAST({id} % 60 AS STRING)) AS name, CASE WHEN {id} % 3 = 0 THEN concat('o', CAST({id} % 45 AS STRING)) END AS anchor, CASE WHEN {id} % 5 > 0 THEN concat('u', CAST({nation} AS STRING)) END AS affiliation,
  CAST({id} % 4 AS STRING) AS f1, CAST({id} % 7 AS STRING) AS f2, {id} % 2 = 0 AS two, CAST({id} % 9 AS STRING) AS w1, CAST({id} % 11 AS STRING) AS w2 FROM {table}"""
_MENTION, _AUTHORITY = _SQL_SIDE.format(id="s_suppkey", nation="s_nationkey", table="supplier"), _SQL_SIDE.format(id="c_custkey", nation="c_nationkey", table="customer")


def _sql_tokens(x: str) -> str:
    return f"string_split(lower({x}), ' ')"


def _sql_named(x: str, y: str) -> str:
    a, b = _sql_tokens(x), _sql_tokens(y)
    shared, least = f"len(list_intersect({a}, {b}))", f"least(len(list_distinct({a})), len(list_distinct({b})))"
    initials = f"len({a}) = len({b}) AND len(list_filter(list_zip({a}, {b}), lambda p: NOT (starts_with(p[1], p[2]) OR starts_with(p[2], p[1])))) = 0"
    return f"(lower({x}) = lower({y}) OR list_sort({a}) = list_sort({b}) OR ({initials}) OR ({least} >= 2 AND {shared} = {least}))"


@query(f"""
WITH m AS ({_MENTION}), c AS ({_AUTHORITY}), p AS (SELECT m.id AS mention, c.id AS authority, coalesce(CAST(m.anchor = c.anchor AS INT), 0) AS A, coalesce(CAST(m.affiliation = c.affiliation AS INT), 0) + CAST(n >= 2 AS INT) AS B, CAST(n = 1 AS INT) AS C,
  CAST({_sql_named('m.name', 'c.name')} AS INT) AS D, coalesce(CAST(m.anchor <> c.anchor AS INT), 0) + CAST(m.two AND c.two AND m.f1 = c.f1 AND m.f2 <> c.f2 AS INT) AS veto FROM (SELECT m.*, c, len(list_intersect(['a' || m.w1, 'b' || m.w2], ['a' || c.w1, 'b' || c.w2])) AS n FROM m JOIN c ON m.anchor = c.anchor OR split_part(m.name, ' ', 3) = split_part(c.name, ' ', 3)) m)
SELECT mention, authority, A AS a, B AS b, C AS c, D AS d, veto, CASE WHEN veto > 0 THEN 'rejected' WHEN A > 0 THEN 'confirmed' WHEN B > 0 AND C + D > 0 THEN 'probable' ELSE 'unresolved' END AS status FROM p""")
def mention_evidence(spark, d):
    """Evidence by class for every blocked pair of a mention and an authority."""
    def side(sql):
        family = F.when(F.col("two"), F.array("f1", "f2")).otherwise(F.array("f1"))
        keys = F.array(F.concat(F.lit("o:"), "anchor"), F.concat(F.lit("n:"), F.element_at(F.split("name", " "), -1)))
        return relation(spark, d, sql).select("id", "name", "anchor", "affiliation", family.alias("family"), F.array(F.concat(F.lit("a"), "w1"), F.concat(F.lit("b"), "w2")).alias("coworkers"), F.array_compact(keys).alias("keys"))

    pairs = resolve.blocked(side(_MENTION), side(_AUTHORITY), "keys")
    found = resolve.evidence()
    scored = pairs.select(F.col("m.id").alias("mention"), F.col("c.id").alias("authority"), *[v.alias(k.lower()) for k, v in found.items()])
    return scored.withColumn("status", resolve.evidence_status(*[F.col(k) for k in ("a", "b", "c", "d", "veto")]))


@query("""
WITH l AS (SELECT event_id AS id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN event_id - 1 END AS supersedes, ts FROM events)
SELECT user_id, event_type, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, id DESC) AS r FROM l WHERE id NOT IN (SELECT supersedes FROM l WHERE supersedes IS NOT NULL)) WHERE r = 1""")
def active_decisions(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.when(F.col("event_id") % 7 == 0, F.col("event_id") - 1).alias("supersedes"), "ts")
    return resolve.active_decisions(e, ["user_id", "event_type"], "id", "supersedes", "ts").select("user_id", "event_type", "id")


@query("""
WITH c AS (SELECT c_nationkey AS k, o_custkey AS id, count(*) AS works FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT k, id, works, works >= 10 AND works >= 5 * coalesce(next, 0) AS dominant FROM (SELECT *, lead(works) OVER (PARTITION BY k ORDER BY works DESC, id) AS next, row_number() OVER (PARTITION BY k ORDER BY works DESC, id) AS r FROM c) WHERE r = 1""")
def dominant_candidate(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    works = o.groupBy("o_custkey").agg(F.count("*").alias("works")).join(c, F.col("o_custkey") == c.c_custkey).select(F.col("c_nationkey").alias("k"), F.col("o_custkey").alias("id"), "works")
    return resolve.dominant(works, "k", "id", "works")


@query("""
WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL""")
def pair_cooccurrence(spark, d):
    return graph.co_members(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("""
SELECT o_custkey, o_orderkey AS a, lead(o_orderkey) OVER w AS b, date_diff('day', CAST(o_orderdate AS DATE), CAST(lead(o_orderdate) OVER w AS DATE)) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) QUALIFY b IS NOT NULL""")
def same_owner_edges(spark, d):
    """Each work with its owner's next one: a chain says which works share an owner without a square of pairs."""
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(by).alias("b"), F.datediff(F.lead("o_orderdate").over(by), F.col("o_orderdate")).cast("long").alias("days"))
    return rows.filter("b is not null")


@query("""
WITH r AS (SELECT o_custkey AS person, o_orderkey AS work, 'owner' AS role, o_orderdate AS d FROM orders UNION ALL SELECT DISTINCT l_suppkey, l_orderkey, 'supplier', o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT person, role, count(DISTINCT work) AS works, min(year(d)) AS first_year, max(year(d)) AS last_year FROM r GROUP BY ALL""")
def people_index(spark, d):
    o, x = table(spark, d, "orders"), table(spark, d, "lineitem")
    owners = o.select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("work"), F.lit("owner").alias("role"), F.col("o_orderdate").alias("d"))
    suppliers = x.select("l_suppkey", "l_orderkey").distinct().join(o, F.col("l_orderkey") == o.o_orderkey).select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("work"), F.lit("supplier").alias("role"), F.col("o_orderdate").alias("d"))
    return owners.unionByName(suppliers).groupBy("person", "role").agg(F.countDistinct("work").alias("works"), F.min(F.year("d")).cast("long").alias("first_year"), F.max(F.year("d")).cast("long").alias("last_year"))


_SQL_EDGES = "WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), e AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, CAST(count(*) AS DOUBLE) AS score FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL)"


def _edges(spark, d):
    return graph.co_members(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey").select("a", "b", F.col("n").cast("double").alias("score"))


@query(f"""
{_SQL_EDGES}, u AS (SELECT a AS n, b AS o, score FROM e UNION ALL SELECT b, a, score FROM e)
SELECT DISTINCT least(n, o) AS a, greatest(n, o) AS b, score FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, o) AS r FROM u) WHERE r <= 3""")
def union_topk_edges(spark, d):
    return graph.top_k_edges(_edges(spark, d), 3)


@query(f"""
{_SQL_EDGES}, k AS (SELECT a, b, score, 'strong' AS kind, 3 AS p FROM e WHERE score >= 8 UNION ALL SELECT a, b, score, 'common' , 2 FROM e WHERE score >= 4 UNION ALL SELECT a, b, score, 'any', 1 FROM e)
SELECT a, b, arg_max(kind, (p, score)) AS kind, arg_max(score, (p, score)) AS score FROM k GROUP BY a, b""")
def edge_by_priority(spark, d):
    e = _edges(spark, d)
    kind = F.array_compact(F.array(F.when(F.col("score") >= 8, "strong"), F.when(F.col("score") >= 4, "common"), F.lit("any")))
    kinds = e.withColumn("kind", F.explode(kind))  # one pass over the edges, not one a kind
    return graph.best_edge_per_pair(kinds, F.when(F.col("kind") == "strong", 3).when(F.col("kind") == "common", 2).otherwise(1))


@query(f"""
{_SQL_EDGES} SELECT a, b, score FROM e JOIN supplier x ON a = x.s_suppkey JOIN supplier y ON b = y.s_suppkey WHERE x.s_acctbal > 0 AND y.s_acctbal > 0""")
def induced_subgraph(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    return graph.induced(nodes, _edges(spark, d), F.col("s_acctbal") > 0)[1].select("a", "b", "score")


@query()
def degree_capped_edges(spark, d):
    """Per nation of the first end, greedily with at most four edges a node; tested against a plain loop."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("graph"))
    return graph.degree_capped(_edges(spark, d).join(s, "a").select("graph", "a", "b", "score"), "graph", 4, 200)


@query("""
SELECT n, sum(score) AS weight, count(*) AS degree FROM (WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS n, y.l_suppkey AS o, CAST(count(*) AS DOUBLE) AS score FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey GROUP BY ALL) GROUP BY n""")
def node_degrees(spark, d):
    return graph.both_ends(_edges(spark, d)).groupBy("n").agg(F.sum("score").alias("weight"), F.count("*").alias("degree"))


@query(f"""
SELECT s_suppkey, {SQL_FOLD.format(x="s_name")} AS folded, array_to_string(list_sort(list_distinct(string_split({SQL_FOLD.format(x="s_name")}, ' '))), ' ') AS signature FROM supplier""")
def name_signatures(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.fold(F.col("s_name")).alias("folded"), text.name_signature(F.col("s_name")).alias("signature"))
