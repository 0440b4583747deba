"""Rules, admission, audits, queues, registries, contracts: governance of a corpus, over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import ids, scoring, text
from lexmill.operators import relational as R
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


@query("""
SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'quarantine' WHEN c_acctbal < -500 THEN 'reject-source' WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 'exclude' WHEN c_acctbal < 1000 THEN 'review' ELSE 'include' END AS admission FROM customer""")
def admission_gate(spark, d):
    bal, seg = F.col("c_acctbal"), F.col("c_mktsegment")
    rules = [("quarantine", bal.isNull()), ("reject-source", bal < -500), ("exclude", (seg == "BUILDING") & (bal < 0)), ("review", bal < 1000)]
    return R.first_rule(table(spark, d, "customer"), rules, "include", "admission").select("c_custkey", "admission")


@query("""
SELECT c_mktsegment, CASE WHEN bool_or(a = 'include') THEN 'include' WHEN bool_or(a = 'exclude') THEN 'exclude' WHEN bool_and(a = 'reject') THEN 'reject' WHEN bool_or(a = 'review') THEN 'review' ELSE 'quarantine' END AS status, c_nationkey
FROM (SELECT c_nationkey, c_mktsegment, CASE WHEN c_acctbal > 9500 THEN 'include' WHEN c_acctbal < -900 THEN 'exclude' WHEN c_acctbal < 0 THEN 'reject' ELSE 'review' END AS a FROM customer) GROUP BY ALL""")
def group_admission(spark, d):
    bal = F.col("c_acctbal")
    one = R.first_rule(table(spark, d, "customer"), [("include", bal > 9500), ("exclude", bal < -900), ("reject", bal < 0)], "review", "a")
    is_ = lambda x: F.col("a") == x
    status = F.when(F.bool_or(is_("include")), "include").when(F.bool_or(is_("exclude")), "exclude").when(F.bool_and(is_("reject")), "reject").when(F.bool_or(is_("review")), "review").otherwise("quarantine")
    return one.groupBy("c_nationkey", "c_mktsegment").agg(status.alias("status"))


# Rules as data: id, priority, segment (null: any), least balance, label.
RULES = [(1, 10, "BUILDING", 5000.0, "build-high"), (2, 10, None, 9000.0, "any-top"), (3, 5, "MACHINERY", None, "machines"), (4, 5, None, 0.0, "in-credit"), (5, 1, "FURNITURE", None, "furniture")]


@query(f"""
WITH rules(rule_id, priority, seg, least, label) AS (VALUES {", ".join(f"({i}, {p}, {'NULL' if s is None else repr(s)}, {'NULL' if b is None else b}, '{x}')" for i, p, s, b, x in RULES)})
SELECT c_custkey, rule_id, label FROM (
  SELECT c_custkey, rule_id, label, row_number() OVER (PARTITION BY c_custkey ORDER BY priority DESC NULLS LAST, rule_id) AS r
  FROM customer LEFT JOIN rules ON (seg IS NULL OR seg = c_mktsegment) AND (least IS NULL OR c_acctbal >= least)) WHERE r = 1""")
def rule_priority_join(spark, d):
    rules = spark.createDataFrame(RULES, "rule_id int, priority int, seg string, least double, label string")
    matches = (F.col("seg").isNull() | (F.col("seg") == F.col("c_mktsegment"))) & (F.col("least").isNull() | (F.col("c_acctbal") >= F.col("least")))
    return R.rule_join(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), rules, matches, "c_custkey", "priority", "rule_id", ["label"])


@query("""
SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS brands, min(p_partkey) AS first_key FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1""")
def audit_title_conflicts(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"), F.min("p_partkey").alias("first_key")).filter("brands > 1")


@query("""
SELECT *, CASE WHEN priority >= 60 THEN 'high' WHEN priority >= 45 THEN 'medium' WHEN priority >= 28 THEN 'low' ELSE 'none' END AS band FROM (
  SELECT p_brand, count(*) AS n, round(least(100.0, least(34.0, 13 * log10(count(*) + 1)) + least(28.0, count(DISTINCT p_type) / 2.0) + least(20.0, avg(p_size)) + CASE WHEN max(p_retailprice) > 2000 THEN 8.0 ELSE 4.0 END), 4) AS priority FROM part GROUP BY p_brand)""")
def curation_priority(spark, d):
    per = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("types"), F.avg("p_size").alias("size"), F.max("p_retailprice").alias("top"))
    score = F.round(scoring.curation_priority(F.col("n"), F.col("types") / 2, F.col("size"), F.when(F.col("top") > 2000, 8.0).otherwise(4.0)), 4)
    return per.select("p_brand", "n", score.alias("priority")).withColumn("band", scoring.curation_band(F.col("priority")))


@query("""
SELECT o_orderstatus AS old, CASE WHEN o_totalprice > 200000 THEN 'F' WHEN o_orderpriority LIKE '5%' THEN 'P' ELSE o_orderstatus END AS new, count(*) AS n FROM orders GROUP BY ALL""")
def transition_matrix(spark, d):
    new = F.when(F.col("o_totalprice") > 200000, "F").when(F.col("o_orderpriority").startswith("5"), "P").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("old"), new.alias("new")).agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey, p_name, coalesce(b, p_brand) AS p_brand FROM part LEFT JOIN (SELECT l_partkey, 'curated-' || max(l_returnflag) AS b FROM lineitem WHERE l_quantity = 50 GROUP BY 1) ON l_partkey = p_partkey""")
def curated_overlay(spark, d):
    curated = table(spark, d, "lineitem").filter("l_quantity = 50").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.concat(F.lit("curated-"), F.max("l_returnflag")).alias("p_brand"))
    return R.overlay(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), curated, "p_partkey", ["p_brand"])


@query("""
SELECT k, source FROM (SELECT o_orderkey AS k, o_orderpriority AS source, o_orderdate >= DATE '1997-01-01' AND o_orderpriority <> '3-MEDIUM' AS is_new FROM orders) t
WHERE is_new OR source NOT IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderpriority <> '3-MEDIUM')""")
def keep_previous_snapshot(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("source"), "o_orderdate")
    fresh = (F.col("o_orderdate") >= F.expr("timestamp_ntz'1997-01-01'")) & (F.col("source") != "3-MEDIUM")
    return R.keep_previous(o.filter(fresh).select("k", "source"), o.filter(~fresh).select("source", "k"), "source").select("k", "source")


@query("""
WITH reg AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
fresh AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT k FROM reg))
SELECT k, id FROM reg UNION ALL SELECT k, (SELECT max(id) FROM reg) + row_number() OVER (ORDER BY md5(CAST(k AS VARCHAR)), k) FROM fresh""")
def stable_id_allocation(spark, d):
    """A registry made from some customers, and the ids of all that have ordered: old ones stay, new ones follow."""
    reg = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    registry = R.allocate_ids(reg, reg.limit(0).select("k", F.lit(0).cast("long").alias("id")), "k", "id", part_keys=500)
    return R.allocate_ids(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), registry, "k", "id", part_keys=500)


@query("""
WITH old AS (SELECT o_orderkey AS k, o_orderpriority AS g, o_comment AS c FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS o_comment FROM orders) WHERE o_orderkey % 4 > 0),
new AS (SELECT o_orderkey - CASE WHEN o_orderkey % 640 = 1 THEN 1 ELSE 0 END AS k, o_orderpriority AS g, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS c FROM orders WHERE o_orderpriority <> '3-MEDIUM' AND (o_orderpriority <> '2-HIGH' OR o_orderkey % 2 = 0)),
w AS (SELECT g, count(*) AS was FROM old GROUP BY g), n AS (SELECT g, count(*) AS now FROM new GROUP BY g), b AS (SELECT w.g, was, coalesce(now, 0) AS now FROM w LEFT JOIN n USING (g))
SELECT 'repeated key' AS rule, CAST(k AS VARCHAR) AS subject, count(*) AS n FROM new GROUP BY k HAVING count(*) > 1
UNION ALL SELECT 'missing field', 'c', count(*) FILTER (WHERE c IS NULL OR trim(c) = '') FROM new HAVING count(*) FILTER (WHERE c IS NULL OR trim(c) = '') > 0
UNION ALL SELECT 'shrunk', g, now - was FROM b WHERE now * 100 < was * 90
UNION ALL SELECT 'grown', g, now - was FROM b WHERE now * 100 > was * 130""")
def snapshot_problems(spark, d):
    """What forbids publishing a snapshot of orders after an older one."""
    o = table(spark, d, "orders").withColumn("c", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")))
    old = o.filter("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("g"), "c")
    new = o.filter("o_orderpriority <> '3-MEDIUM' and (o_orderpriority <> '2-HIGH' or o_orderkey % 2 = 0)").select((F.col("o_orderkey") - F.when(F.col("o_orderkey") % 640 == 1, 1).otherwise(0)).alias("k"), F.col("o_orderpriority").alias("g"), "c")
    return R.snapshot_problems(new, old, "k", ["k", "c"], F.col("g"), grow=30)


@query("""
WITH h AS (SELECT p_name AS core, p_brand AS author, count(*) AS holdings FROM part WHERE p_size <= 25 GROUP BY ALL)
SELECT p_partkey, coalesce(holdings, 0) AS holdings, CASE WHEN holdings = 1 THEN 'resolved' WHEN holdings > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM part LEFT JOIN h ON core = p_name AND author = p_brand WHERE p_size > 25""")
def holdings_resolution(spark, d):
    p = table(spark, d, "part")
    held = p.filter("p_size <= 25").groupBy(F.col("p_name").alias("core"), F.col("p_brand").alias("author")).agg(F.count("*").alias("holdings"))
    joined = p.filter("p_size > 25").join(held, (F.col("core") == F.col("p_name")) & (F.col("author") == F.col("p_brand")), "left")
    status = F.when(F.col("holdings") == 1, "resolved").when(F.col("holdings") > 1, "ambiguous").otherwise("unresolved")
    return joined.select("p_partkey", F.coalesce("holdings", F.lit(0)).alias("holdings"), status.alias("status"))


@query("""
SELECT 'line has order' AS rule, count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_violations FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'discount in range', count(*), count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.1, FALSE)) FROM lineitem
UNION ALL SELECT 'shipped after 1995', count(*), count(*) FILTER (WHERE NOT coalesce(l_shipdate >= DATE '1995-06-01', FALSE)) FROM lineitem
UNION ALL SELECT 'order key unique', count(*), count(*) FILTER (WHERE n > 1) FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1)""")
def contracts_violations(spark, d):
    x, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return R.violations({
        "line has order": (x.join(o.select("o_orderkey"), x.l_orderkey == o.o_orderkey, "left"), F.col("o_orderkey").isNotNull()),
        "discount in range": (x, F.col("l_discount").between(0, 0.1)),
        "shipped after 1995": (x, F.col("l_shipdate") >= F.expr("timestamp_ntz'1995-06-01'")),
        "order key unique": (o.groupBy("o_orderkey").count(), F.col("count") == 1),
    })


@query("""
SELECT p_partkey, string_agg(c, ',' ORDER BY s DESC, o) AS categories FROM (
  SELECT p_partkey, c, s, o, row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, o) AS r FROM (
    SELECT p_partkey, 'metal' AS c, 1 AS o, 8 * CAST(p_type LIKE '%STEEL%' AS INT) + 4 * CAST(p_type LIKE '%TIN%' AS INT) AS s FROM part UNION ALL
    SELECT p_partkey, 'large', 2, 4 * CAST(p_size > 30 AS INT) + 2 * CAST(p_type LIKE '%LARGE%' AS INT) FROM part UNION ALL
    SELECT p_partkey, 'dear', 3, 6 * CAST(p_retailprice > 1200 AS INT) FROM part UNION ALL
    SELECT p_partkey, 'general', 4, 1 FROM part) WHERE s > 0) WHERE r <= 2 GROUP BY p_partkey""")
def scored_categories(spark, d):
    hit = lambda cond, n: F.when(cond, n).otherwise(0)
    kind = F.col("p_type")
    rules = [("metal", hit(kind.contains("STEEL"), 8) + hit(kind.contains("TIN"), 4)), ("large", hit(F.col("p_size") > 30, 4) + hit(kind.contains("LARGE"), 2)), ("dear", hit(F.col("p_retailprice") > 1200, 6)), ("general", F.lit(1))]
    scored = F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("o"), F.lit(c).alias("c")) for i, (c, s) in enumerate(rules)])
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["s"] < 0)), 1, 2)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(best, lambda x: x["c"]), ",").alias("categories"))


@query("""
SELECT *, CASE WHEN CAST(left(value, 4) AS INT) > 1997 THEN 'suspicious' ELSE 'valid' END AS quality FROM (SELECT o_orderkey, y || '-' || m AS value, 'month' AS precision FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m FROM orders) WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), 'day' FROM orders WHERE o_orderkey % 3 = 1
UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y'), 'year' FROM orders WHERE o_orderkey % 3 = 2)""")
def partial_dates(spark, d):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format(day, "yyyy-MM-00")).when(k == 1, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy"))
    found = ids.partial_date(raw, 1996)
    return table(spark, d, "orders").select("o_orderkey", found["value"].alias("value"), found["precision"].alias("precision"), found["quality"].alias("quality"))


@query("""
SELECT s_suppkey, '10.1234/' || lower(replace(s_name, '#', '.')) AS doi, 'title:' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) || '|' || CAST(s_nationkey AS VARCHAR) || '|' AS key FROM supplier""")
def identifiers(spark, d):
    raw = F.concat(F.lit(" HTTPS://doi.org/10.1234/"), F.replace(F.col("s_name"), F.lit("#"), F.lit(".")))
    key = ids.identity_key(F.lit(None).cast("string"), F.lit("x"), F.lit(None).cast("string"), F.col("s_name"), F.col("s_nationkey"), F.lit(""))
    return table(spark, d, "supplier").select("s_suppkey", ids.doi(raw).alias("doi"), key.alias("key"))


@query("""
SELECT p_partkey, round(CAST(doi_w + brand_w + size_w + price_w AS DOUBLE), 6) AS completeness FROM (SELECT p_partkey, CASE WHEN p_name IS NOT NULL THEN 0.35 ELSE 0.0 END AS doi_w, CASE WHEN p_brand LIKE '%1%' THEN 0.2 ELSE 0.0 END AS brand_w, CASE WHEN p_size > 10 THEN 0.1 ELSE 0.0 END AS size_w, CASE WHEN p_retailprice > 1000 THEN 0.2 ELSE 0.0 END AS price_w FROM part) ORDER BY completeness DESC, p_partkey LIMIT 100""")
def completeness_top(spark, d):
    score = scoring.completeness({"name": (0.35, F.col("p_name").isNotNull()), "brand": (0.2, F.col("p_brand").contains("1")), "size": (0.1, F.col("p_size") > 10), "price": (0.2, F.col("p_retailprice") > 1000)})
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("completeness")).orderBy(F.desc("completeness"), "p_partkey").limit(100)


@query("""
SELECT p_partkey, lower(replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ', '-')) AS slug, 'https://catalogue.example.org/item?q=' || replace(p_name, ' ', '+') AS url FROM part""")
def url_builder(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), F.concat(F.lit("https://catalogue.example.org/item?q="), F.url_encode("p_name")).alias("url"))
