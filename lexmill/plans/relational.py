"""Relational queries over the star schema, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

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
SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted,
  round(sum(l_extendedprice) FILTER (WHERE l_quantity >= 25), 2) AS big_price, max(l_tax) FILTER (WHERE l_discount <= 0.05) AS top_tax,
  count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate) AS first_ship
FROM lineitem GROUP BY ALL""")
def cond_agg_stats(spark, d):
    df = table(spark, d, "lineitem")
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("n_discounted"), F.round(F.sum(F.when(F.col("l_quantity") >= 25, F.col("l_extendedprice"))), 2).alias("big_price"),
        F.max(F.when(F.col("l_discount") <= 0.05, F.col("l_tax"))).alias("top_tax"), F.countDistinct("l_suppkey").alias("suppliers"), F.min("l_shipdate").alias("first_ship"),
    )


@query("""
SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, -l_partkey)) AS best_id, max(l_extendedprice) AS best_score FROM lineitem GROUP BY l_orderkey""")
def best_id_by_score(spark, d):
    return R.best_id(table(spark, d, "lineitem"), ["l_orderkey"], "l_partkey", "l_extendedprice")


@query("""
SELECT l_suppkey, arg_max(l_partkey, (l_discount, -l_partkey)) AS best_id, max(l_discount) AS best_score FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey""")
def best_id_filtered(spark, d):
    return R.best_id(table(spark, d, "lineitem"), ["l_suppkey"], "l_partkey", "l_discount", F.col("l_returnflag") == "R")


@query("""
SELECT l_linestatus, CAST(floor(l_extendedprice / 5000.0) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY ALL""")
def score_histogram(spark, d):
    return R.histogram(table(spark, d, "lineitem"), F.col("l_extendedprice"), 5000.0, ["l_linestatus"])


@query("""
SELECT p_brand, round(median(p_retailprice), 4) AS median_price, round(avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END), 6) AS large_share, count(*) AS n FROM part GROUP BY p_brand""")
def median_by_group(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.median("p_retailprice"), 4).alias("median_price"), F.round(F.avg(F.when(F.col("p_size") > 25, 1.0).otherwise(0.0)), 6).alias("large_share"), F.count("*").alias("n"))


@query("""
SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_version(spark, d):
    return R.latest_version(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts", "event_type")


@query("""
SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS order_keys, count(*) AS n FROM orders GROUP BY o_custkey""")
def ordered_list_agg(spark, d):
    listed = R.ordered_list(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", "k")
    return listed.select("o_custkey", F.array_join(F.col("k").cast("array<string>"), ",").alias("order_keys"), F.size("k").cast("long").alias("n"))


@query("""
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript, count(*) AS turns FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id""")
def ordered_string_agg(spark, d):
    rows = table(spark, d, "conversations").filter("text is not null and role is not null")
    said = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.count("*").alias("turns"))
    return said.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("transcript"), "turns")


@query("""
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12""")
def having_groups(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).filter("n >= 12")


@query("""
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)""")
def anti_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o.filter("o_totalprice > 350000"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("""
SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)""")
def semi_join(spark, d):
    p, x = table(spark, d, "part"), table(spark, d, "lineitem").filter("l_quantity >= 49")
    return p.join(x, p.p_partkey == x.l_partkey, "left_semi").select("p_partkey", "p_name")


@query("""
SELECT r_name, n_name, count(s_suppkey) AS suppliers, round(coalesce(sum(s_acctbal), 0), 2) AS balance
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def taxonomy_snowflake(spark, d):
    n, r, s = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    per = s.groupBy("s_nationkey").agg(F.count("*").alias("k"), F.sum("s_acctbal").alias("b"))
    joined = n.join(r, n.n_regionkey == r.r_regionkey, "left").join(per, n.n_nationkey == per.s_nationkey, "left")
    return joined.groupBy("r_name", "n_name").agg(F.sum(F.coalesce("k", F.lit(0))).cast("long").alias("suppliers"), F.round(F.sum(F.coalesce("b", F.lit(0.0))), 2).alias("balance"))


@query("""
SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_customers, (SELECT count(*) FROM lineitem) AS n_lines,
  round((SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) FROM orders), 6) AS filled_share""")
def metrics_row(spark, d):
    o = table(spark, d, "orders").agg(F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 6).alias("filled_share"))
    return o.crossJoin(table(spark, d, "lineitem").agg(F.count("*").alias("n_lines"))).select("n_orders", "n_customers", "n_lines", "filled_share")  # one row each


@query("""
SELECT facet, value, count(*) AS n FROM (
  SELECT 'status' AS facet, o_orderstatus AS value FROM orders UNION ALL SELECT 'priority', o_orderpriority FROM orders UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders) GROUP BY ALL""")
def facet_counts(spark, d):
    return R.facet_counts(table(spark, d, "orders"), {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate")})


@query("""
SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS rank, round(l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share_of_top FROM lineitem""")
def dominance_rank(spark, d):
    by = W.partitionBy("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.rank().over(by.orderBy(F.desc("l_extendedprice"))).cast("long").alias("rank"), F.round(F.col("l_extendedprice") / F.max("l_extendedprice").over(by), 6).alias("share_of_top"))


@query("""
SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, (year(o_orderdate) // 10) * 10 AS decade, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL""")
def timeline_by_month(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").groupBy(F.year(day).cast("long").alias("year"), F.month(day).cast("long").alias("month"), (F.floor(F.year(day) / 10) * 10).cast("long").alias("decade")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40""")
def page_slice(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("""
SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1996 AND o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '1%'""")
def year_range_filter(spark, d):
    return table(spark, d, "orders").filter(F.year("o_orderdate").between(1995, 1996) & F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_orderdate", "o_orderpriority")


@query("""
SELECT key, CASE WHEN a_k IS NULL THEN 'added' WHEN b_k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (
  SELECT coalesce(a.k, b.k) AS key, a.k AS a_k, b.k AS b_k, a.s AS x, b.s AS y, a.m AS u, b.m AS v FROM
  (SELECT o_custkey AS k, count(*) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderdate < DATE '1996-01-01' GROUP BY 1) a FULL JOIN
  (SELECT o_custkey AS k, count(*) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderdate < DATE '1997-01-01' AND o_orderstatus <> 'P' GROUP BY 1) b ON a.k = b.k)
WHERE a_k IS NULL OR b_k IS NULL OR x <> y OR u <> v""")
def snapshot_diff(spark, d):
    o = table(spark, d, "orders")
    shot = lambda df: df.groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("s"), F.max("o_orderkey").alias("m"))
    old, new = o.filter("o_orderdate < timestamp_ntz'1996-01-01'"), o.filter("o_orderdate < timestamp_ntz'1997-01-01' and o_orderstatus <> 'P'")
    return R.snapshot_diff(shot(old), shot(new), "key")


@query("""
SELECT k, source FROM (SELECT c_custkey AS k, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier) QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE source WHEN 'supplier' THEN 0 ELSE 1 END) = 1""")
def union_first_source_wins(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("source"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("source"))
    return c.unionByName(s).groupBy("k").agg(F.max("source").alias("source"))


@query("""
SELECT k FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_extendedprice > 90000)""")
def set_operations(spark, d):
    x = table(spark, d, "lineitem")
    k = lambda cond: x.filter(cond).select(F.col("l_suppkey").alias("k"))
    return k("l_returnflag = 'R'").intersect(k("l_returnflag = 'A'")).subtract(k("l_quantity = 50 and l_extendedprice > 90000"))


@query("""
SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), string_split(p_type, ' '))) AS shared, list_has_any(string_split(lower(p_type), ' '), ['tin', 'steel', 'brass']) AS metal FROM part""")
def array_set_ops(spark, d):
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    metal = F.arrays_overlap(F.split(F.lower("p_type"), " "), F.array(*map(F.lit, ("tin", "steel", "brass"))))
    return table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("shared"), metal.alias("metal"))


@query("""
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem""")
def distinct_pairs(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("""
SELECT l_orderkey, count(DISTINCT l_suppkey) - 1 AS coworkers FROM lineitem GROUP BY l_orderkey""")
def coworker_count(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.countDistinct("l_suppkey") - 1).alias("coworkers"))


@query("""
SELECT c_mktsegment, n_name, count(*) AS n, grouping(c_mktsegment) AS g_segment, grouping(n_name) AS g_nation FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)""")
def rollup_counts(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).rollup("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.grouping("c_mktsegment").cast("long").alias("g_segment"), F.grouping("n_name").cast("long").alias("g_nation"))


@query("""
SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def window_frames(spark, d):
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(by.rowsBetween(-2, 0)), 2).alias("running"), F.lag("o_orderkey").over(by).alias("before"))


@query("""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events""")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), "event_type")


@query("""
SELECT l_orderkey, l_linenumber, o_custkey, p_brand, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate >= o_orderdate AND p_size = 15""")
def four_way_join(spark, d):
    x, o, p, s = (table(spark, d, t) for t in ("lineitem", "orders", "part", "supplier"))
    joined = x.join(p.filter("p_size = 15"), x.l_partkey == p.p_partkey).join(o, (x.l_orderkey == o.o_orderkey) & (x.l_shipdate >= o.o_orderdate)).join(s, x.l_suppkey == s.s_suppkey)
    return joined.select("l_orderkey", "l_linenumber", "o_custkey", "p_brand", "s_name")


@query("""
SELECT c_custkey, coalesce(n_name, 'unknown') AS nation, CASE WHEN total IS NULL THEN 0 ELSE total END AS total, total IS NULL AS idle
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey""")
def left_join_defaults(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("total"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(o, c.c_custkey == o.o_custkey, "left")
    return joined.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("total", F.lit(0)).alias("total"), F.col("total").isNull().alias("idle"))
