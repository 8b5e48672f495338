"""Query surface the workloads use: one whole-table query per
construct, written with the DataFrame API so Catalyst plans it (pushdown,
pruning, semi/anti joins for IN / EXISTS, broadcast of the small sides)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shotweave.plans.registry import register
from shotweave.sources.tables import read_table


def _t(spark, sf, name, *cols):
    df = read_table(spark, sf, name)
    return df.select(*cols) if cols else df


@register("q_project_filter", headline=True, oracle="""
SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders
WHERE (o_orderstatus = 'O' OR o_orderstatus <> 'F') AND NOT (o_totalprice < 1000) AND o_custkey != 7
  AND o_totalprice <= 400000 AND o_totalprice >= 1000 AND o_orderkey > 10""")
def q_project_filter(spark, sf):
    o = _t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    c = F.col
    return o.where(((c("o_orderstatus") == "O") | (c("o_orderstatus") != "F")) & ~(c("o_totalprice") < 1000)
                   & (c("o_custkey") != 7) & (c("o_totalprice") <= 400000) & (c("o_totalprice") >= 1000)
                   & (c("o_orderkey") > 10)).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias(
                       "o_totalprice"))


@register("q_in_exists", oracle="""
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
  AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = customer.c_custkey AND o.o_orderpriority = '1-URGENT')
  AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
def q_in_exists(spark, sf):
    c = _t(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
    o = _t(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    n = _t(spark, sf, "nation", "n_nationkey", "n_regionkey")
    f = o.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("k1"))
    u = o.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("k2"))
    r0 = n.where(F.col("n_regionkey") == 0).select(F.col("n_nationkey").alias("k3"))
    return (c.join(f, c.c_custkey == f.k1, "left_semi").join(u, c.c_custkey == u.k2, "left_semi")
            .join(r0, c.c_nationkey == r0.k3, "left_anti").select("c_custkey", "c_name"))


@register("q_between_like_null", oracle="""
SELECT p_partkey, p_name, p_size FROM part
WHERE p_size BETWEEN 10 AND 20 AND p_name ILIKE '%RED%' AND p_brand IS NOT NULL AND p_type IS NOT NULL""")
def q_between_like_null(spark, sf):
    p = _t(spark, sf, "part", "p_partkey", "p_name", "p_size", "p_brand", "p_type")
    # SQLite LIKE ignores ASCII case, hence ilike
    return p.where(F.col("p_size").between(10, 20) & F.col("p_name").ilike("%RED%")
                   & F.col("p_brand").isNotNull() & F.col("p_type").isNotNull()).select("p_partkey", "p_name", "p_size")


@register("q_inner_join", oracle="""
SELECT o.o_orderkey, c.c_name, n.n_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def q_inner_join(spark, sf):
    o = _t(spark, sf, "orders", "o_orderkey", "o_custkey")
    c = _t(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
    n = _t(spark, sf, "nation", "n_nationkey", "n_name")
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select("o_orderkey", "c_name", "n_name"))


@register("q_outer_joins", oracle="""
SELECT 'left' AS kind, count(*) AS n, count(o.o_orderkey) AS n_matched
  FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT'
UNION ALL
SELECT 'right', count(*), count(c.c_custkey)
  FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING'
UNION ALL
SELECT 'full', count(*), count(s.s_suppkey)
  FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey""")
def q_outer_joins(spark, sf):
    c = _t(spark, sf, "customer", "c_custkey", "c_mktsegment")
    o = _t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    s = _t(spark, sf, "supplier", "s_suppkey")
    left = c.join(o.where(F.col("o_orderpriority") == "1-URGENT"), c.c_custkey == o.o_custkey, "left").agg(
        F.lit("left").alias("kind"), F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("n_matched"))
    cb = c.where(F.col("c_mktsegment") == "BUILDING")
    right = cb.join(o, cb.c_custkey == o.o_custkey, "right").agg(
        F.lit("right").alias("kind"), F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("n_matched"))
    full = s.join(c, s.s_suppkey == c.c_custkey, "full").agg(
        F.lit("full").alias("kind"), F.count(F.lit(1)).alias("n"), F.count("s_suppkey").alias("n_matched"))
    return left.unionByName(right).unionByName(full)


@register("q_cross_join", oracle="""
SELECT r.r_name, count(*) AS n FROM region r CROSS JOIN nation n GROUP BY r.r_name""")
def q_cross_join(spark, sf):
    # CROSS JOIN of two fixed 5- and 25-row dimension tables (the construct itself)
    r = _t(spark, sf, "region", "r_name")
    n = _t(spark, sf, "nation", "n_nationkey")
    return r.crossJoin(F.broadcast(n)).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@register("q_aggregates", oracle="""
SELECT count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
       max(l_discount) AS max_disc, min(l_tax) AS min_tax FROM lineitem""")
def q_aggregates(spark, sf):
    li = _t(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return li.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
                  F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.max("l_discount").alias("max_disc"),
                  F.min("l_tax").alias("min_tax"))


@register("q_group_having", headline=True, oracle="""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""")
def q_group_having(spark, sf):
    li = _t(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount")
    return (li.groupBy("l_returnflag", "l_linestatus")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
            .where(F.col("n") > 10))


@register("q_distinct", oracle="""
SELECT (SELECT count(*) FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders)) AS n_pairs,
       count(DISTINCT o_custkey) AS n_customers FROM orders""")
def q_distinct(spark, sf):
    o = _t(spark, sf, "orders", "o_orderpriority", "o_orderstatus", "o_custkey")
    return o.agg(F.count_distinct("o_orderpriority", "o_orderstatus").alias("n_pairs"),
                 F.count_distinct("o_custkey").alias("n_customers"))


@register("q_order_limit", oracle="""
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC LIMIT 10 OFFSET 5""")
def q_order_limit(spark, sf):
    o = _t(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return (o.orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc()).offset(5).limit(10)
            .select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice")))


@register("q_join_group_order", headline=True, oracle="""
SELECT n.n_name, count(*) AS n_orders FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus = 'O'
GROUP BY n.n_name ORDER BY count(*) DESC""")
def q_join_group_order(spark, sf):
    o = _t(spark, sf, "orders", "o_custkey", "o_orderstatus").where(F.col("o_orderstatus") == "O")
    c = _t(spark, sf, "customer", "c_custkey", "c_nationkey")
    n = _t(spark, sf, "nation", "n_nationkey", "n_name")
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders")).orderBy(F.desc("n_orders")))


@register("q_union", oracle="""
SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def q_union(spark, sf):
    a = _t(spark, sf, "customer", F.col("c_nationkey").alias("k"))
    b = _t(spark, sf, "supplier", F.col("s_nationkey").alias("k"))
    return a.union(b).distinct()


@register("q_union_all", oracle="""
SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)
GROUP BY k""")
def q_union_all(spark, sf):
    a = _t(spark, sf, "customer", F.col("c_nationkey").alias("k"))
    b = _t(spark, sf, "supplier", F.col("s_nationkey").alias("k"))
    return a.unionAll(b).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@register("q_intersect", oracle="""
SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def q_intersect(spark, sf):
    o = _t(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    a = o.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("k"))
    b = o.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("k"))
    return a.intersect(b)


@register("q_except", oracle="""
SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'""")
def q_except(spark, sf):
    a = _t(spark, sf, "customer", F.col("c_custkey").alias("k"))
    o = _t(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    b = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).select(F.col("o_custkey").alias("k"))
    return a.subtract(b)


@register("q_case", oracle="""
SELECT CASE WHEN o_totalprice >= 200000 THEN 'big' WHEN o_totalprice >= 50000 THEN 'mid' ELSE 'small' END AS size_class,
       count(*) AS n FROM orders GROUP BY 1""")
def q_case(spark, sf):
    o = _t(spark, sf, "orders", "o_totalprice")
    cls = (F.when(F.col("o_totalprice") >= 200000, "big").when(F.col("o_totalprice") >= 50000, "mid")
           .otherwise("small"))
    return o.groupBy(cls.alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


@register("q_arithmetic", oracle="""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) // 2 AS half_qty,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_quantity / 3 AS charge
FROM lineitem""")
def q_arithmetic(spark, sf):
    li = _t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    # SQLite integer division truncates: `div`
    return li.select("l_orderkey", "l_linenumber", F.expr("CAST(l_quantity AS BIGINT) div 2").alias("half_qty"),
                     (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
                      - F.col("l_quantity") / 3).alias("charge"))


@register("q_cast_round_substr", oracle="""
SELECT p_partkey, CAST(substr(p_brand, 7) AS INTEGER) AS brand_no, round(p_retailprice, 1) AS price,
       CAST(p_size AS VARCHAR) AS size_text FROM part""")
def q_cast_round_substr(spark, sf):
    p = _t(spark, sf, "part", "p_partkey", "p_brand", "p_retailprice", "p_size")
    return p.select("p_partkey", F.substring("p_brand", 7, 1 << 20).cast("int").alias("brand_no"),
                    F.round("p_retailprice", 1).alias("price"), F.col("p_size").cast("string").alias("size_text"))


@register("q_dates", oracle="""
SELECT strftime(o_orderdate, '%Y') AS yr, count(*) AS n,
       CAST(min(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS INTEGER) AS first_day
FROM orders GROUP BY 1""")
def q_dates(spark, sf):
    o = _t(spark, sf, "orders", "o_orderdate")
    return o.groupBy(F.date_format("o_orderdate", "yyyy").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))).cast("int").alias("first_day"))


# --- a window construct is used by the selectors; keep one coverage query for it
@register("q_window_topk", oracle="""
SELECT o_custkey, o_orderkey, CAST(rk AS INTEGER) AS rk FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk
  FROM orders) WHERE rk <= 2""")
def q_window_topk(spark, sf):
    o = _t(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rk", F.row_number().over(w).cast("int")).where("rk <= 2").select("o_custkey", "o_orderkey", "rk")
