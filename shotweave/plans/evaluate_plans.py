"""Registered evaluation / repair queries.

Candidate results come from `orders` (FIXTURES): task = o_custkey % 500, candidate
= order priority, row = (o_orderstatus, 'x'), columns swapped for every second
candidate (even priority digit)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shotweave.operators import evaluate as ev
from shotweave.plans.oracle_sql import CATALOG, EXEMPLARS
from shotweave.plans.registry import register
from shotweave.sources.catalog import driver_columns
from shotweave.sources.tables import exemplars, read_table


def _results(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    swapped = (F.substring("o_orderpriority", 1, 1).cast("int") % 2) == 0
    vals = F.when(swapped, F.array(F.lit("x"), F.col("o_orderstatus"))).otherwise(
        F.array(F.col("o_orderstatus"), F.lit("x")))
    return o.select((F.col("o_custkey") % 500).cast("long").alias("task_id"), F.col("o_orderpriority").alias("cand_id"),
                    F.col("o_orderkey").alias("row_no"), vals.alias("vals"))


_RES = """res AS (SELECT CAST(o_custkey % 500 AS BIGINT) AS task_id, o_orderpriority AS cand_id,
         CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 2 = 0 THEN ['x', o_orderstatus]
              ELSE [o_orderstatus, 'x'] END AS vals FROM orders),
cands AS (SELECT DISTINCT task_id, cand_id FROM res),
pairs AS (SELECT a.task_id, a.cand_id AS cand_a, b.cand_id AS cand_b FROM cands a JOIN cands b
          ON a.task_id = b.task_id AND a.cand_id < b.cand_id),
cnt AS (SELECT task_id, cand_id, vals, count(*) AS n FROM res GROUP BY ALL),
tot AS (SELECT task_id, cand_id, sum(n) AS rws, count(*) AS d FROM cnt GROUP BY ALL),
swp AS (SELECT task_id, cand_id, [vals[2], vals[1]] AS vals, n FROM cnt),
m1 AS (SELECT p.task_id, p.cand_a, p.cand_b, count(*) AS m FROM pairs p
       JOIN cnt a ON a.task_id = p.task_id AND a.cand_id = p.cand_a
       JOIN cnt b ON b.task_id = p.task_id AND b.cand_id = p.cand_b AND a.vals = b.vals AND a.n = b.n GROUP BY ALL),
m2 AS (SELECT p.task_id, p.cand_a, p.cand_b, count(*) AS m FROM pairs p
       JOIN cnt a ON a.task_id = p.task_id AND a.cand_id = p.cand_a
       JOIN swp b ON b.task_id = p.task_id AND b.cand_id = p.cand_b AND a.vals = b.vals AND a.n = b.n GROUP BY ALL),
eq AS (SELECT p.task_id, p.cand_a, p.cand_b,
         coalesce(ta.rws = tb.rws AND ta.d = tb.d AND m1.m = ta.d, FALSE) AS same_order,
         coalesce(ta.rws = tb.rws AND ta.d = tb.d AND (m1.m = ta.d OR m2.m = ta.d), FALSE) AS equal
       FROM pairs p JOIN tot ta ON ta.task_id = p.task_id AND ta.cand_id = p.cand_a
       JOIN tot tb ON tb.task_id = p.task_id AND tb.cand_id = p.cand_b
       LEFT JOIN m1 ON m1.task_id = p.task_id AND m1.cand_a = p.cand_a AND m1.cand_b = p.cand_b
       LEFT JOIN m2 ON m2.task_id = p.task_id AND m2.cand_a = p.cand_a AND m2.cand_b = p.cand_b)"""


@register("result_multiset_equal", oracle=f"WITH {_RES}\nSELECT task_id, cand_a, cand_b, same_order AS equal FROM eq")
def q_result_multiset_equal(spark, sf):
    return ev.result_multiset_equal(_results(spark, sf))


@register("result_equal", oracle=f"WITH {_RES}\nSELECT task_id, cand_a, cand_b, equal FROM eq")
def q_result_equal(spark, sf):
    return ev.result_equal(_results(spark, sf))


@register("result_quick_reject", oracle=f"""WITH {_RES},
s AS (SELECT DISTINCT task_id, cand_id, list_sort(vals) AS sk FROM res),
k AS (SELECT task_id, cand_id, count(*) AS k FROM s GROUP BY ALL),
c AS (SELECT p.task_id, p.cand_a, p.cand_b, count(*) AS common FROM pairs p
      JOIN s a ON a.task_id = p.task_id AND a.cand_id = p.cand_a
      JOIN s b ON b.task_id = p.task_id AND b.cand_id = p.cand_b AND a.sk = b.sk GROUP BY ALL)
SELECT p.task_id, p.cand_a, p.cand_b, ka.k = kb.k AND coalesce(c.common, 0) = ka.k AS passes
FROM pairs p JOIN k ka ON ka.task_id = p.task_id AND ka.cand_id = p.cand_a
JOIN k kb ON kb.task_id = p.task_id AND kb.cand_id = p.cand_b
LEFT JOIN c ON c.task_id = p.task_id AND c.cand_a = p.cand_a AND c.cand_b = p.cand_b""")
def q_result_quick_reject(spark, sf):
    return ev.result_quick_reject(_results(spark, sf))


@register("result_column_candidates", oracle=f"""WITH {_RES},
cv AS (SELECT DISTINCT task_id, cand_id, CAST(i - 1 AS INTEGER) AS col, vals[i] AS v
       FROM (SELECT task_id, cand_id, vals, generate_subscripts(vals, 1) AS i FROM res)),
cols AS (SELECT DISTINCT task_id, cand_id, col FROM cv),
grid AS (SELECT p.task_id, p.cand_a, p.cand_b, a.col AS col_a, b.col AS col_b FROM pairs p
         JOIN cols a ON a.task_id = p.task_id AND a.cand_id = p.cand_a
         JOIN cols b ON b.task_id = p.task_id AND b.cand_id = p.cand_b)
SELECT g.task_id, g.cand_a, g.cand_b, g.col_a, g.col_b FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM cv b WHERE b.task_id = g.task_id AND b.cand_id = g.cand_b AND b.col = g.col_b
                  AND NOT EXISTS (SELECT 1 FROM cv a WHERE a.task_id = g.task_id AND a.cand_id = g.cand_a
                                  AND a.col = g.col_a AND a.v IS NOT DISTINCT FROM b.v))""")
def q_result_column_candidates(spark, sf):
    return ev.result_column_candidates(_results(spark, sf))


_VOTE = f"""WITH {_RES},
cn AS (SELECT task_id, cand_id, CAST(dense_rank() OVER (PARTITION BY task_id ORDER BY cand_id) AS INTEGER) AS no FROM cands),
lead AS (SELECT c.task_id, c.cand_id, c.no, least(c.no, coalesce(min(a.no), c.no)) AS ld FROM cn c
         LEFT JOIN eq ON eq.task_id = c.task_id AND eq.cand_b = c.cand_id AND eq.equal
         LEFT JOIN cn a ON a.task_id = eq.task_id AND a.cand_id = eq.cand_a GROUP BY c.task_id, c.cand_id, c.no),
grp AS (SELECT task_id, ld, count(*) AS size FROM lead GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY size DESC, ld) AS r FROM grp)"""


@register("vote_by_result", oracle=_VOTE + """
SELECT b.task_id, c.cand_id AS chosen, b.size AS group_size FROM best b JOIN cn c ON c.task_id = b.task_id AND c.no = b.ld
WHERE b.r = 1""")
def q_vote_by_result(spark, sf):
    res = _results(spark, sf)
    cands = res.select("task_id", "cand_id").distinct().withColumn(
        "cand_no", F.dense_rank().over(Window.partitionBy("task_id").orderBy("cand_id")).cast("int")).withColumn(
        "runnable", F.lit(True))
    return ev.vote_by_result(res, cands)


@register("execution_accuracy", oracle=f"""WITH {_RES},
gold AS (SELECT DISTINCT task_id FROM res WHERE cand_id = '1-URGENT')
SELECT '2-HIGH' AS pred, count(*) AS n_tasks,
       round(avg(CASE WHEN coalesce(eq.equal, FALSE) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM gold g LEFT JOIN eq ON eq.task_id = g.task_id AND eq.cand_a = '1-URGENT' AND eq.cand_b = '2-HIGH'""")
def q_execution_accuracy(spark, sf):
    return ev.execution_accuracy(_results(spark, sf), pred="2-HIGH", gold="1-URGENT")


# Wider and less tidy results: seven tagged columns turned by the priority's digit, NULLs, numbers written two ways,
# and candidates that lose all their rows (every candidate is listed, with or without rows).
def _wide(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    turn = F.substring("o_orderpriority", 1, 1).cast("int")
    number = F.when(turn % 2 == 0, F.lit("1.0")).otherwise("1")
    tagged = F.array(F.concat(F.lit("a"), "o_orderstatus"), F.when(F.col("o_orderstatus") != "P", "b"), number, F.lit("d"),
                     F.concat(F.lit("e"), (F.col("o_custkey") % 3).cast("string")), F.lit(None).cast("string"), F.lit("2.50"))
    vals = F.concat(F.slice(tagged, turn + 1, 7 - turn), F.slice(tagged, F.lit(1), turn))
    task = (F.col("o_custkey") % 40).cast("long")
    listed = o.select(task.alias("task_id"), F.col("o_orderpriority").alias("cand_id")).distinct()
    rows = o.where(task % 7 != turn).select(task.alias("task_id"), F.col("o_orderpriority").alias("cand_id"), F.col("o_orderkey").alias("row_no"),
                                            ev.normalise_values(vals).alias("vals"))
    return rows, listed


_WIDE = """w0 AS (SELECT *, CAST(o_custkey % 40 AS BIGINT) AS task_id, o_orderpriority AS cand_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS turn FROM orders),
listed AS (SELECT DISTINCT task_id, cand_id FROM w0),
wide AS (SELECT task_id, cand_id, concat('a', o_orderstatus, '|', CASE WHEN o_orderstatus <> 'P' THEN 'b' ELSE '-' END, '|1|d|e', CAST(o_custkey % 3 AS VARCHAR)) AS r,
         row_number() OVER (PARTITION BY task_id, cand_id ORDER BY o_orderkey) AS place FROM w0 WHERE task_id % 7 <> turn),
whole AS (SELECT l.task_id, l.cand_id, coalesce(list_sort(list(r) FILTER (r IS NOT NULL)), []) AS rws, coalesce(list(r ORDER BY place) FILTER (r IS NOT NULL), []) AS seq
          FROM listed l LEFT JOIN wide USING (task_id, cand_id) GROUP BY ALL),
wp AS (SELECT a.task_id, a.cand_id AS cand_a, b.cand_id AS cand_b, a.rws = b.rws AS equal, a.seq = b.seq AS same_list FROM whole a JOIN whole b
       ON a.task_id = b.task_id AND a.cand_id < b.cand_id)"""


@register("result_equal_wide", oracle=f"WITH {_WIDE}\nSELECT task_id, cand_a, cand_b, equal FROM wp")
def q_result_equal_wide(spark, sf):
    rows, listed = _wide(spark, sf)
    return ev.result_equal(rows, candidates=listed)


@register("result_equal_ordered", oracle=f"WITH {_WIDE}\nSELECT task_id, cand_a, cand_b, same_list AS equal FROM wp")
def q_result_equal_ordered(spark, sf):
    rows, listed = _wide(spark, sf)
    return ev.result_equal(rows, candidates=listed, ordered=True)


@register("vote_by_result_wide", oracle=f"""WITH {_WIDE},
g AS (SELECT task_id, rws, count(*) AS size, min(cand_id) AS ld FROM whole GROUP BY task_id, rws)
SELECT task_id, ld AS chosen, size AS group_size FROM g QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY size DESC, ld) = 1""")
def q_vote_by_result_wide(spark, sf):
    rows, listed = _wide(spark, sf)
    return ev.vote_by_result(rows, listed.withColumn("cand_no", F.substring("cand_id", 1, 1).cast("int")).withColumn("runnable", F.lit(True)))


@register("execution_accuracy_wide", oracle=f"""WITH {_WIDE}
SELECT '2-HIGH' AS pred, count(*) AS n_tasks, round(avg(CASE WHEN coalesce(p.rws = g.rws, FALSE) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM whole g LEFT JOIN whole p ON p.task_id = g.task_id AND p.cand_id = '2-HIGH' WHERE g.cand_id = '1-URGENT'""")
def q_execution_accuracy_wide(spark, sf):
    rows, listed = _wide(spark, sf)
    return ev.execution_accuracy(rows, pred="2-HIGH", gold="1-URGENT", candidates=listed)


@register("read_only_guard", oracle="""
SELECT conv_id, turn,
  CASE WHEN regexp_matches(text, '(?i)\\bDROP\\b') THEN 'DROP' WHEN regexp_matches(text, '(?i)\\bDELETE\\b') THEN 'DELETE'
       WHEN regexp_matches(text, '(?i)\\bUPDATE\\b') THEN 'UPDATE' WHEN regexp_matches(text, '(?i)\\bINSERT\\b') THEN 'INSERT'
       WHEN regexp_matches(text, '(?i)\\bALTER\\b') THEN 'ALTER' WHEN regexp_matches(text, '(?i)\\bTRUNCATE\\b') THEN 'TRUNCATE'
       WHEN regexp_matches(text, '(?i)\\bGRANT\\b') THEN 'GRANT' WHEN regexp_matches(text, '(?i)\\bREVOKE\\b') THEN 'REVOKE'
  END AS reason
FROM conversations""")
def q_read_only_guard(spark, sf):
    conv = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return ev.read_only_guard(conv, "text").select("conv_id", "turn", "reason")


@register("repair_column", oracle=f"""WITH {EXEMPLARS}, {CATALOG},
f AS (SELECT ex_id AS fid, db_id, regexp_extract(query, '\\b[a-z]_([a-z]+)\\b', 1) AS bad, query FROM exemplars),
ff AS (SELECT * FROM f WHERE bad <> ''),
m AS (SELECT ff.fid, c.col_name_orig AS name, row_number() OVER (PARTITION BY ff.fid ORDER BY c.col_id) AS r
      FROM ff JOIN columns c ON c.db_id = ff.db_id AND c.table_id >= 0
      WHERE lower(c.col_name_orig) = lower(ff.bad) OR contains(lower(ff.bad), lower(c.col_name_orig))
         OR contains(lower(c.col_name_orig), lower(ff.bad)))
SELECT ff.fid, ff.bad, m.name AS replacement, 'rule' AS method
FROM ff JOIN m ON m.fid = ff.fid AND m.r = 1""")
def q_repair_column(spark, sf):
    ex = exemplars(spark, sf)
    fail = ex.select(F.col("ex_id").alias("fid"), "db_id",
                     F.regexp_extract("query", r"\b[a-z]_([a-z]+)\b", 1).alias("bad")).where(F.col("bad") != "")
    cols = driver_columns(spark, sf).where("table_id >= 0").select(
        "db_id", F.col("col_name_orig").alias("name"), F.col("col_id").alias("ord"))
    return ev.repair_identifier(fail, cols, "column").select("fid", "bad", "replacement", "method")


@register("repair_column_ratio")
def q_repair_column_ratio(spark, sf):
    """A column name with two letters exchanged for every exemplar: only the ratio finds the column again."""
    cols = driver_columns(spark, sf).where("table_id >= 0").select("db_id", F.col("col_name_orig").alias("name"), F.col("col_id").alias("ord"))
    n = cols.groupBy("db_id").agg(F.count(F.lit(1)).alias("n"))
    picked = exemplars(spark, sf).join(n, "db_id").select(F.col("ex_id").alias("fid"), "db_id", (F.col("ex_id") % F.col("n") + 1).alias("ord"))
    at = F.length("name") - 2 - F.col("fid") % 3
    bad = F.concat(F.substring("name", F.lit(1), at - 1), F.substring("name", at + 1, F.lit(1)), F.substring("name", at, F.lit(1)), F.substr("name", at + 2))
    fail = picked.join(cols, ["db_id", "ord"]).select("fid", "db_id", bad.alias("bad"))
    return ev.repair_identifier(fail, cols, "column").select("fid", "bad", "replacement", "method")


# Results whose columns no value tells apart: each row joins two of six columns, in a cycle or in two triangles,
# with the columns turned by the priority's digit.
_CYCLE = [(i, (i + 1) % 6) for i in range(6)]
_TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]


def _tied(spark, sf):
    o = read_table(spark, sf, "orders").select((F.col("o_custkey") % 100).cast("long").alias("task_id"), F.col("o_orderpriority").alias("cand_id"),
                                               (F.col("o_orderkey") % 6).cast("long").alias("row_no")).distinct()
    turn = F.substring("cand_id", 1, 1).cast("int")
    ends = lambda edges, i: F.array(*[F.lit(e[i]) for e in edges])[F.col("row_no").cast("int")]
    cycle = (turn % 2 == 1) | (F.col("task_id") % 3 == 0)
    o = o.withColumns({f"e{i}": (F.when(cycle, ends(_CYCLE, i)).otherwise(ends(_TRIANGLES, i)) + turn) % 6 for i in (0, 1)})
    cell = lambda c: F.when((F.col("e0") == c) | (F.col("e1") == c), F.when(turn == 2, "1.0").otherwise("1")).otherwise("0")
    return o.select("task_id", "cand_id", "row_no", F.array(*[cell(c) for c in range(6)]).alias("vals"))


def _edge_sql(edges, i):
    return "[" + ", ".join(str(e[i]) for e in edges) + "][k + 1]"


# every order of six columns is tried
_TIED = f"""t0 AS (SELECT DISTINCT CAST(o_custkey % 100 AS BIGINT) AS task_id, o_orderpriority AS cand_id, o_orderkey % 6 AS k, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS turn FROM orders),
t1 AS (SELECT *, turn % 2 = 1 OR task_id % 3 = 0 AS cyc FROM t0),
t2 AS (SELECT task_id, cand_id, (CASE WHEN cyc THEN {_edge_sql(_CYCLE, 0)} ELSE {_edge_sql(_TRIANGLES, 0)} END + turn) % 6 AS e0,
         (CASE WHEN cyc THEN {_edge_sql(_CYCLE, 1)} ELSE {_edge_sql(_TRIANGLES, 1)} END + turn) % 6 AS e1 FROM t1),
tr AS (SELECT task_id, cand_id, list([least(e0, e1), greatest(e0, e1)] ORDER BY least(e0, e1), greatest(e0, e1)) AS rws FROM t2 GROUP BY ALL),
six AS (SELECT unnest(range(6)) AS x),
perms AS (SELECT [a.x, b.x, c.x, d.x, e.x, f.x] AS p FROM six a, six b, six c, six d, six e, six f WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x, f.x])) = 6),
turned AS (SELECT DISTINCT rws, list_sort(list_transform(rws, lambda r: [least(p[r[1] + 1], p[r[2] + 1]), greatest(p[r[1] + 1], p[r[2] + 1])])) AS other FROM (SELECT DISTINCT rws FROM tr), perms),
tp AS (SELECT a.task_id, a.cand_id AS cand_a, b.cand_id AS cand_b, EXISTS (SELECT 1 FROM turned t WHERE t.rws = b.rws AND t.other = a.rws) AS equal
       FROM tr a JOIN tr b ON a.task_id = b.task_id AND a.cand_id < b.cand_id)"""


@register("result_equal_tied", oracle=f"WITH {_TIED}\nSELECT task_id, cand_a, cand_b, equal FROM tp")
def q_result_equal_tied(spark, sf):
    return ev.result_equal(_tied(spark, sf))


@register("vote_by_result_tied", oracle=f"""WITH {_TIED},
led AS (SELECT r.task_id, r.cand_id, least(r.cand_id, coalesce(min(cand_a), r.cand_id)) AS ld FROM tr r LEFT JOIN tp ON tp.task_id = r.task_id AND cand_b = r.cand_id AND equal GROUP BY r.task_id, r.cand_id),
grp AS (SELECT task_id, ld, count(*) AS size FROM led GROUP BY ALL)
SELECT task_id, ld AS chosen, size AS group_size FROM grp QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY size DESC, ld) = 1""")
def q_vote_by_result_tied(spark, sf):
    rows = _tied(spark, sf)
    listed = rows.select("task_id", "cand_id").distinct()
    return ev.vote_by_result(rows, listed.withColumn("cand_no", F.substring("cand_id", 1, 1).cast("int")).withColumn("runnable", F.lit(True)))


@register("repair_table", oracle=f"""WITH {EXEMPLARS}, {CATALOG},
f AS (SELECT ex_id AS fid, db_id, regexp_extract(query, '(?i)from ([a-z_]+)', 1) AS t FROM exemplars),
ff AS (SELECT fid, db_id, CASE WHEN t LIKE '%s' THEN upper(t) ELSE t || 's' END AS bad FROM f WHERE t <> ''),
tabs AS (SELECT DISTINCT db_id, table_name_orig AS name, table_id FROM columns WHERE table_id >= 0),
m AS (SELECT ff.fid, t.name, row_number() OVER (PARTITION BY ff.fid ORDER BY t.table_id) AS r
      FROM ff JOIN tabs t ON t.db_id = ff.db_id
      WHERE lower(t.name) = lower(ff.bad) OR lower(t.name) = rtrim(lower(ff.bad), 's'))
SELECT ff.fid, ff.bad, m.name AS replacement, 'rule' AS method FROM ff JOIN m ON m.fid = ff.fid AND m.r = 1""")
def q_repair_table(spark, sf):
    ex = exemplars(spark, sf)
    t = F.regexp_extract("query", r"(?i)from ([a-z_]+)", 1)
    fail = ex.select(F.col("ex_id").alias("fid"), "db_id", t.alias("t")).where(F.col("t") != "").select(
        "fid", "db_id", F.when(F.col("t").endswith("s"), F.upper("t")).otherwise(F.concat("t", F.lit("s"))).alias("bad"))
    tabs = driver_columns(spark, sf).where("table_id >= 0").select(
        "db_id", F.col("table_name_orig").alias("name"), F.col("table_id").alias("ord")).distinct()
    return ev.repair_identifier(fail, tabs, "table").select("fid", "bad", "replacement", "method")


def _workload(spark, sf):
    """Per relational table of the catalog: a valid count, a count over a misspelt
    column (plural) and a count over a misspelt table (plural); tables are
    registered as temp views so each statement runs as its own Spark job."""
    from shotweave.sources.catalog import RELATIONAL_TABLES

    for t in RELATIONAL_TABLES:
        read_table(spark, sf, t).createOrReplaceTempView(t)
    cols = driver_columns(spark, sf)
    db = cols.agg(F.min("db_id")).first()[0]
    first = (cols.where((F.col("db_id") == db) & (F.col("table_id") >= 0))
             .groupBy("table_id", "table_name_orig").agg(F.min_by("col_name_orig", "col_id").alias("c")))
    base = first.select("table_id", "table_name_orig", "c")
    q = base.select((F.col("table_id") * 3).alias("qid"), F.concat(F.lit("SELECT count(*) AS n FROM "), "table_name_orig").alias("sql"))
    q = q.unionByName(base.select((F.col("table_id") * 3 + 1).alias("qid"),
                                  F.concat(F.lit("SELECT count("), "c", F.lit("s) AS n FROM "), "table_name_orig").alias("sql")))
    q = q.unionByName(base.select((F.col("table_id") * 3 + 2).alias("qid"),
                                  F.concat(F.lit("SELECT count(*) AS n FROM "), "table_name_orig", F.lit("s")).alias("sql")))
    names_col = cols.where((F.col("db_id") == db) & (F.col("table_id") >= 0)).select(
        "db_id", F.col("col_name_orig").alias("name"), F.col("col_id").alias("ord"))
    names_tab = cols.where((F.col("db_id") == db) & (F.col("table_id") >= 0)).select(
        "db_id", F.col("table_name_orig").alias("name"), F.col("table_id").alias("ord")).distinct()
    return q.withColumn("qid", F.col("qid").cast("long")).withColumn("db_id", F.lit(db)), names_col, names_tab


@register("run_workload")
def q_run_workload(spark, sf):
    q, _, _ = _workload(spark, sf)
    return ev.run_workload(spark, q.select("qid", "sql")).select("qid", "ok", "n_rows", "error_class")


@register("repair_rounds")
def q_repair_rounds(spark, sf):
    q, nc, nt = _workload(spark, sf)
    return ev.repair_rounds(spark, q, nc, nt, n_rounds=3).select("iteration", "qid", "ok", "error_class", "sql",
                                                                "repaired_sql", "method")


@register("workload_outcomes")
def q_workload_outcomes(spark, sf):
    q, nc, nt = _workload(spark, sf)
    return ev.workload_outcomes(ev.repair_rounds(spark, q, nc, nt, n_rounds=3))
