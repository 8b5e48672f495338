"""Registered catalog / profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotweave.operators import catalog as cat
from shotweave.plans.oracle_sql import CATALOG, EXEMPLARS
from shotweave.plans.registry import register
from shotweave.sources.catalog import driver_columns
from shotweave.sources.tables import exemplars, read_table

_CAT = f"WITH {CATALOG}"


@register("load_schema_catalog", oracle=f"""{_CAT}
SELECT db_id, table_id, table_name, table_name_orig, col_id, col_name, col_name_orig, col_type, is_pk, fk_col_id
FROM columns""")
def q_load_schema_catalog(spark, sf):
    return driver_columns(spark, sf)


@register("catalog_tables", oracle=f"""{_CAT}
SELECT DISTINCT db_id, table_id, table_name_orig AS table_name FROM columns
WHERE table_id >= 0 AND table_name_orig NOT LIKE 'sqlite\\_%' ESCAPE '\\'""")
def q_catalog_tables(spark, sf):
    return cat.catalog_tables(driver_columns(spark, sf))


@register("catalog_ddl", oracle=f"""{_CAT},
real AS (SELECT * FROM columns WHERE table_id >= 0),
fk AS (SELECT c.db_id, c.table_id, c.col_id,
         'FOREIGN KEY (' || c.col_name_orig || ') REFERENCES ' || t.table_name_orig || ' (' || t.col_name_orig || ')' AS line
       FROM real c JOIN real t ON c.db_id = t.db_id AND c.fk_col_id = t.col_id),
per AS (SELECT db_id, table_id, table_name_orig,
          list(col_name_orig || ' ' || CASE col_type WHEN 'text' THEN 'TEXT' WHEN 'number' THEN 'NUMERIC'
               WHEN 'time' THEN 'TIMESTAMP' WHEN 'boolean' THEN 'BOOLEAN' ELSE 'BLOB' END ORDER BY col_id) AS cols,
          list(col_name_orig ORDER BY col_id) FILTER (WHERE is_pk) AS pks
        FROM real GROUP BY db_id, table_id, table_name_orig),
fks AS (SELECT db_id, table_id, list(line ORDER BY col_id) AS lines FROM fk GROUP BY db_id, table_id)
SELECT p.db_id, p.table_name_orig AS table_name,
  'CREATE TABLE ' || p.table_name_orig || ' (' || chr(10) || '  ' || array_to_string(list_concat(p.cols,
     CASE WHEN len(coalesce(p.pks, [])) > 0 THEN ['PRIMARY KEY (' || array_to_string(p.pks, ', ') || ')'] ELSE [] END,
     coalesce(f.lines, [])), ',' || chr(10) || '  ') || chr(10) || ')' AS ddl
FROM per p LEFT JOIN fks f ON p.db_id = f.db_id AND p.table_id = f.table_id""")
def q_catalog_ddl(spark, sf):
    return cat.catalog_ddl(driver_columns(spark, sf))


_FK_SQL = f"""{_CAT},
real AS (SELECT * FROM columns WHERE table_id >= 0)
SELECT c.db_id, c.table_name_orig AS table_name, {{expr}} AS fk
FROM real c JOIN real t ON c.db_id = t.db_id AND c.fk_col_id = t.col_id"""


@register("catalog_foreign_keys", oracle=_FK_SQL.format(
    expr="c.table_name_orig || '.' || c.col_name_orig || ' = ' || t.table_name_orig || '.' || t.col_name_orig"))
def q_catalog_foreign_keys(spark, sf):
    return cat.catalog_foreign_keys(driver_columns(spark, sf), style="eq")


@register("catalog_foreign_keys_tuple", oracle=_FK_SQL.format(
    expr="'(' || c.table_name_orig || '.' || c.col_name_orig || ', ' || t.table_name_orig || '.' || t.col_name_orig || ')'"))
def q_catalog_foreign_keys_tuple(spark, sf):
    return cat.catalog_foreign_keys(driver_columns(spark, sf), style="tuple")


@register("catalog_primary_keys", oracle=f"""{_CAT},
pk AS (SELECT db_id, table_name_orig, col_name_orig,
         CAST(row_number() OVER (PARTITION BY db_id, table_id ORDER BY col_id) AS INTEGER) AS pos
       FROM columns WHERE table_id >= 0 AND is_pk)
SELECT db_id, table_name_orig AS table_name, pos, col_name_orig AS pk_col FROM pk WHERE pos = 1""")
def q_catalog_primary_keys(spark, sf):
    return cat.catalog_primary_keys(driver_columns(spark, sf), first_only=True)


@register("sample_distinct_values", oracle="""
WITH long AS (
  SELECT 'c_custkey' AS col_name, CAST(c_custkey AS VARCHAR) AS value, c_custkey::DOUBLE AS k, NULL AS ks FROM customer
  UNION ALL SELECT 'c_name', c_name, NULL, c_name FROM customer
  UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), c_nationkey::DOUBLE, NULL FROM customer
  UNION ALL SELECT 'c_acctbal', CAST(c_acctbal AS VARCHAR), c_acctbal, NULL FROM customer
  UNION ALL SELECT 'c_mktsegment', c_mktsegment, NULL, c_mktsegment FROM customer),
d AS (SELECT DISTINCT col_name, value, k, ks FROM long WHERE value IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY col_name ORDER BY k, ks) AS INTEGER) AS rnk FROM d)
SELECT 'customer' AS table_name, col_name, rnk, value FROM r WHERE rnk <= 3""")
def q_sample_distinct_values(spark, sf):
    return cat.sample_distinct_values(read_table(spark, sf, "customer"), "customer", 3)


@register("schema_profile", oracle=f"""{_CAT},
per AS (SELECT db_id, table_id, table_name_orig, min(col_id) AS first_col, CAST(count(*) AS INTEGER) AS n_cols,
          array_to_string(list_sort(list(col_id)), ',') AS col_ids,
          coalesce(array_to_string(list_sort(list(col_id) FILTER (WHERE is_pk)), ','), '') AS pk_ids
        FROM columns WHERE table_id >= 0 GROUP BY db_id, table_id, table_name_orig),
tot AS (SELECT db_id, CAST(count(*) AS INTEGER) AS n_total FROM columns GROUP BY db_id)
SELECT p.db_id, p.table_id, p.table_name_orig AS table_name, p.first_col,
  CAST(coalesce(lead(p.first_col) OVER (PARTITION BY p.db_id ORDER BY p.table_id), t.n_total) AS INTEGER) AS end_bound,
  p.n_cols, p.col_ids, p.pk_ids
FROM per p JOIN tot t ON p.db_id = t.db_id""")
def q_schema_profile(spark, sf):
    return cat.schema_profile(driver_columns(spark, sf))


@register("fk_graph", oracle=f"""{_CAT},
fwd AS (SELECT c.db_id, c.table_id AS src_table, t.table_id AS dst_table, c.col_id AS src_col, c.fk_col_id AS dst_col
        FROM columns c JOIN columns t ON c.db_id = t.db_id AND c.fk_col_id = t.col_id WHERE c.table_id >= 0)
SELECT * FROM fwd
UNION ALL SELECT db_id, dst_table, src_table, dst_col, src_col FROM fwd""")
def q_fk_graph(spark, sf):
    return cat.fk_graph(driver_columns(spark, sf))


@register("fk_equivalence", oracle=f"""{_CAT},
e AS (SELECT db_id, col_id AS a, fk_col_id AS b FROM columns WHERE table_id >= 0 AND fk_col_id IS NOT NULL
      UNION SELECT db_id, fk_col_id, col_id FROM columns WHERE table_id >= 0 AND fk_col_id IS NOT NULL)
SELECT db_id, col_id, CAST(min(reach) AS INTEGER) AS root FROM (
  WITH RECURSIVE walk(db_id, col_id, reach) AS (
    SELECT DISTINCT db_id, a, a FROM e
    UNION
    SELECT w.db_id, w.col_id, e.b FROM walk w JOIN e ON w.db_id = e.db_id AND w.reach = e.a)
  SELECT * FROM walk) GROUP BY db_id, col_id""")
def q_fk_equivalence(spark, sf):
    from shotweave.session import checkpoint_dir

    checkpoint_dir(spark)
    return cat.fk_equivalence(driver_columns(spark, sf))


@register("normalize_identifier", oracle=f"""{_CAT}
SELECT db_id, col_id, col_name_orig,
  trim(lower(replace(regexp_replace(col_name_orig, '([A-Z]+)', ' \\1', 'g'), '_', ' '))) AS norm_name
FROM columns WHERE table_id >= 0""")
def q_normalize_identifier(spark, sf):
    return cat.normalized_names(driver_columns(spark, sf))


@register("prune_tables_by_name", oracle=f"""WITH {EXEMPLARS}, {CATALOG},
tabs AS (SELECT DISTINCT db_id, table_name_orig AS table_name FROM columns WHERE table_id >= 0),
pairs AS (SELECT e.ex_id AS q_id, t.table_name,
           contains(lower(e.question), lower(t.table_name)) OR contains(lower(e.question), rtrim(lower(t.table_name), 's')) AS hit
          FROM exemplars e JOIN tabs t ON e.db_id = t.db_id),
flag AS (SELECT *, max(CAST(hit AS INT)) OVER (PARTITION BY q_id) AS any_hit FROM pairs)
SELECT q_id, table_name FROM flag WHERE hit OR any_hit = 0""")
def q_prune_tables_by_name(spark, sf):
    ex = exemplars(spark, sf).select(F.col("ex_id").alias("q_id"), "db_id", "question")
    return cat.prune_tables_by_name(ex, driver_columns(spark, sf))
