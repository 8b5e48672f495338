"""Catalog and profiling operators over the long `columns` table.

`columns(db_id, table_id, table_name, table_name_orig, col_id, col_name,
col_name_orig, col_type, is_pk, fk_col_id)`; column 0 is `*` with table_id -1.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotweave.functions.sqltext import normalize_identifier

# SQL type written into DDL text per catalog column kind.
DDL_TYPES = {"text": "TEXT", "number": "NUMERIC", "time": "TIMESTAMP", "boolean": "BOOLEAN", "others": "BLOB"}


def _real_columns(columns: DataFrame) -> DataFrame:
    return columns.where(F.col("table_id") >= 0)


def catalog_tables(columns: DataFrame, drop_internal: bool = True) -> DataFrame:
    """User tables per database; ``drop_internal`` removes `sqlite_%` names."""
    t = _real_columns(columns).select("db_id", "table_id", F.col("table_name_orig").alias("table_name")).distinct()
    if drop_internal:
        t = t.where(~F.col("table_name").like("sqlite\\_%"))
    return t


def _ddl_type(kind):
    expr = F.lit("BLOB")
    for k, v in DDL_TYPES.items():
        expr = F.when(kind == k, F.lit(v)).otherwise(expr)
    return expr


def catalog_ddl(columns: DataFrame) -> DataFrame:
    """`CREATE TABLE` text per table: columns in id order, primary key, foreign keys."""
    cols = _real_columns(columns)
    target = cols.select("db_id", F.col("col_id").alias("fk_col_id"),
                         F.col("table_name_orig").alias("ref_table"), F.col("col_name_orig").alias("ref_col"))
    with_fk = cols.join(target, ["db_id", "fk_col_id"], "left")
    per_table = with_fk.groupBy("db_id", "table_id", "table_name_orig").agg(
        F.array_sort(F.collect_list(F.struct("col_id", F.concat_ws(" ", "col_name_orig", _ddl_type(F.col("col_type")))
                                             .alias("line")))).alias("cols"),
        F.array_sort(F.collect_list(F.when(F.col("is_pk"), F.struct("col_id", F.col("col_name_orig").alias("n")))))
        .alias("pks"),
        F.array_sort(F.collect_list(F.when(F.col("ref_table").isNotNull(), F.struct(
            "col_id", F.format_string("FOREIGN KEY (%s) REFERENCES %s (%s)", "col_name_orig", "ref_table", "ref_col")
            .alias("line"))))).alias("fks"),
    )
    body = F.concat(
        F.transform("cols", lambda s: s["line"]),
        F.when(F.size("pks") > 0, F.array(F.concat(F.lit("PRIMARY KEY ("), F.array_join(
            F.transform("pks", lambda s: s["n"]), ", "), F.lit(")")))).otherwise(F.array().cast("array<string>")),
        F.transform("fks", lambda s: s["line"]),
    )
    return per_table.select(
        "db_id", F.col("table_name_orig").alias("table_name"),
        F.concat(F.lit("CREATE TABLE "), F.col("table_name_orig"), F.lit(" (\n  "),
                 F.array_join(body, ",\n  "), F.lit("\n)")).alias("ddl"))


def catalog_foreign_keys(columns: DataFrame, style: str = "eq") -> DataFrame:
    """Foreign keys as text: `t.c = u.d` (style "eq") or `(t.c, u.d)` (style "tuple")."""
    cols = _real_columns(columns)
    src = cols.where(F.col("fk_col_id").isNotNull())
    dst = cols.select("db_id", F.col("col_id").alias("fk_col_id"),
                      F.col("table_name_orig").alias("dst_table"), F.col("col_name_orig").alias("dst_col"))
    j = src.join(dst, ["db_id", "fk_col_id"])
    a = F.concat_ws(".", "table_name_orig", "col_name_orig")
    b = F.concat_ws(".", "dst_table", "dst_col")
    text = F.concat_ws(" = ", a, b) if style == "eq" else F.concat(F.lit("("), a, F.lit(", "), b, F.lit(")"))
    return j.select("db_id", F.col("table_name_orig").alias("table_name"), text.alias("fk"))


def catalog_primary_keys(columns: DataFrame, first_only: bool = True) -> DataFrame:
    """Primary-key columns per table; ``first_only`` keeps only key position 1
    (the reference's behaviour, which loses the rest of a composite key)."""
    pk = _real_columns(columns).where("is_pk")
    pk = pk.withColumn("pos", F.row_number().over(
        Window.partitionBy("db_id", "table_id").orderBy("col_id")).cast("int"))
    if first_only:
        pk = pk.where(F.col("pos") == 1)
    return pk.select("db_id", F.col("table_name_orig").alias("table_name"), "pos",
                     F.col("col_name_orig").alias("pk_col"))


def sample_distinct_values(table: DataFrame, table_name: str, n: int = 3) -> DataFrame:
    """Up to ``n`` distinct non-null values per column, smallest first, as text.

    Each pass is one global aggregate (map-side partial mins, one row shuffled
    per task) that takes the next smallest value above the previous pass; only
    n x width values ever reach the driver.
    """
    return _sample_values_from_mins(table, table_name, n)


def _sample_values_from_mins(table: DataFrame, table_name: str, n: int) -> DataFrame:
    names = table.columns
    spark = table.sparkSession
    prev: dict[str, object] = {}
    out = []
    for rank in range(1, n + 1):
        aggs = []
        for c in names:
            col = F.col(c)
            cond = col.isNotNull() if c not in prev else (col > F.lit(prev[c]))
            aggs.append(F.min(F.when(cond, col)).cast("string").alias(c + "__s"))
            aggs.append(F.min(F.when(cond, col)).alias(c))
        got = table.agg(*aggs).first()
        for c in names:
            if c in prev and prev[c] is None:
                continue
            prev[c] = got[c]
            if got[c] is not None:
                out.append((table_name, c, rank, got[c + "__s"]))
    return spark.createDataFrame(out, "table_name string, col_name string, rnk int, value string")


def schema_profile(columns: DataFrame) -> DataFrame:
    """Per table: first column id, end bound (next table's first id), column count,
    column ids and primary-key ids."""
    cols = _real_columns(columns)
    per = cols.groupBy("db_id", "table_id", "table_name_orig").agg(
        F.min("col_id").alias("first_col"), F.count("*").cast("int").alias("n_cols"),
        F.array_join(F.array_sort(F.collect_list("col_id")), ",").alias("col_ids"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_pk"), F.col("col_id")))), ",").alias("pk_ids"))
    w = Window.partitionBy("db_id").orderBy("table_id")
    total = columns.groupBy("db_id").agg(F.count("*").cast("int").alias("n_total"))
    return (per.join(total, "db_id")
            .withColumn("end_bound", F.coalesce(F.lead("first_col").over(w), F.col("n_total")).cast("int"))
            .select("db_id", "table_id", F.col("table_name_orig").alias("table_name"), "first_col",
                    "end_bound", "n_cols", "col_ids", "pk_ids"))


def fk_graph(columns: DataFrame) -> DataFrame:
    """Each foreign key as two directed table edges."""
    cols = _real_columns(columns)
    dst = cols.select("db_id", F.col("col_id").alias("fk_col_id"), F.col("table_id").alias("dst_table"))
    fwd = (cols.where(F.col("fk_col_id").isNotNull()).join(dst, ["db_id", "fk_col_id"])
           .select("db_id", F.col("table_id").alias("src_table"), "dst_table",
                   F.col("col_id").alias("src_col"), F.col("fk_col_id").alias("dst_col")))
    back = fwd.select("db_id", F.col("dst_table").alias("src_table"), F.col("src_table").alias("dst_table"),
                      F.col("dst_col").alias("src_col"), F.col("src_col").alias("dst_col"))
    return fwd.unionByName(back)


def fk_equivalence(columns: DataFrame) -> DataFrame:
    """Columns linked by foreign keys share the smallest column id of their
    connected component (min-label propagation over FK edges until nothing changes)."""
    cols = _real_columns(columns)
    e = cols.where(F.col("fk_col_id").isNotNull()).select("db_id", F.col("col_id").alias("a"),
                                                         F.col("fk_col_id").alias("b"))
    edges = e.unionByName(e.select("db_id", F.col("b").alias("a"), F.col("a").alias("b"))).cache()
    labels = edges.select("db_id", F.col("a").alias("col_id")).distinct().withColumn("root", F.col("col_id"))
    for i in itertools.count():
        nb = (edges.join(labels.withColumnRenamed("col_id", "b"), ["db_id", "b"])
              .groupBy("db_id", F.col("a").alias("col_id")).agg(F.min("root").alias("nroot")))
        new = (labels.join(nb, ["db_id", "col_id"], "left")
               .select("db_id", "col_id", F.least("root", F.coalesce("nroot", "root")).alias("root")))
        if i % 5 == 4:
            new = new.checkpoint()
        else:
            new = new.cache()
        changed = new.join(labels.withColumnRenamed("root", "old"), ["db_id", "col_id"]).where(
            F.col("root") != F.col("old")).limit(1).count()
        labels = new
        if changed == 0:
            break
    return labels.select("db_id", "col_id", F.col("root").cast("int").alias("root"))


def normalized_names(columns: DataFrame) -> DataFrame:
    """Catalog column names in natural-language form."""
    return _real_columns(columns).select("db_id", "col_id", "col_name_orig",
                                         normalize_identifier(F.col("col_name_orig")).alias("norm_name"))


def prune_tables_by_name(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables whose lower-case name, or that name without trailing `s`, occurs in
    the lower-case question; a question naming none keeps every table.
    questions: (q_id, db_id, question). Returns (q_id, table_name).

    A name without its trailing `s` occurs wherever the name does, so only that stem counts. A database's tables are
    one row of the catalog, which is broadcast: a question is searched for each stem of its own database, and nothing
    of it is cut out or shuffled."""
    stem = F.expr("TRIM(TRAILING 's' FROM lower(table_name))").alias("stem")
    tables = catalog_tables(columns).groupBy("db_id").agg(F.collect_list(F.struct("table_name", stem)).alias("tables"))
    asked = questions.select("q_id", "db_id", F.lower("question").alias("q_low")).join(F.broadcast(tables), "db_id")
    names = lambda found: F.transform(found, lambda t: t["table_name"])
    named = F.array_distinct(names(F.filter("tables", lambda t: F.contains(F.col("q_low"), t["stem"]))))
    asked = asked.select("q_id", "tables", named.alias("named"))
    return asked.select("q_id", F.explode(F.when(F.size("named") > 0, F.col("named")).otherwise(names("tables"))).alias("table_name"))
