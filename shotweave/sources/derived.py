"""Inputs derived by Spark from the driver tables for operators whose natural
input (model responses, database name lists) the driver data lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.plans.oracle_sql import RESPONSES_SELECT
from shotweave.session import checkpoint_dir
from shotweave.sources.catalog import driver_columns
from shotweave.sources.tables import exemplars


def responses(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """`responses(ex_id, db_id, response)`: one model-style answer per exemplar
    (plain, fenced, commented with spaced operators, or with a current-year call)."""
    return exemplars(spark, sf_dir, keys).select("ex_id", "db_id", F.expr(RESPONSES_SELECT).alias("response"))


def db_name_arrays(columns: DataFrame) -> DataFrame:
    """Per database: lower-case table names `tl`, column names `cl`, original table names `torig`."""
    real = columns.where(F.col("table_id") >= 0)
    return real.groupBy("db_id").agg(
        F.collect_set(F.lower("table_name_orig")).alias("tl"),
        F.collect_set(F.lower("col_name_orig")).alias("cl"),
        F.collect_set("table_name_orig").alias("torig"))


def database_names(spark: SparkSession, sf_dir: str, columns: DataFrame | None = None) -> DataFrame:
    """The name arrays of every database (`db_name_arrays`), kept: each use would else derive the catalog again."""
    checkpoint_dir(spark)
    return db_name_arrays(driver_columns(spark, sf_dir) if columns is None else columns).checkpoint()


def in_catalog(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose database is in the catalog (one row per database, broadcast by name)."""
    return rows.join(F.broadcast(names.select("db_id")), "db_id")
