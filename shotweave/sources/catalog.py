"""Schema catalogs.

`tables.json`-style rows (one per database, arrays of names, types and keys) are
the interchange form; `load_schema_catalog` explodes them into the long
`columns` table every catalog and linking operator joins against.

For the driver data, `driver_schema_json` derives the rows from the parquet
schemas of the relational tables themselves (names, order and types come from
the files) plus their declared keys, for every database id of the exemplar bank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.sources.tables import exemplars, read_table

# ---------------------------------------------------------------------------
# The relational tables of the driver data, their order (table
# ids), primary keys and foreign keys (from column -> to column).
# ---------------------------------------------------------------------------
RELATIONAL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
PRIMARY_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
}
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]

SCHEMA_JSON_TYPE = T.StructType([
    T.StructField("db_id", T.StringType()),
    T.StructField("table_names", T.ArrayType(T.StringType())),
    T.StructField("table_names_original", T.ArrayType(T.StringType())),
    T.StructField("column_names", T.ArrayType(T.StructType([
        T.StructField("table_id", T.IntegerType()), T.StructField("name", T.StringType())]))),
    T.StructField("column_names_original", T.ArrayType(T.StructType([
        T.StructField("table_id", T.IntegerType()), T.StructField("name", T.StringType())]))),
    T.StructField("column_types", T.ArrayType(T.StringType())),
    T.StructField("primary_keys", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("foreign_keys", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, T.StringType):
        return "text"
    if isinstance(dt, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return "time"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType,
                       T.DecimalType)):
        return "number"
    return "others"


_SCHEMA_CACHE: dict = {}


def _schema_literal(spark: SparkSession, sf_dir: str) -> dict:
    """Names, kinds and keys of the relational tables (parquet footers only; read
    once per table folder and session)."""
    key = (id(spark), sf_dir)
    if key not in _SCHEMA_CACHE:
        _SCHEMA_CACHE[key] = _read_schema_literal(spark, sf_dir)
    return _SCHEMA_CACHE[key]


def _read_schema_literal(spark: SparkSession, sf_dir: str) -> dict:
    table_names, col_names, col_types = [], [(-1, "*")], ["text"]
    col_index = {}
    for tid, t in enumerate(RELATIONAL_TABLES):
        table_names.append(t)
        for f in read_table(spark, sf_dir, t).schema.fields:
            col_index[(t, f.name)] = len(col_names)
            col_names.append((tid, f.name))
            col_types.append(_kind(f.dataType))
    pks = [[col_index[(t, c)] for c in PRIMARY_KEYS[t]] for t in RELATIONAL_TABLES]
    fks = [[col_index[(a, b)], col_index[(c, d)]] for a, b, c, d in FOREIGN_KEYS]
    return dict(table_names=table_names, column_names=col_names, column_types=col_types,
                primary_keys=pks, foreign_keys=fks)


def driver_schema_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One `tables.json`-style row per database id of the exemplar bank."""
    sch = _schema_literal(spark, sf_dir)

    def name_list(pairs):
        return F.array(*[F.struct(F.lit(i).cast("int").alias("table_id"), F.lit(n).alias("name"))
                         for i, n in pairs])

    def int_lists(lists):
        return F.array(*[F.array(*[F.lit(v).cast("int") for v in x]) for x in lists])

    dbs = exemplars(spark, sf_dir).select("db_id").distinct()
    return dbs.select(
        "db_id",
        F.array(*[F.lit(t.replace("_", " ")) for t in sch["table_names"]]).alias("table_names"),
        F.array(*[F.lit(t) for t in sch["table_names"]]).alias("table_names_original"),
        name_list([(i, n.replace("_", " ")) for i, n in sch["column_names"]]).alias("column_names"),
        name_list(sch["column_names"]).alias("column_names_original"),
        F.array(*[F.lit(t) for t in sch["column_types"]]).alias("column_types"),
        int_lists(sch["primary_keys"]).alias("primary_keys"),
        int_lists(sch["foreign_keys"]).alias("foreign_keys"),
    )


def read_schema_json(spark: SparkSession, path: str) -> DataFrame:
    """Read a `tables.json` file (a JSON array). A primary-key entry may be an int
    or a list of ints; both become ARRAY<INT>."""
    def pairs(c):
        # [table_id, name] pairs arrive as string arrays
        return F.transform(F.col(c).cast("array<array<string>>"), lambda x: F.struct(
            x[0].cast("int").alias("table_id"), x[1].alias("name")))

    raw = (spark.read.option("multiLine", True).json(path)
           .withColumn("primary_keys", F.transform(
               F.col("primary_keys").cast("array<string>"),
               lambda p: F.coalesce(F.from_json(p, "array<int>"), F.array(p.cast("int")))))
           .withColumn("column_names", pairs("column_names"))
           .withColumn("column_names_original", pairs("column_names_original")))
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA_JSON_TYPE.fields])


def load_schema_catalog(schema_json: DataFrame) -> DataFrame:
    """Explode schema rows into `columns(db_id, table_id, table_name, table_name_orig,
    col_id, col_name, col_name_orig, col_type, is_pk, fk_col_id)`; column 0 is `*`
    with table_id -1."""
    cols = schema_json.select(
        "db_id", "table_names", "table_names_original", "primary_keys", "foreign_keys",
        F.posexplode(F.arrays_zip(F.col("column_names").alias("n"), F.col("column_names_original").alias("o"),
                                  F.col("column_types").alias("t"))).alias("col_id", "z"))
    tid = F.col("z.o.table_id")
    pk_ids = F.flatten(F.col("primary_keys"))
    fk_to = F.filter(F.col("foreign_keys"), lambda fk: fk[0] == F.col("col_id"))
    return cols.select(
        "db_id",
        tid.cast("int").alias("table_id"),
        F.when(tid >= 0, F.element_at("table_names", tid + 1)).alias("table_name"),
        F.when(tid >= 0, F.element_at("table_names_original", tid + 1)).alias("table_name_orig"),
        F.col("col_id").cast("int").alias("col_id"),
        F.col("z.n.name").alias("col_name"),
        F.col("z.o.name").alias("col_name_orig"),
        F.col("z.t").alias("col_type"),
        F.array_contains(pk_ids, F.col("col_id").cast("int")).alias("is_pk"),
        F.when(F.size(fk_to) > 0, F.element_at(fk_to, 1)[1]).cast("int").alias("fk_col_id"),
    )


def driver_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_schema_catalog(driver_schema_json(spark, sf_dir))
