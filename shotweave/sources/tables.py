"""Readers for the parquet tables the library runs on, and the derived views
(`exemplars`, exemplar vectors) that stand in for a text-to-SQL corpus.

Every reader returns a lazy DataFrame; callers select the columns they need, so
column pruning and filter pushdown reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# The exemplar bank, twelve question / SQL templates instantiated
# over `orders`. The same expressions run on Spark and in the DuckDB oracle.
# ---------------------------------------------------------------------------
_QUESTION_CASE = r"""CASE CAST(o_orderkey % 12 AS INT)
 WHEN 0 THEN 'How many orders are there in total?'
 WHEN 1 THEN concat('Find the order key and total price of orders with total price over ', CAST(o_custkey AS STRING), '.')
 WHEN 2 THEN concat('List the customer name and the total price of each order of customer ', CAST(o_custkey AS STRING), '.')
 WHEN 3 THEN 'Count the orders per customer sorted by count descending.'
 WHEN 4 THEN concat('What is the average account balance per market segment with maximum balance over ', CAST(o_custkey AS STRING), '?')
 WHEN 5 THEN concat('List all customers and all suppliers of nation ', CAST(o_custkey % 25 AS STRING), '.')
 WHEN 6 THEN concat('Which customer names have an open order and a key below ', CAST(o_custkey AS STRING), '?')
 WHEN 7 THEN concat('Show nation names outside region ', CAST(o_custkey % 5 AS STRING), ' except keys 3 to 7.')
 WHEN 8 THEN 'Show the first three distinct order priority values.'
 WHEN 9 THEN 'What is the sum of account balance for each nation name?'
 WHEN 10 THEN concat('Label each urgent order big or small at price ', CAST(o_custkey AS STRING), '.')
 ELSE concat('What is the minimum part size per brand number, size not ', CAST(o_custkey % 50 AS STRING), '?') END"""

_QUERY_CASE = r"""CASE CAST(o_orderkey % 12 AS INT)
 WHEN 0 THEN 'SELECT count(*) FROM orders'
 WHEN 1 THEN concat('SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > ', CAST(o_custkey AS STRING))
 WHEN 2 THEN concat('SELECT T1.c_name, T2.o_totalprice FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey WHERE T2.o_custkey = ', CAST(o_custkey AS STRING))
 WHEN 3 THEN 'SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey ORDER BY count(*) DESC'
 WHEN 4 THEN concat('SELECT c_mktsegment, avg(c_acctbal) FROM customer GROUP BY c_mktsegment HAVING max(c_acctbal) > ', CAST(o_custkey AS STRING))
 WHEN 5 THEN concat('SELECT c_custkey FROM customer WHERE c_nationkey = ', CAST(o_custkey % 25 AS STRING), ' UNION ALL SELECT s_suppkey FROM supplier WHERE s_nationkey = ', CAST(o_custkey % 25 AS STRING))
 WHEN 6 THEN concat('select c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus != ''F'' and o_custkey < ', CAST(o_custkey AS STRING), ')')
 WHEN 7 THEN concat('SELECT n_name FROM nation WHERE n_regionkey <> ', CAST(o_custkey % 5 AS STRING), ' EXCEPT SELECT n_name FROM nation WHERE n_nationkey BETWEEN 3 AND 7')
 WHEN 8 THEN 'SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus IS NOT NULL ORDER BY o_orderpriority ASC LIMIT 3'
 WHEN 9 THEN 'SELECT T2.n_name, sum(T1.c_acctbal) FROM customer AS T1 LEFT JOIN nation AS T2 ON T1.c_nationkey = T2.n_nationkey GROUP BY T2.n_name'
 WHEN 10 THEN concat('SELECT CASE WHEN o_totalprice >= ', CAST(o_custkey AS STRING), ' THEN "big" ELSE "small" END, round(o_totalprice * 2 - 1) FROM orders WHERE o_orderpriority LIKE ''1%''')
 ELSE concat('SELECT cast(substr(p_brand, 7) as integer), min(p_size) FROM part WHERE NOT p_size = ', CAST(o_custkey % 50 AS STRING), ' GROUP BY 1') END"""

EXEMPLAR_COLUMNS = {
    "ex_id": "CAST(o_orderkey AS BIGINT)",
    "db_id": "concat('db_', CAST(o_custkey % 20 AS STRING))",
    "question": _QUESTION_CASE,
    "query": _QUERY_CASE,
}

EXEMPLARS_SQL = "SELECT " + ",\n".join(f"{e} AS {n}" for n, e in EXEMPLAR_COLUMNS.items()) + "\nFROM orders"


def exemplar_keys(spark: SparkSession, sf_dir: str, with_vector: bool = False) -> DataFrame:
    """The columns of `orders` that exemplars are made of, dealt out to all tasks: they are a few bytes a row, so one task of
    the scan reads millions, and what takes time is the text made of them. ``with_vector`` keeps those of which `embeddings`
    has a vector, so that no text of the others is made or shuffled."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if with_vector:
        ids = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("o_orderkey"))
        orders = orders.join(ids, "o_orderkey", "left_semi")
    return orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def exemplars(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """`exemplars(ex_id, db_id, question, query)`: one exemplar per order row, or per row of ``keys`` (`exemplar_keys`)."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey") if keys is None else keys
    return orders.select(*[F.expr(e).alias(n) for n, e in EXEMPLAR_COLUMNS.items()])


def exemplar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`exemplars JOIN embeddings ON ex_id = vec_id`: exemplar text with its vector."""
    ex = exemplars(spark, sf_dir)
    emb = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ex_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return ex.join(emb, "ex_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as `(vec_id, label, vec ARRAY<DOUBLE>)`."""
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
