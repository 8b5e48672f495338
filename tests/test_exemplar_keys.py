"""Exemplars from given keys, and skeletons from one row of names per database."""

from shotweave.functions import sqltext as st
from shotweave.sources.tables import exemplar_keys, exemplars


def test_keys_with_vector_are_those_of_embeddings(spark, tmp_path):
    orders = [(i % 50, i % 7) for i in range(60)] + [(None, 3), (51, None)]  # the first ten twice
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i,) for i in (3, 3, 40, 51, 99)], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = lambda df: sorted(map(repr, df.collect()))
    every = exemplars(spark, str(tmp_path))
    assert rows(exemplars(spark, str(tmp_path), exemplar_keys(spark, str(tmp_path)))) == rows(every)
    assert rows(exemplars(spark, str(tmp_path), exemplar_keys(spark, str(tmp_path), with_vector=True))) == rows(every.where("ex_id in (3, 40, 51)"))


def test_skeleton_rows_are_not_shuffled_with_names(spark):
    names = spark.createDataFrame([("d1", ["t"], ["a", "b"], ["t"]), ("d2", ["u"], ["b"], ["u"])], "db_id string, tl array<string>, cl array<string>, torig array<string>")
    rows = spark.createDataFrame([(1, "d1", "SELECT a FROM t"), (2, "d1", "SELECT a FROM t"), (3, "d2", "SELECT a FROM t"), (4, "d2", None)], "ex_id int, db_id string, query string")
    out = st.with_sql_skeleton_once(rows, "query", "db_id", names)
    got = {r.ex_id: r.skel for r in out.collect()}
    assert got[1] == got[2] == "select _ from _" and got[3] == "select a from t" and got[4] is None
    assert set(out.columns) == {"ex_id", "db_id", "query", "skel"}
