"""Linking joins rows per question with rows per question: none of these sides is broadcast, and only grams that can match are built."""

from pyspark.sql import functions as F

from shotweave.operators import linking as lk
from test_linking_prompting import _catalog


def _questions(spark):
    rows = [(1, "d", "Show the name of the stadium called Camp Nou with capacity over 9000"), (2, "d", "stadium id of 7 ?"),
            (3, "d", ""), (4, "d", None), (5, "e", "name of the stadium"), (5, "d", "the year"), (None, "d", "concert year")]
    return spark.createDataFrame(rows, "q_id long, db_id string, question string").withColumn("toks", lk.tokenize_question(F.col("question")))


def _cells(spark):
    return spark.createDataFrame([("stadium", "Name", "Camp Nou")], "table_name_orig string, col_name_orig string, cell string")


def test_only_grams_that_begin_a_name_are_built(spark):
    q, cols = _questions(spark), _catalog(spark)
    few, every = lk.question_ngrams(q, columns=cols), lk.question_ngrams(q)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert 0 < few.count() < every.count()
    assert {r.db_id for r in few.collect()} == {"d"}
    assert rows(lk.link_exact(few, cols)) == rows(lk.link_exact(every, cols))
    assert rows(lk.link_partial(few, cols)) == rows(lk.link_partial(every, cols))
    assert (2, 0, "col", 1, "CEM") in {tuple(r) for r in lk.link_partial(few, cols).collect()}  # "stadium id", whole


def _question_joins(df):
    """The joins on q_id of the first plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [x for x in lines if "Join" in x and "[q_id#" in x]


def test_no_side_with_rows_per_question_is_broadcast(spark):
    q, cols, cells = _questions(spark), _catalog(spark), _cells(spark)
    links = lk.all_links(q, cols, cells)
    tables = lk.linked_tables(q, links, cols)
    for df in (lk.mask_question(q, links), lk.question_pattern(q, links), tables,
               lk.linked_table_recall(q.withColumn("query", F.lit("select year from concert")), tables, cols)):
        joins = _question_joins(df)
        assert joins and not [x for x in joins if "Broadcast" in x], joins
        assert "BuildLeft" not in df._jdf.queryExecution().executedPlan().toString()  # questions are on the left of catalog rows
    tokens = lk.link_cells_partial(q, cols, lk.cell_index(cells)[0])
    assert "SortMergeJoin [db_id#" in tokens._jdf.queryExecution().executedPlan().toString()


def test_links_are_shifted_and_listed_from_one_pass(spark):
    q, cols, cells = _questions(spark), _catalog(spark), _cells(spark)
    links = lk.all_links(q, cols, cells)
    assert "Join" not in lk.shift_links(spark.createDataFrame(links.collect(), links.schema))._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(r) for r in lk.linked_tables(q, links, cols).collect()}
    assert {(1, 0), (2, 0), (3, 0), (3, 1), (None, 0), (None, 1)} <= got
    assert (5, 1) in got and (4, 0) in got
