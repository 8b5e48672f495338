import json

from pyspark.sql import functions as F

from shotweave.operators import evaluate as ev
from shotweave.plans.linking_plans import link_questions
from shotweave.sources import corpus as cp


def _res(spark, rows):
    return spark.createDataFrame(rows, "task_id long, cand_id string, row_no long, vals array<string>")


def test_result_equal_properties(spark):
    rows = [(1, "a", 0, ["1", "x"]), (1, "a", 1, ["2", "y"]), (1, "a", 2, ["2", "y"]),
            (1, "b", 0, ["y", "2"]), (1, "b", 1, ["x", "1"]), (1, "b", 2, ["y", "2"]),
            (1, "c", 0, ["1", "x"]), (1, "c", 1, ["1", "x"]), (1, "c", 2, ["2", "y"])]
    got = {(r.cand_a, r.cand_b): r.equal for r in ev.result_equal(_res(spark, rows)).collect()}
    assert got[("a", "b")] is True      # column order does not matter
    assert got[("a", "c")] is False     # multiplicities matter
    ms = {(r.cand_a, r.cand_b): r.equal for r in ev.result_multiset_equal(_res(spark, rows)).collect()}
    assert ms[("a", "b")] is False and ms[("a", "c")] is False


def test_vote(spark):
    rows = [(1, "a", 0, ["1"]), (1, "b", 0, ["2"]), (1, "c", 0, ["2"])]
    cands = spark.createDataFrame([(1, "a", 1, True), (1, "b", 2, True), (1, "c", 3, True)],
                                  "task_id long, cand_id string, cand_no int, runnable boolean")
    r = ev.vote_by_result(_res(spark, rows), cands).first()
    assert r["chosen"] == "b" and r["group_size"] == 2


def test_empty_results_are_compared(spark):
    res = _res(spark, [(1, "c", 0, ["1"])])
    cands = spark.createDataFrame([(1, "a", 1, True), (1, "b", 2, True), (1, "c", 3, True)], "task_id long, cand_id string, cand_no int, runnable boolean")
    for f in (ev.result_equal, ev.result_multiset_equal):
        assert {(r.cand_a, r.cand_b): r.equal for r in f(res, candidates=cands).collect()} == {("a", "b"): True, ("a", "c"): False, ("b", "c"): False}
    assert {r.passes for r in ev.result_quick_reject(res, candidates=cands).collect()} == {True, False}
    vote = ev.vote_by_result(res, cands).first()
    assert (vote.chosen, vote.group_size) == ("a", 2)
    acc = ev.execution_accuracy(res, pred="b", gold="a", candidates=cands).first()
    assert (acc.n_tasks, acc.accuracy) == (1, 1.0)


def test_wide_null_and_ordered_results(spark):
    wide = [str(i) for i in range(9)]
    rows = [(1, "a", 0, wide), (1, "a", 1, wide[::-1]), (1, "b", 0, wide[::-1]), (1, "b", 1, wide), (2, "a", 0, [None, "x"]), (2, "b", 0, ["x", None]), (2, "c", 0, ["x", "x"])]
    got = {(r.task_id, r.cand_a, r.cand_b): r.equal for r in ev.result_equal(_res(spark, rows)).collect()}
    assert got == {(1, "a", "b"): True, (2, "a", "b"): True, (2, "a", "c"): False, (2, "b", "c"): False}
    plain = _res(spark, [(1, "a", 0, ["1"]), (1, "a", 1, ["2"]), (1, "b", 5, ["2"]), (1, "b", 9, ["1"])])
    assert [ev.result_multiset_equal(plain, ordered=o).first().equal for o in (False, True)] == [True, False]
    cols = {(r.col_a, r.col_b) for r in ev.result_column_candidates(_res(spark, [(1, "a", 0, [None, "x"]), (1, "b", 0, [None, "x"])])).collect()}
    assert cols == {(0, 0), (1, 1)}


def test_columns_with_equal_values_are_told_apart(spark):
    # every column holds {1, 2}; only a's and b's rows pair them alike
    rows = [(1, "a", 0, ["1", "2", "1"]), (1, "a", 1, ["2", "1", "2"]), (1, "b", 0, ["1", "1", "2"]), (1, "b", 1, ["2", "2", "1"]), (1, "c", 0, ["1", "1", "1"]), (1, "c", 1, ["2", "2", "2"])]
    got = {(r.cand_a, r.cand_b): r.equal for r in ev.result_equal(_res(spark, rows)).collect()}
    assert got == {("a", "b"): True, ("a", "c"): False, ("b", "c"): False}


def test_numbers_in_one_form(spark):
    df = spark.createDataFrame([(["1", "1.0", "1.", "-2.50", "0.500", "10", "100000", "x1.0", None, "100", "-0.00015", "1e99", "abc"],)], "v array<string>")
    assert df.select(ev.normalise_values(F.col("v")).alias("v")).first().v == ["1", "1", "1", "-2.5", "0.5", "10", "100000", "x1.0", None, "100", "-0.00015", "1e99", "abc"]


def test_qualified_names_are_repaired(spark):
    spark.createDataFrame([(1, "Camp Nou")], "id int, name string").createOrReplaceTempView("stadium")
    q = spark.createDataFrame([(1, "d", "SELECT T1.names FROM stadium AS T1")], "qid long, db_id string, sql string")
    cols = spark.createDataFrame([("d", "id", 0), ("d", "name", 1)], "db_id string, name string, ord int")
    tabs = spark.createDataFrame([("d", "stadium", 0)], "db_id string, name string, ord int")
    out = {r.qid: r.status for r in ev.workload_outcomes(ev.repair_rounds(spark, q, cols, tabs)).collect()}
    assert out == {1: "SUCCESS"}
    fixed = spark.range(1).select(ev.apply_repair(F.lit("a bad b"), F.lit("bad"), F.lit("x$1\\y"))).first()[0]
    assert fixed == "a x$1\\y b"


def test_run_workload_and_repair(spark):
    spark.createDataFrame([(1, "Stade de France", 81338), (2, "Wembley Stadium", 90000), (3, "Camp Nou", 99354)],
                          "Stadium_ID int, Name string, Capacity int").createOrReplaceTempView("stadium")
    q = spark.createDataFrame([(1, "SELECT Names, Capacities FROM stadium"), (2, "DROP TABLE stadium")],
                              "qid long, sql string")
    out = {r.qid: r for r in ev.run_workload(spark, q).collect()}
    assert out[2].error_class == "READ_ONLY_GUARD"
    assert not out[1].ok and "UNRESOLVED_COLUMN" in out[1].error_class
    names = spark.createDataFrame([("d", "Stadium_ID", 0), ("d", "Name", 1), ("d", "Capacity", 2)],
                                  "db_id string, name string, ord int")
    fails = spark.createDataFrame([(1, "d", "Names"), (2, "d", "Capacities")], "fid long, db_id string, bad string")
    fix = {r.fid: (r.replacement, r.method) for r in ev.repair_identifier(fails, names, "column").collect()}
    assert fix[1] == ("Name", "rule") and fix[2] == ("Capacity", "ratio")
    repaired = spark.createDataFrame([(1, "SELECT Names, Capacities FROM stadium")], "qid long, sql string").select(
        "qid", ev.apply_repair(ev.apply_repair(F.col("sql"), F.lit("Names"), F.lit("Name")),
                               F.lit("Capacities"), F.lit("Capacity")).alias("sql"))
    res = ev.run_workload(spark, repaired).first()
    assert res.ok and res.n_rows == 3


def test_closest_names_against_difflib(spark):
    import difflib
    import random

    rnd = random.Random(6)
    letters = "abcde_"
    names = [("d", "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9)))) for _ in range(60)] + [("e", "Abc"), ("e", "abC")]
    bad = [(d, "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9)))) for d in "de" for _ in range(60)] + [("e", "abc"), ("e", "zz")]
    got = {(r.db_id, r.bad): r.name for r in ev.closest_names(spark.createDataFrame(bad, "db_id string, bad string"), spark.createDataFrame(names, "db_id string, name string")).collect()}
    want = {}
    for d, b in set(bad):
        close = difflib.get_close_matches(b, sorted({n for x, n in names if x == d}), n=1, cutoff=0.5)
        if close:
            want[d, b] = close[0]
    assert got == want and ("e", "zz") not in got and len(got) > 30


def test_tables_named_in_questions(spark):
    from shotweave.operators.catalog import prune_tables_by_name

    cols = [("d", 0, "Orders", 1), ("d", 1, "ss", 2), ("d", 2, "customers", 3), ("e", 0, "boss", 1), ("e", 1, "ref", 2)]
    cols = spark.createDataFrame([(d, t, n, c, "x", "text") for d, t, n, c in cols], "db_id string, table_id int, table_name_orig string, col_id int, col_name_orig string, col_type string")
    asked = [(1, "e", "The BO of it"), (2, "e", "nothing"), (3, "d", ""), (4, "d", "an order"), (5, "e", "refs and bosses"), (6, "e", None)]
    got = {}
    for r in prune_tables_by_name(spark.createDataFrame(asked, "q_id long, db_id string, question string"), cols).collect():
        got.setdefault(r.q_id, set()).add(r.table_name)
    assert got == {1: {"boss"}, 2: {"boss", "ref"}, 3: {"ss"}, 4: {"Orders", "ss"}, 5: {"boss", "ref"}, 6: {"boss", "ref"}}


def test_loaders_round_trip(spark, tmp_path):
    items = [{"question": "q0", "query": "select 1", "db_id": "d", "question_toks": ["q0"]},
             {"question": "q1", "query": "select 2", "db_id": "e", "question_toks": ["q1"]}]
    p = tmp_path / "train.json"
    p.write_text(json.dumps(items))
    c = cp.load_corpus(spark, str(p), "train").orderBy("idx").collect()
    assert [(r.idx, r.question, r.split) for r in c] == [(0, "q0", "train"), (1, "q1", "train")]
    g = tmp_path / "gold.sql"
    g.write_text("select 1\nselect\t2\n")
    assert [r.query for r in cp.load_gold_sql(spark, str(g)).orderBy("idx").collect()] == ["select 1", "select\t2"]
    lk = tmp_path / "links.jsonl"
    lk.write_text(json.dumps({"sc_link": {"q_col_match": {"0,3": "CEM"}, "q_tab_match": {}},
                              "cv_link": {"num_date_match": {}, "cell_match": {"2,4": "EXACTMATCH"}}}) + "\n\n")
    links = {(r.kind, r.tok_pos, r.obj_id, r.flag) for r in cp.load_linking(spark, str(lk)).collect()}
    assert links == {("col", 0, 3, "CEM"), ("cell", 2, 4, "EXACTMATCH")}


def test_links_are_parsed_in_one_pass(spark, tmp_path):
    lines = [{"sc_link": {"q_col_match": {"0,3": "CEM", "1,4": None}, "q_tab_match": {"2,0": "TPM"}}, "cv_link": None}, {"cv_link": {"num_date_match": {"5,6": "NUMBER"}}}]
    (tmp_path / "links.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    links = cp.load_linking(spark, str(tmp_path / "links.jsonl"))
    assert {tuple(r) for r in links.collect()} == {(0, "col", 0, 3, "CEM"), (0, "col", 1, 4, None), (0, "tab", 2, 0, "TPM"), (1, "num", 5, 6, "NUMBER")}
    assert links._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(links") == 1


def test_questions_to_link_are_dealt_out(spark):
    questions = link_questions(spark, "/root/testdata/sf0.001")
    assert questions.rdd.getNumPartitions() >= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
