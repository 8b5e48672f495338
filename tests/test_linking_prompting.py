from pyspark.sql import functions as F

from shotweave.operators import linking as lk
from shotweave.operators import prompting as pr
from shotweave.sources import corpus as cp


def _catalog(spark):
    rows = [("d", -1, None, None, 0, "*", "*", "text", False, None),
            ("d", 0, "stadium", "stadium", 1, "stadium id", "Stadium_ID", "number", True, None),
            ("d", 0, "stadium", "stadium", 2, "name", "Name", "text", False, None),
            ("d", 0, "stadium", "stadium", 3, "capacity", "Capacity", "number", False, None),
            ("d", 1, "concert", "concert", 4, "year", "Year", "text", False, None)]
    return spark.createDataFrame(rows, "db_id string, table_id int, table_name string, table_name_orig string, "
                                       "col_id int, col_name string, col_name_orig string, col_type string, "
                                       "is_pk boolean, fk_col_id int")


def test_schema_and_cell_links(spark):
    q = spark.createDataFrame([(1, "d", "Show the name of the stadium called Camp Nou with capacity over 9000")],
                              "q_id long, db_id string, question string")
    q = q.withColumn("toks", lk.tokenize_question(F.col("question")))
    cells = spark.createDataFrame([("stadium", "Name", "Camp Nou"), ("stadium", "Name", "Wembley Stadium")],
                                  "table_name_orig string, col_name_orig string, cell string")
    links = {(r.tok_pos, r.kind, r.obj_id, r.flag) for r in lk.all_links(q, _catalog(spark), cells).collect()}
    assert (2, "col", 2, "CEM") in links          # "name" equals the column words
    assert (5, "tab", 0, "TEM") in links          # "stadium" equals the table
    assert (5, "col", 1, "CPM") in links          # "stadium" is a word prefix of "stadium id"
    assert (5, "cell", 2, "PARTIALMATCH") in links  # a word of "Wembley Stadium", not a whole cell
    assert (7, "cell", 2, "EXACTMATCH") in links and (8, "cell", 2, "EXACTMATCH") in links  # "camp nou"
    assert (12, "num", 3, "NUMBER") in links and (12, "num", 1, "NUMBER") in links
    masked = lk.mask_question(q, lk.all_links(q, _catalog(spark), cells)).first()["masked"]
    assert masked == "show the <mask> of the <mask> called <unk> <unk> with <mask> over <unk>"
    shifted = {(r.tok_pos, r.kind, r.obj_id) for r in lk.shift_links(lk.all_links(q, _catalog(spark), cells)).collect()}
    assert (5, "tab", 0) in shifted and (5, "col", 1) not in shifted   # exact link kept, partial dropped
    assert (5, "cell", 2) not in shifted and (7, "cell", 2) in shifted  # cells only where no schema link


def test_pack_prompt_skips_and_continues(spark):
    targets = spark.createDataFrame([(1, "T" * 400)], "target_id long, target_text string")
    # the second shot is too long for the budget; the third still fits
    shots = spark.createDataFrame([(1, 1, 10, "a" * 100), (1, 2, 11, "b" * 2000), (1, 3, 12, "c" * 100)],
                                  "target_id long, rk int, cand_id long, example_text string")
    r = pr.pack_prompt(targets, shots, k=5, max_seq_len=300, max_ans_len=50).first()
    assert list(r["kept"]) == [10, 12] and r["n_examples"] == 2
    assert r["prompt"].startswith(pr.EXAMPLE_STYLES["QA"]["prefix"]) and r["prompt"].endswith("T" * 400)
    none = pr.pack_prompt(targets, shots, k=5, max_seq_len=100, max_ans_len=50).first()
    assert none["n_examples"] == 0 and none["prompt"] == "T" * 400


def test_write_linking_round_trip(spark, tmp_path):
    links = spark.createDataFrame([("dev", 0, "col", 1, 3, "CEM"), ("dev", 0, "cell", 2, 4, "EXACTMATCH")],
                                  "section string, idx long, kind string, tok_pos int, obj_id int, flag string")
    out = str(tmp_path / "links")
    cp.write_linking(links, out)
    back = spark.read.json(out).where("section = 'dev'").first()
    assert back["sc_link"]["q_col_match"]["1,3"] == "CEM"
    assert back["cv_link"]["cell_match"]["2,4"] == "EXACTMATCH"
