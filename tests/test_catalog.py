import json

from shotweave.operators import catalog as cat
from shotweave.sources.catalog import load_schema_catalog, read_schema_json


def test_tables_json_round_trip(spark, tmp_path):
    db = {"db_id": "concert_singer",
          "table_names": ["stadium", "concert"], "table_names_original": ["stadium", "concert"],
          "column_names": [[-1, "*"], [0, "stadium id"], [0, "name"], [1, "concert id"], [1, "stadium id"]],
          "column_names_original": [[-1, "*"], [0, "Stadium_ID"], [0, "Name"], [1, "concert_ID"], [1, "Stadium_ID"]],
          "column_types": ["text", "number", "text", "number", "text"],
          "primary_keys": [1, [3, 4]], "foreign_keys": [[4, 1]]}
    p = tmp_path / "tables.json"
    p.write_text(json.dumps([db]))
    raw = read_schema_json(spark, str(p))
    cols = {r.col_id: r for r in load_schema_catalog(raw).collect()}
    assert cols[0].table_id == -1 and cols[0].col_name_orig == "*"
    assert cols[1].is_pk and cols[3].is_pk and cols[4].is_pk and not cols[2].is_pk
    assert cols[4].fk_col_id == 1 and cols[4].table_name_orig == "concert"
    fks = [r.fk for r in cat.catalog_foreign_keys(load_schema_catalog(raw)).collect()]
    assert fks == ["concert.Stadium_ID = stadium.Stadium_ID"]
    first = [(r.table_name, r.pk_col) for r in cat.catalog_primary_keys(load_schema_catalog(raw),
                                                                        first_only=True).orderBy("table_name").collect()]
    assert first == [("concert", "concert_ID"), ("stadium", "Stadium_ID")]


def test_prune_tables_searches_questions_and_cuts_none(spark):
    """Stems, an empty stem, repeated and null questions; the plan explodes nothing of a question and shuffles none."""
    names = [("a", 0, "orders"), ("a", 1, "Part"), ("a", 2, "lineitem"), ("b", 0, "s"), ("b", 1, "nation")]
    cols = spark.createDataFrame([(d, t, n) for d, t, n in names], "db_id string, table_id int, table_name_orig string")
    asked = [(1, "a", "Which ORDER has a part?"), (1, "a", "orders"), (2, "a", "none"), (3, "a", None), (4, "b", ""), (5, None, "part"), (6, "c", "part")]
    pruned = cat.prune_tables_by_name(spark.createDataFrame(asked, "q_id long, db_id string, question string"), cols)
    every = ["Part", "lineitem", "orders"]
    want = [(1, "Part"), (1, "orders"), (1, "orders"), *((2, n) for n in every), *((3, n) for n in every), (4, "s")]
    assert sorted((r.q_id, r.table_name) for r in pruned.collect()) == want
    plan = pruned._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "LeftAnti" not in plan
