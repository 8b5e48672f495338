from shotweave.operators import catalog as cat
from shotweave.sources import corpus as cp


def test_duplicates_on_a_hot_key(spark):
    # a third of all rows share one (db_id, question)
    rows = [(i, "d0", "hot question") for i in range(300)] + [(300 + i, f"d{i % 7}", f"q{i % 50}") for i in range(600)]
    df = spark.createDataFrame(rows, "idx long, db_id string, question string")
    got = {r.idx for r in cp.duplicate_questions(df).collect()}
    seen, want = set(), set()
    for i, db, q in rows:  # brute force: second and later occurrence of each key
        if (db, q) in seen:
            want.add(i)
        seen.add((db, q))
    assert got == want


def test_fk_components_merge_across_a_bridge(spark, tmp_path):
    # 1-2 and 3-4 are separate sets until the key 2-3 bridges them: one component rooted at 1
    from shotweave.session import checkpoint_dir

    checkpoint_dir(spark)
    rows = [("d", -1, None, None, 0, "*", "*", "text", False, None)]
    rows += [("d", 0, "t", "t", i, f"c{i}", f"c{i}", "number", False, fk) for i, fk in
             [(1, None), (2, 1), (3, None), (4, 3), (5, None)]]
    rows.append(("d", 1, "u", "u", 6, "c6", "c6", "number", False, 2))
    cols = spark.createDataFrame(rows, "db_id string, table_id int, table_name string, table_name_orig string, "
                                       "col_id int, col_name string, col_name_orig string, col_type string, "
                                       "is_pk boolean, fk_col_id int")
    extra = spark.createDataFrame([("d", 1, "u", "u", 7, "c7", "c7", "number", False, 3)], cols.schema)
    roots = {r.col_id: r.root for r in cat.fk_equivalence(cols.unionByName(extra)).collect()}
    # edges: 2-1, 4-3, 6-2, 7-3 -> components {1,2,6} and {3,4,7}
    assert roots == {1: 1, 2: 1, 6: 1, 3: 3, 4: 3, 7: 3}
    bridge = spark.createDataFrame([("d", 1, "u", "u", 8, "c8", "c8", "number", False, 4)], cols.schema)
    link = spark.createDataFrame([("d", 1, "u", "u", 9, "c9", "c9", "number", False, 6)], cols.schema)
    # 8-4 joins the second set; 9-6 joins the first; still two components
    roots2 = {r.col_id: r.root for r in cat.fk_equivalence(cols.unionByName(extra).unionByName(bridge)
                                                            .unionByName(link)).collect()}
    assert roots2[8] == 3 and roots2[9] == 1
    # now column 3 itself references column 2: the two sets become one component rooted at 1
    bridged = cols.unionByName(extra).where("col_id <> 3").unionByName(
        spark.createDataFrame([("d", 0, "t", "t", 3, "c3", "c3", "number", False, 2)], cols.schema))
    roots3 = {r.col_id: r.root for r in cat.fk_equivalence(bridged).collect()}
    assert roots3 == {1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 7: 1}
