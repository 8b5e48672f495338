"""Plan-shape checks: pushdown, pruning, and no Python in relational hot paths."""

from shotweave.plans import registry

SF = "/root/testdata/sf0.01"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_pushdown_and_pruning(spark):
    registry.load_all()
    plan = _plan(registry.QUERIES["q_project_filter"](spark, SF))
    assert "PushedFilters: [" in plan and "IsNotNull(o_totalprice)" in plan
    # the scan reads only the referenced columns (o_orderdate / o_orderpriority pruned)
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    assert "o_orderdate" not in scan and "o_orderpriority" not in scan


def test_semi_join_for_in_exists(spark):
    registry.load_all()
    plan = _plan(registry.QUERIES["q_in_exists"](spark, SF))
    assert "LeftSemi" in plan and "LeftAnti" in plan


def test_text_features_stay_in_jvm(spark):
    registry.load_all()
    plan = _plan(registry.QUERIES["sql_features"](spark, SF))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "WholeStageCodegen" in plan or "*(" in plan
