"""Properties on the smallest driver tables: cross-domain never violated, SINR in [0, 1]."""

from pyspark.sql import functions as F

from shotweave.plans import registry
from shotweave.sources.tables import exemplars, vectors

SF = "/root/testdata/sf0.001"


def test_cross_domain_rule(spark):
    registry.load_all()
    lab = vectors(spark, SF).select("vec_id", "label")
    knn = registry.QUERIES["knn_cosine"](spark, SF)
    bad = (knn.join(lab.withColumnRenamed("vec_id", "target_id").withColumnRenamed("label", "lt"), "target_id")
           .join(lab.withColumnRenamed("vec_id", "cand_id").withColumnRenamed("label", "lc"), "cand_id")
           .where(F.col("lt") == F.col("lc")))
    assert bad.count() == 0
    db = exemplars(spark, SF).select("ex_id", "db_id")
    for name in ("retrieve_random", "knn_preskeleton_backfill", "filter_same_question"):
        out = registry.QUERIES[name](spark, SF)
        same = (out.join(db.withColumnRenamed("ex_id", "target_id").withColumnRenamed("db_id", "dt"), "target_id")
                .join(db.withColumnRenamed("ex_id", "cand_id").withColumnRenamed("db_id", "dc"), "cand_id")
                .where(F.col("dt") == F.col("dc")))
        assert same.count() == 0, name
        assert out.groupBy("target_id").count().where("count > 5").count() == 0, name


def test_sinr_in_unit_interval(spark):
    registry.load_all()
    s = registry.QUERIES["portfolio_sinr"](spark, SF).agg(F.min("sinr"), F.max("sinr")).first()
    assert 0.0 <= s[0] <= s[1] <= 1.0
    bp = registry.QUERIES["best_pair"](spark, SF).agg(F.min("sinr"), F.max("sinr")).first()
    assert 0.0 <= bp[0] <= bp[1] <= 1.0
