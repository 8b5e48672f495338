import numpy as np
from pyspark.sql import functions as F

from shotweave.operators import portfolio as pf
from shotweave.operators import whitening as wh


def _vecs(spark, n=300, d=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    return spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "vec_id long, vec array<double>"), x


def test_whitening_identity(spark):
    v, x = _vecs(spark)
    cov = wh.embedding_covariance(v)
    c = wh._matrix(cov, "c")
    assert np.allclose(c, np.cov(x.T) + 1e-5 * np.eye(x.shape[1]))
    w = wh._matrix(wh.whitening_matrix(cov), "w")
    assert np.allclose(w @ c @ w, np.eye(c.shape[0]), atol=1e-8)
    white = np.stack([r.vec for r in wh.whiten(v).orderBy("vec_id").collect()])
    assert np.allclose(np.cov(white.T), np.eye(c.shape[0]), atol=1e-3)


def test_calibration_clamp(spark):
    scores = spark.createDataFrame([(float(t),) for t in [1, 2, 20, 30, 40, 50, 60]], "t_score double")
    row = wh.calibrate_threshold(scores).first()
    assert row["t_at_rank"] == 50.0 and row["eta"] == 13.0
    low = spark.createDataFrame([(float(t),) for t in [1, 2, 3, 4]], "t_score double")
    assert wh.calibrate_threshold(low).first()["eta"] == 4.0


def _pool(spark):
    sqls = ["select a from t where x > 1", "select count(*) from t group by y", "select a from t order by b desc",
            "SELECT a FROM t WHERE x <> 2", "select b from u join v on u.i = v.i"]
    rng = np.random.default_rng(0)
    vec = rng.normal(size=(5, 4))
    vec[1] = vec[0]  # redundant pair at cosine 1.0
    rows = [(1, i + 1, 100 + i, s, vec[i].tolist()) for i, s in enumerate(sqls)]
    df = spark.createDataFrame(rows, "target_id long, pos int, cand_id long, q string, vec array<double>")
    from shotweave.functions import sqltext as st
    tf = st.sql_features(F.lit("select a from t where x > 1 order by b desc"))
    return df.select("target_id", "pos", "cand_id", st.sql_features(F.col("q")).alias("features"),
                     st.style_fingerprint(F.col("q")).alias("style"), "vec", tf.alias("tfeat"))


def test_sinr_bounds_and_redundancy(spark):
    pool = _pool(spark).withColumn("member_no", F.col("pos"))
    s = pf.portfolio_sinr(pool).first()
    assert 0.0 <= s["sinr"] <= 1.0
    two = pool.where("pos <= 2")
    inter = pf.portfolio_e_inter(two).first()["e_inter"]
    assert inter >= 0.9  # equal vectors: redundancy term fires at the 0.9 default


def test_search_matches_best_pair_at_k2(spark):
    pool = _pool(spark)
    bp = pf.best_pair(pool).first()
    bs = pf.portfolio_search(pool, 2, beam=100).collect()
    assert {r.cand_id for r in bs} == {bp["cand_i"], bp["cand_j"]}
    assert abs(bs[0]["sinr"] - bp["sinr"]) < 1e-9
