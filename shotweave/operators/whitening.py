"""Covariance whitening, clutter statistics and threshold calibration.

Vectors are `(vec_id, vec ARRAY<DOUBLE>)`. The D x D moments are reduced on the
executors (per-partition partial Gram matrices, then a sum keyed by (i, j)); only
D x D numbers reach the driver, where the inverse square root is solved once and
shipped back as a broadcast constant. Sizes are independent of the row count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.operators.knn import block_knn, block_rank_stats
from shotweave.operators.ranks import with_position

RIDGE = 1e-5          # added to the covariance diagonal
PERCENTILE = 0.85     # calibration rank
CLAMP_LOW, CLAMP_HIGH, CLAMP_TRIGGER = 9.0, 13.0, 13.0
CLUTTER_SKIP = 50     # ranks 0..49 are the main lobe
PSEUDO_PEAK_RANK = 200


def embedding_mean(vecs: DataFrame) -> DataFrame:
    """(i, mu): per-dimension means."""
    return (vecs.select(F.posexplode("vec").alias("i", "x"))
            .groupBy("i").agg(F.avg("x").alias("mu")).select(F.col("i").cast("int"), "mu"))


def _mean_vector(vecs: DataFrame) -> np.ndarray:
    rows = embedding_mean(vecs).collect()  # D numbers
    mu = np.zeros(len(rows))
    for r in rows:
        mu[r["i"]] = r["mu"]
    return mu


def embedding_covariance(vecs: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """(i, j, c): sample covariance (n - 1) plus ``ridge`` on the diagonal.

    Each partition emits its centred partial Gram matrix as (i, j, s) rows; a
    keyed sum adds them, so the shuffle is D x D per task whatever the row count."""
    mu = _mean_vector(vecs)
    d = len(mu)

    def partial(batches):
        g = np.zeros((d, d))
        n = 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["vec"].to_numpy()).astype(np.float64) - mu
            g += x.T @ x
            n += len(pdf)
        if n:
            ii, jj = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
            yield pd.DataFrame({"i": ii.ravel().astype(np.int32), "j": jj.ravel().astype(np.int32),
                                "s": g.ravel(), "n": np.full(d * d, n, dtype=np.int64)})

    parts = vecs.select("vec").mapInPandas(partial, "i int, j int, s double, n long")
    summed = parts.groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return summed.select("i", "j", (F.col("s") / (F.col("n") - 1)
                                    + F.when(F.col("i") == F.col("j"), F.lit(ridge)).otherwise(F.lit(0.0))).alias("c"))


def _matrix(df: DataFrame, value: str) -> np.ndarray:
    rows = df.collect()  # D x D numbers
    d = max(r["i"] for r in rows) + 1
    m = np.zeros((d, d))
    for r in rows:
        m[r["i"], r["j"]] = r[value]
    return m


def whitening_matrix(cov: DataFrame) -> DataFrame:
    """(i, j, w): W = C^(-1/2) (symmetric inverse square root, real part)."""
    c = _matrix(cov, "c")
    vals, vecs = np.linalg.eigh((c + c.T) / 2)
    w = (vecs * (1.0 / np.sqrt(vals))) @ vecs.T
    d = w.shape[0]
    ii, jj = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
    spark = cov.sparkSession
    pdf = pd.DataFrame({"i": ii.ravel().astype(np.int32), "j": jj.ravel().astype(np.int32), "w": w.ravel()})
    return spark.createDataFrame(pdf)


def apply_whitening(vecs: DataFrame, mean: DataFrame, w: DataFrame) -> DataFrame:
    """`(x - mu) W` for every vector; mu and W (D and D x D numbers) ride in the task closure."""
    mu = np.zeros(0)
    rows = mean.collect()
    mu = np.zeros(len(rows))
    for r in rows:
        mu[r["i"]] = r["mu"]
    wm = _matrix(w, "w")
    keep = [c for c in vecs.columns if c != "vec"]
    schema = vecs.select(*keep, F.col("vec")).schema

    def apply(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            out = pdf[keep].copy()
            out["vec"] = list((x - mu) @ wm)
            yield out

    return vecs.select(*keep, "vec").mapInPandas(apply, schema)


def whiten(vecs: DataFrame) -> DataFrame:
    """Convenience: mean, covariance, W, applied."""
    mean = embedding_mean(vecs)
    w = whitening_matrix(embedding_covariance(vecs))
    return apply_whitening(vecs, mean, w)


def calibration_sample(vecs: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """All vectors, or on request the first n in `md5(seed:vec_id)` order."""
    if n is None:
        return vecs
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")))
    return vecs.withColumn("_k", key).orderBy("_k", "vec_id").limit(n).drop("_k")


def _t_stats(stats: DataFrame, peak_rank: int, skip: int) -> DataFrame:
    """From (target_id, top, n, s, ss): peak = top[peak_rank]; clutter = all but the
    first ``skip`` ranks; T = (peak - mean) / (population sd + 1e-9)."""
    top = F.col("top")
    head = F.slice(top, 1, skip)
    hs = F.aggregate(head, F.lit(0.0), lambda a, x: a + x)
    hss = F.aggregate(head, F.lit(0.0), lambda a, x: a + x * x)
    m = F.col("n") - F.size(head)
    mean = (F.col("s") - hs) / m
    var = F.greatest((F.col("ss") - hss) / m - mean * mean, F.lit(0.0))
    sd = F.sqrt(var)
    peak = F.element_at(top, peak_rank + 1)
    ok = m > 0
    return stats.select(
        F.col("target_id").alias("vec_id"), F.round(peak, 6).alias("peak"),
        F.when(ok, F.round(mean, 6)).alias("clutter_mean"), F.when(ok, F.round(sd, 6)).alias("clutter_sd"),
        F.when(ok, F.round((peak - mean) / (sd + 1e-9), 6)).alias("t_score"))


def clutter_stats_cross_domain(sample: DataFrame, vecs: DataFrame) -> DataFrame:
    """Per sampled vector: best cosine among other domains (peak), and the mean /
    population sd of ranks 51.. of that list (clutter). vecs(vec_id, vec, domain)."""
    t = sample.select(F.col("vec_id").alias("target_id"), "vec", "domain")
    c = vecs.select(F.col("vec_id").alias("cand_id"), "vec", "domain")
    stats = block_rank_stats(t, c, CLUTTER_SKIP, metric="cosine", exclude_same_domain=True)
    return _t_stats(stats, 0, CLUTTER_SKIP)


def clutter_stats_no_domain(sample: DataFrame, vecs: DataFrame) -> DataFrame:
    """Without domains: pseudo-peak at rank min(200, n // 2) of the full list (the
    vector itself included), clutter from 50 ranks later."""
    n = vecs.count()
    p = min(PSEUDO_PEAK_RANK, n // 2)
    t = sample.select(F.col("vec_id").alias("target_id"), "vec")
    c = vecs.select(F.col("vec_id").alias("cand_id"), "vec")
    stats = block_rank_stats(t, c, p + CLUTTER_SKIP, metric="cosine")
    return _t_stats(stats, p, p + CLUTTER_SKIP)


def calibrate_threshold(t_scores: DataFrame) -> DataFrame:
    """eta = T at 0-based rank int(0.85 n) (capped n - 1); if above 13, mean + 1.5 sd
    (population) clamped into [9, 13]. Ranks come from sorted range partitions."""
    t = t_scores.where(F.col("t_score").isNotNull()).select("t_score")
    ranked = with_position(t, ["t_score"], "r")
    agg = ranked.agg(F.count(F.lit(1)).alias("n"), F.avg("t_score").alias("mean_t"),
                     F.stddev_pop("t_score").alias("sd_t"))
    pick = ranked.join(agg, how="inner", on=F.col("r") == F.least(
        F.floor(F.col("n") * PERCENTILE).cast("long"), F.col("n") - 1))
    robust = F.least(F.greatest(F.col("mean_t") + 1.5 * F.col("sd_t"), F.lit(CLAMP_LOW)), F.lit(CLAMP_HIGH))
    return pick.select(F.col("n").cast("long").alias("n"), F.round("t_score", 6).alias("t_at_rank"),
                       F.round(F.when(F.col("t_score") > CLAMP_TRIGGER, robust).otherwise(F.col("t_score")), 6)
                       .alias("eta"))


def detect_topk(targets: DataFrame, vecs: DataFrame, eta: float, k: int) -> DataFrame:
    """Top-k cosine per target (no domain rule), its T over all candidates with
    clutter = ranks 51.., and T > eta. targets / vecs: (vec_id, vec)."""
    t = targets.select(F.col("vec_id").alias("target_id"), "vec")
    c = vecs.select(F.col("vec_id").alias("cand_id"), "vec")
    top = block_knn(t, c, k, metric="cosine", exclude_same_domain=False, exclude_self=False)
    stats = _t_stats(block_rank_stats(t, c, CLUTTER_SKIP, metric="cosine"), 0, CLUTTER_SKIP)
    det = stats.select(F.col("vec_id").alias("target_id"), "t_score",
                       (F.col("t_score") > F.lit(eta)).alias("detected"))
    return top.join(det, "target_id")
