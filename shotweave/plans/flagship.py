"""Flagship plan: exemplars -> features -> hybrid pool -> best pair per target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.operators import portfolio as pf
from shotweave.plans.portfolio_plans import RED, _pool_members
from shotweave.sources.tables import exemplars


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best two-shot portfolio for every exemplar that has a vector, with the
    chosen exemplars' questions."""
    best = pf.best_pair(_pool_members(spark, sf_dir), redundancy=RED)
    q = exemplars(spark, sf_dir).select("ex_id", "question")
    return (best.join(q.select(F.col("ex_id").alias("target_id"), F.col("question").alias("target_question")),
                      "target_id")
            .join(q.select(F.col("ex_id").alias("cand_i"), F.col("question").alias("shot_1")), "cand_i")
            .join(q.select(F.col("ex_id").alias("cand_j"), F.col("question").alias("shot_2")), "cand_j")
            .select("target_id", "target_question", "cand_i", "shot_1", "cand_j", "shot_2", "sinr"))
