"""Similarity of SQL skeletons as a join over distinct skeletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _members(skeletons: DataFrame, side: str) -> DataFrame:
    """One row per token of a skeleton; a token's second occurrence is another member, so that multisets become sets."""
    tokens = skeletons.select(F.col("skel").alias(f"{side}_skel"), F.posexplode(F.split(F.trim("skel"), " ")).alias("at", "tok"))
    again = F.row_number().over(Window.partitionBy(f"{side}_skel", "tok").orderBy("at"))
    return tokens.select(f"{side}_skel", F.concat_ws(" ", again.cast("string"), "tok").alias("m"), F.size(F.split(F.trim(f"{side}_skel"), " ")).alias(f"{side}_n"))


def _jaccard(shared: Column) -> Column:
    return shared / (F.col("t_n") + F.col("c_n") - shared)


def overlapping_skeletons(left: DataFrame, right: DataFrame) -> DataFrame:
    """(t_skel, c_skel, jaccard): pairs of distinct skeletons with a common token, by an inverted list of tokens."""
    t, c = _members(left.select("skel").distinct(), "t"), _members(right.select("skel").distinct(), "c")
    return t.join(c, "m").groupBy("t_skel", "c_skel", "t_n", "c_n").agg(F.count(F.lit(1)).alias("shared")).select(
        "t_skel", "c_skel", _jaccard(F.col("shared")).alias("jaccard"))


def similar_skeletons(left: DataFrame, right: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(t_skel, c_skel, jaccard): pairs of distinct skeletons whose multiset Jaccard is at least ``threshold``.

    A prefix-filter join: with members ordered from the rarest, two sets that similar share one of their first
    n - ceil(threshold * n) + 1 members, and neither is shorter than ``threshold`` times the other. What meets there is
    counted in full. left(skel), right(skel); nulls match nothing.
    """
    t = _members(left.select("skel").where(F.col("skel").isNotNull()).distinct(), "t")
    c = _members(right.select("skel").where(F.col("skel").isNotNull()).distinct(), "c")
    df = t.select("m").unionByName(c.select("m")).groupBy("m").agg(F.count(F.lit(1)).alias("df"))

    def prefix(members: DataFrame, side: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(f"{side}_skel").orderBy("df", "m"))
        n = F.col(f"{side}_n")
        return members.join(df, "m").withColumn("place", place).where(F.col("place") <= n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).select(f"{side}_skel", f"{side}_n", "m")

    sizes = (F.col("c_n") >= threshold * F.col("t_n") - 1e-9) & (F.col("t_n") >= threshold * F.col("c_n") - 1e-9)
    met = prefix(t, "t").join(prefix(c, "c"), "m").where(sizes).select("t_skel", "c_skel").distinct()
    both = met.join(t, "t_skel").join(c, ["c_skel", "m"]).groupBy("t_skel", "c_skel", "t_n", "c_n").agg(F.count(F.lit(1)).alias("shared"))
    return both.select("t_skel", "c_skel", _jaccard(F.col("shared")).alias("jaccard")).where(F.col("jaccard") >= threshold)
