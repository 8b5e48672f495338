"""Places of rows within their group, for groups that may be larger than a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.llm.shared import written

_ROW = (1 << 33) - 1  # the low bits of monotonically_increasing_id count the rows of a partition


def _same(names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names])


class Ranked:
    """Rows sorted by (group, order), nulls first, in range partitions of the whole table.

    A group may span partitions: its place in one is the row's number there plus what earlier partitions hold of it,
    so no task ever sees a whole group. The sorted rows are written once; the rest are sums per (group, partition).
    """

    def __init__(self, rows: DataFrame, group: list[str], order: list[str], name: str):
        keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
        self.group = group
        self.sorted = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                              .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))}), name)
        self._runs = self.sorted.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))

    def rows(self) -> DataFrame:
        """The rows with ``pos``, from 0 within each group, and ``n``, the rows of the group."""
        whole = Window.partitionBy(*self.group)
        before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        runs = self._runs.select(*self.group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                                 F.sum("_n").over(whole).alias("n"))
        met = self.sorted.alias("a").join(runs.alias("b"), _same([*self.group, "_part"]))
        own = [F.col(f"a.{c}") for c in self.sorted.columns if c not in ("_part", "_row")]
        return met.select(*own, (F.col("_row") - F.col("_first") + F.col("_before")).alias("pos"), F.col("b.n"))

    def groups(self) -> DataFrame:
        """One row per group: ``n`` rows, and ``seat``, its place from 0 among all groups in order."""
        starts = self._runs.groupBy(*self.group).agg(F.min(F.struct("_part", "_first")).alias("_at"), F.sum("_n").alias("n"))
        starts = starts.select(*self.group, "n", "_at._part", "_at._first")
        parts = starts.groupBy("_part").agg(F.count("*").alias("_starts"))  # a row per partition, however many groups there are
        ahead = parts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_starts").over(
            Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
        within = F.row_number().over(Window.partitionBy("_part").orderBy("_first")) - 1
        return starts.withColumn("_within", within).join(ahead, F.col("_part") == F.col("_p")).select(
            *self.group, "n", (F.col("_ahead") + F.col("_within")).alias("seat"))
