"""Which results are equal under some permutation of their columns, decided exactly.

Columns get colours that don't depend on their order: first from the multiset of their values, then, as long as that tells
more of them apart, from their values together with the colours and values around them in each row. Columns with the same
value in every row stand for one, with their number. Where all colours differ, the only mapping between two results pairs
equal colours, and sorting each row by colour makes results comparable as multisets of rows.

Where refinement ends with tied columns, one column of a tied class is given a colour of its own, in the first result a
fixed one, in the second each of the class in turn, and refinement goes on from there; a branch whose colours differ
between the two is dropped, and one that has told all columns apart is checked by its rows and their counts. Pairs of
results of at most ``LOCAL_CELLS`` cells are searched inside a task, depth first. For larger ones branches are rows of a
table, worked on for all open pairs at once, the deepest first; a pair is unequal when it has none left.

Each step is one join of rows with the colours of their result and one sum per column; only results with tied columns
take part in more than the first.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.session import checkpoint_dir

_KEY = ["task_id", "cand_id"]
#: Branches of a pair that are worked on in one round; the others wait.
BRANCHES = 16
#: Results with tied columns and at most this many cells are compared inside a task, larger ones by rounds.
LOCAL_CELLS = 1 << 18


def _sum_hash(*cols) -> Column:
    return F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))


def _n_distinct(colours: str) -> Column:
    return F.size(F.array_distinct(colours))


def _apart(colours: str) -> Column:
    return _n_distinct(colours) == F.size(colours)


def column_colours(rows: DataFrame) -> DataFrame:
    """Per result: ``keep``, the first column of each set of identical ones, and their first ``colours``.

    rows(task_id, cand_id, place, vals, n) are the distinct rows of results with their counts."""
    row = F.xxhash64("place", F.to_json("vals"))
    cells = rows.select(*_KEY, "place", "n", row.alias("row"), F.posexplode("vals").alias("col", "v")).withColumn("nil", F.col("v").isNull())
    columns = cells.groupBy(*_KEY, "col").agg(_sum_hash("place", "v", "nil", "n").alias("h"), _sum_hash("row", "v", "nil").alias("same"), _sum_hash("v", "nil", "row").alias("same2"))
    one = columns.groupBy(*_KEY, "same", "same2").agg(F.min("col").alias("col"), F.count(F.lit(1)).alias("m"), F.min("h").alias("h"))
    listed = one.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("col", F.xxhash64("h", "m").alias("c")))).alias("s"))
    return rows.select(*_KEY).distinct().join(listed, _KEY, "left").select(
        *_KEY, F.coalesce(F.transform("s", lambda x: x["col"]), F.array().cast("array<int>")).alias("keep"),
        F.coalesce(F.transform("s", lambda x: x["c"]), F.array().cast("array<bigint>")).alias("colours"))


def _finer(rows: DataFrame, views: DataFrame) -> DataFrame:
    """(vid, finer): colours one step further, from each row's cells with their colours."""
    cell = F.transform(F.arrays_zip("vals", "colours"), lambda x: F.xxhash64(x["vals"], x["vals"].isNull(), x["colours"]))
    seen = rows.join(views, _KEY).select("vid", "place", "n", cell.alias("cells"))
    seen = seen.withColumn("sig", F.xxhash64(F.array_sort("cells"), "place", "n"))
    columns = seen.select("vid", "sig", F.posexplode("cells").alias("col", "cell")).groupBy("vid", "col").agg(_sum_hash("cell", "sig").alias("h"))
    return columns.groupBy("vid").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "h"))), lambda x: F.xxhash64(x["h"])).alias("finer"))


def refined(rows: DataFrame, views: DataFrame) -> DataFrame:
    """views(vid, task_id, cand_id, colours, ...) with colours refined until no step tells more columns apart."""
    parts, open_ = [views.where(_apart("colours"))], views.where(~_apart("colours"))
    while True:
        open_ = open_.checkpoint()
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        both = open_.join(_finer(rows, open_), "vid").checkpoint()
        further = both.where(_n_distinct("finer") > _n_distinct("colours")).withColumn("colours", F.col("finer")).drop("finer")
        parts += [both.where(_n_distinct("finer") <= _n_distinct("colours")).drop("finer"), further.where(_apart("colours"))]
        open_ = further.where(~_apart("colours"))


def _sorted_rows(rows: DataFrame, views: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rk, n): rows as text with the values in the order of their columns' colours."""
    vals = F.array_sort(F.transform(F.arrays_zip("colours", "vals"), lambda x: F.struct(x["colours"].alias("c"), x["vals"].alias("v"))))
    key = F.concat_ws(" ", F.col("place").cast("string"), F.to_json(vals))
    return rows.join(views, _KEY).groupBy(*by, key.alias("rk")).agg(F.sum("n").alias("n"))


class Results:
    """Results with coloured columns: ``rows`` to compare, and ``tied``, those that colours can't compare alone."""

    def __init__(self, rows: DataFrame):
        checkpoint_dir(rows.sparkSession)
        columns = column_colours(rows).checkpoint()
        self.kept = rows.join(columns.select(*_KEY, "keep"), _KEY).select(*_KEY, "place", "n", F.transform("keep", lambda i: F.get("vals", i)).alias("vals"))
        first = columns.select(*_KEY, "colours")
        self.tied_rows = self.kept.join(first.where(~_apart("colours")).select(*_KEY), _KEY, "left_semi").checkpoint()
        views = refined(self.tied_rows, first.withColumn("vid", F.struct(*_KEY)))
        self.views = views.drop("vid").checkpoint()
        self.tied = self.views.where(~_apart("colours"))
        self.rows = _sorted_rows(self.kept, self.views, _KEY)

    def tied_equal(self, pairs: DataFrame) -> DataFrame:
        """Of pairs(task_id, cand_a, cand_b) of tied results those that some mapping makes equal."""
        cells = self.tied_rows.groupBy(*_KEY).agg(F.sum(F.size("vals")).alias("cells"))
        cells = {s: cells.select("task_id", F.col("cand_id").alias(f"cand_{s}"), F.col("cells").alias(f"cells_{s}")) for s in "ab"}
        ids = pairs.select("task_id", "cand_a", "cand_b").withColumn("pid", F.monotonically_increasing_id())
        ids = ids.join(cells["a"], ["task_id", "cand_a"]).join(cells["b"], ["task_id", "cand_b"])
        ids = ids.withColumn("local", F.greatest("cells_a", "cells_b") <= LOCAL_CELLS).drop("cells_a", "cells_b").checkpoint()
        found = self._searched_in_tasks(ids.where("local"))
        large = ids.where("not local")
        found = found if large.isEmpty() else found.unionByName(self._searched_in_rounds(large))
        return ids.join(found, "pid", "left_semi").select("task_id", "cand_a", "cand_b")

    def _searched_in_tasks(self, ids: DataFrame) -> DataFrame:
        side = lambda s: (ids.select("pid", "task_id", F.col(f"cand_{s}").alias("cand_id"), F.lit(s).alias("side")).join(self.tied, _KEY)
                          .join(self.tied_rows, _KEY).select("pid", "side", "colours", "place", "n", "vals"))
        return side("a").unionByName(side("b")).groupBy("pid").applyInArrow(_search_group, "pid long")

    def _searched_in_rounds(self, ids: DataFrame) -> DataFrame:
        none = F.array().cast("array<int>")
        open_ = ids.drop("local").withColumns({"path_a": none, "path_b": none})
        found = [ids.where(F.lit(False)).select("pid")]
        while True:
            open_ = open_.checkpoint()
            if open_.isEmpty():
                return reduce(DataFrame.unionByName, found).distinct()
            turn = F.row_number().over(Window.partitionBy("pid").orderBy(F.size("path_b").desc(), "path_b"))
            numbered = open_.withColumn("turn", turn).checkpoint()
            now = numbered.where(F.col("turn") <= BRANCHES).drop("turn")
            views = self._views(now)
            sides = {s: views.where(F.col("vid.side") == s).select(F.col("vid.pid").alias("pid"), F.col("vid.path").alias(f"path_{s}"), F.col("colours").alias(f"c_{s}")) for s in "ab"}
            met = now.join(sides["a"], ["pid", "path_a"]).join(sides["b"], ["pid", "path_b"]).where(F.array_sort("c_a") == F.array_sort("c_b")).checkpoint()
            equal = self._equal_rows(met.where(_apart("c_a")), views).checkpoint()
            found.append(equal)
            left = numbered.where(F.col("turn") > BRANCHES).drop("turn").unionByName(_branched(met.where(~_apart("c_a"))))
            open_ = left.join(equal, "pid", "left_anti")

    def _views(self, branches: DataFrame) -> DataFrame:
        """Refined colours of both results of each branch, the columns of its paths told apart first."""
        side = lambda s: branches.select("task_id", F.col(f"cand_{s}").alias("cand_id"), F.struct(F.col("pid"), F.lit(s).alias("side"), F.col(f"path_{s}").alias("path")).alias("vid")).distinct()
        views = side("a").unionByName(side("b")).join(self.tied, _KEY)
        own = F.transform("colours", lambda c, i: F.when(F.array_contains("vid.path", i), F.xxhash64(c, F.array_position("vid.path", i))).otherwise(c))
        return refined(self.tied_rows, views.withColumn("colours", own)).checkpoint()

    def _equal_rows(self, branches: DataFrame, views: DataFrame) -> DataFrame:
        """pid of the branches whose rows are the same, with the same counts, once both are sorted by colour."""
        rows = _sorted_rows(self.tied_rows, views, ["vid"])
        side = lambda s: branches.select("pid", "path_a", "path_b", F.struct(F.col("pid"), F.lit(s).alias("side"), F.col(f"path_{s}").alias("path")).alias("vid")).join(
            rows, "vid").select("pid", "path_a", "path_b", "rk", F.when(F.lit(s == "a"), F.col("n")).otherwise(-F.col("n")).alias("n"))
        branch = ["pid", "path_a", "path_b"]
        apart = side("a").unionByName(side("b")).groupBy(*branch, "rk").agg(F.sum("n").alias("n")).where("n <> 0").select(*branch)
        return branches.select(*branch).join(apart, branch, "left_anti").select("pid").distinct()


def _branched(met: DataFrame) -> DataFrame:
    """One column of the smallest tied class told apart: its first in a, each in turn in b."""
    count = lambda arr, c: F.size(F.filter(arr, lambda x: x == c))
    classes = F.transform(F.array_distinct("c_a"), lambda c: F.struct(count("c_a", c).alias("size"), c.alias("c")))
    chosen = F.array_min(F.filter(classes, lambda x: x["size"] > 1))["c"]
    met = met.withColumn("chosen", chosen)
    places = F.filter(F.transform("c_b", lambda c, i: F.when(c == F.col("chosen"), i)), lambda i: i.isNotNull())
    first = (F.array_position("c_a", F.col("chosen")) - 1).cast("int")
    return (met.withColumn("at", F.explode(places))
            .select("pid", "task_id", "cand_a", "cand_b", F.concat("path_a", F.array(first)).alias("path_a"), F.concat("path_b", F.array("at")).alias("path_b")))


# ----------------------------------------------------------- one pair in a task
def _refine(rows: list, colours: list[int]) -> list[int]:
    """Colours refined until no step tells more columns apart; rows are (place, n, values)."""
    while len(set(colours)) < len(colours):
        sums = [0] * len(colours)
        for place, n, vals in rows:
            sig = hash((place, n, *sorted(zip(colours, vals))))
            for j, v in enumerate(vals):
                sums[j] += hash((sig, v))
        finer = [hash((c, s)) for c, s in zip(colours, sums)]
        if len(set(finer)) == len(set(colours)):
            break
        colours = finer
    return colours


def _fits(rows_a: list, colours_a: list[int], rows_b: list, colours_b: list[int]) -> bool:
    """Whether some mapping of columns with equal colours makes the rows equal, by depth-first search."""
    open_ = [(colours_a, colours_b)]
    while open_:
        a, b = open_.pop()
        a, b = _refine(rows_a, a), _refine(rows_b, b)
        if sorted(a) != sorted(b):
            continue
        tied = [(a.count(c), c) for c in set(a) if a.count(c) > 1]
        if tied:
            c = min(tied)[1]
            first = a.index(c)
            one = [hash((c, 1)) if j == first else x for j, x in enumerate(a)]
            open_ += [(one, [hash((c, 1)) if j == k else x for j, x in enumerate(b)]) for k, y in enumerate(b) if y == c]
        elif _by_colour(rows_a, a) == _by_colour(rows_b, b):
            return True
    return False


def _by_colour(rows: list, colours: list[int]) -> Counter:
    order = sorted(range(len(colours)), key=colours.__getitem__)
    total = Counter()
    for place, n, vals in rows:
        total[place, *(vals[j] for j in order)] += n
    return total


def _search_group(pair: pa.Table) -> pa.Table:
    """pid of a pair whose two results are equal under some mapping; values become numbers for the search."""
    codes: dict = {}
    rows: dict[str, list] = {"a": [], "b": []}
    colours = {}
    for r in pair.to_pylist():
        rows[r["side"]].append((r["place"], r["n"], tuple(codes.setdefault(v, len(codes)) for v in r["vals"])))
        colours[r["side"]] = r["colours"]
    fits = _fits(rows["a"], colours["a"], rows["b"], colours["b"])
    return pair.select(["pid"]).slice(0, 1 if fits else 0)
