"""Execution, repair and evaluation of query workloads.

Results are long tables `(task_id, cand_id, row_no, vals ARRAY<STRING>)`: one row
per result row of candidate `cand_id` for task `task_id` (values as text, NULL
kept; `normalise_values` brings numbers to one form). Comparisons run per task as
grouped counts and keyed joins, so a huge result never meets the driver. Column
order is taken out by colouring columns (`resultmatch`), and only columns that stay
tied are mapped by search; votes and accuracy group candidates by a fingerprint of their rows.
"""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.utils import AnalysisException

from shotweave.functions.sqltext import read_only_reason
from shotweave.operators import resultmatch

RESULT_ROWS_KEPT = 50   # rows of a statement's result that are shown, never what is compared


# ----------------------------------------------------------------------- guard
def read_only_guard(df: DataFrame, sql_col: str) -> DataFrame:
    """Add `safe` and `reason` (first refused word, in list order, anywhere in the text)."""
    reason = read_only_reason(F.col(sql_col))
    return df.withColumn("reason", reason).withColumn("safe", reason.isNull())


# ------------------------------------------------------------- multiset tools
# A candidate without result rows does not show in `results`: functions take the list of
# candidates(task_id, cand_id) beside it, and count those as empty results.

def normalise_values(vals: Column) -> Column:
    """Numbers in one form: `1`, `1.0` and `1.00` are equal, `1.50` is `1.5`, `1e5` is `100000`; other text stays."""
    whole = lambda v: F.regexp_replace(v, r"^([+-]?[0-9]+)\.0*$", "$1")
    plain = lambda v: F.regexp_replace(whole(v), r"^([+-]?[0-9]*\.[0-9]*[1-9])0+$", "$1")
    power = lambda v: F.coalesce(v.try_cast("double").try_cast("decimal(38,18)").cast("string"), v)
    return F.transform(vals, lambda v: plain(F.when(v.rlike(r"^[+-]?[0-9]*\.?[0-9]+[eE][+-]?[0-9]+$"), power(v)).otherwise(v)))


def candidate_pairs(candidates: DataFrame) -> DataFrame:
    """All ordered pairs cand_a < cand_b of candidates of the same task."""
    c = candidates.select("task_id", "cand_id").distinct()
    return (c.select("task_id", F.col("cand_id").alias("cand_a"))
            .join(c.select("task_id", F.col("cand_id").alias("cand_b")), "task_id")
            .where(F.col("cand_a") < F.col("cand_b")))


def _distinct_rows(results: DataFrame, ordered: bool = False) -> DataFrame:
    """(task_id, cand_id, place, vals, n): distinct rows, numbers in one form, with counts; with ``ordered`` a row's
    place among its candidate's counts too (else it is 0)."""
    place = F.row_number().over(Window.partitionBy("task_id", "cand_id").orderBy("row_no")) if ordered else F.lit(0)
    rows = results.select("task_id", "cand_id", place.alias("place"), normalise_values(F.col("vals")).alias("vals"))
    return rows.groupBy("task_id", "cand_id", "place", "vals").agg(F.count(F.lit(1)).alias("n"))


def _counts(results: DataFrame, ordered: bool = False) -> DataFrame:
    """Distinct rows of each candidate as text, with their counts."""
    return _distinct_rows(results, ordered).select("task_id", "cand_id", F.concat_ws(" ", F.col("place").cast("string"), F.to_json("vals")).alias("rk"), "n")


def _equal_counts(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(task_id, cand_a, cand_b) with `equal`: the same keys with the same counts; no keys at all are equal too."""
    size = counts.groupBy("task_id", "cand_id").agg(F.count(F.lit(1)).alias("d"))
    of = lambda df, side: df.withColumnRenamed("cand_id", f"cand_{side}")
    keys = ["task_id", "cand_a", "cand_b"]
    common = (pairs.join(of(counts, "a"), ["task_id", "cand_a"]).join(of(counts, "b"), ["task_id", "cand_b", "rk", "n"])
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("m")))
    return (pairs.join(of(size, "a").withColumnRenamed("d", "da"), ["task_id", "cand_a"], "left")
            .join(of(size, "b").withColumnRenamed("d", "db"), ["task_id", "cand_b"], "left")
            .join(common, keys, "left").fillna(0, ["da", "db", "m"])
            .select(*keys, ((F.col("da") == F.col("db")) & (F.col("m") == F.col("da"))).alias("equal")))


def result_multiset_equal(results: DataFrame, pairs: DataFrame | None = None, candidates: DataFrame | None = None,
                          ordered: bool = False) -> DataFrame:
    """Same rows (column order as given) with the same counts; NULL equals NULL. With ``ordered`` the rows must also
    come in the same order of row_no."""
    pairs = candidate_pairs(results if candidates is None else candidates) if pairs is None else pairs
    return _equal_counts(_counts(results, ordered), pairs)


def result_quick_reject(results: DataFrame, pairs: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Necessary test: the sets of rows with values sorted inside each row are equal (two empty results pass)."""
    pairs = candidate_pairs(results if candidates is None else candidates) if pairs is None else pairs
    s = results.select("task_id", "cand_id", F.to_json(F.array_sort(normalise_values(F.col("vals")))).alias("rk"), F.lit(1).alias("n")).distinct()
    return _equal_counts(s, pairs).withColumnRenamed("equal", "passes")


def _cells(results: DataFrame) -> DataFrame:
    return results.select("task_id", "cand_id", "row_no", F.posexplode(normalise_values(F.col("vals"))).alias("col", "v"))


def result_column_candidates(results: DataFrame, pairs: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(task_id, cand_a, cand_b, col_a, col_b): column col_b of b can stand for column
    col_a of a, i.e. every value of b's column occurs in a's column; NULL is a value."""
    pairs = candidate_pairs(results if candidates is None else candidates) if pairs is None else pairs
    cv = _cells(results).select("task_id", "cand_id", "col", "v").distinct()
    a = cv.select("task_id", F.col("cand_id").alias("cand_a"), F.col("col").alias("col_a"), F.col("v").alias("va"))
    b = cv.select("task_id", F.col("cand_id").alias("cand_b"), F.col("col").alias("col_b"), F.col("v").alias("vb"))
    grid = (pairs.join(a.select("task_id", "cand_a", "col_a").distinct(), ["task_id", "cand_a"])
            .join(b.select("task_id", "cand_b", "col_b").distinct(), ["task_id", "cand_b"]))
    b_vals = grid.join(b, ["task_id", "cand_b", "col_b"]).alias("x")
    # a b-value missing from a's column rules the pair of columns out
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("task_id", "cand_a", "col_a")]
    ruled_out = b_vals.join(a.alias("y"), [*same, F.col("x.vb").eqNullSafe(F.col("y.va"))], "left_anti")
    keys = ["task_id", "cand_a", "cand_b", "col_a", "col_b"]
    return (grid.join(ruled_out.select(*keys).distinct(), keys, "left_anti")
            .select("task_id", "cand_a", "cand_b", F.col("col_a").cast("int"), F.col("col_b").cast("int")))


def result_equal(results: DataFrame, pairs: DataFrame | None = None, candidates: DataFrame | None = None,
                 ordered: bool = False) -> DataFrame:
    """Equal under some permutation of b's columns, as multisets of rows (with ``ordered``: as lists). Both empty ->
    equal whatever the width; different row counts or widths -> not equal. row_no must tell a candidate's rows apart."""
    pairs = candidate_pairs(results if candidates is None else candidates) if pairs is None else pairs
    matched = resultmatch.Results(_distinct_rows(results, ordered))
    coloured = _equal_counts(matched.rows, pairs)
    if matched.tied.isEmpty():
        return coloured
    tied = matched.tied.select("task_id", F.col("cand_id").alias("cand_a"))
    coloured = coloured.join(tied.withColumn("tied", F.lit(True)), ["task_id", "cand_a"], "left").checkpoint()
    open_ = F.col("equal") & F.col("tied").isNotNull()  # equal colours are necessary, and enough where nothing is tied
    found = matched.tied_equal(coloured.where(open_)).withColumn("found", F.lit(True))
    return (coloured.join(found, ["task_id", "cand_a", "cand_b"], "left")
            .select("task_id", "cand_a", "cand_b", F.when(open_, F.col("found").isNotNull()).otherwise(F.col("equal")).alias("equal")))


def result_fingerprints(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """(task_id, cand_id, fp): two candidates of a task have one fp if `result_equal` finds them equal; an empty result
    has its own. Row count and two 64-bit sums over the rows, one pass without pairs; candidates with tied columns and
    the same sums are compared with the first of them, what is unequal with the first of the rest, and so on."""
    matched = resultmatch.Results(_distinct_rows(results))
    total = lambda *cols: F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))
    fp = matched.rows.groupBy("task_id", "cand_id").agg(F.sum("n").alias("r"), total("rk", "n").alias("h"), total(F.lit(1), "rk", "n").alias("g"))
    fp = fp.select("task_id", "cand_id", F.concat_ws(",", F.col("r").cast("string"), F.col("h").cast("string"), F.col("g").cast("string")).alias("fp"))
    if not matched.tied.isEmpty():
        tied = matched.tied.select("task_id", "cand_id")
        parts, rest = [fp.join(tied, ["task_id", "cand_id"], "left_anti")], fp.join(tied, ["task_id", "cand_id"])
        while not (rest := rest.checkpoint()).isEmpty():
            led = rest.join(rest.groupBy("task_id", "fp").agg(F.min("cand_id").alias("cand_a")), ["task_id", "fp"]).withColumnRenamed("cand_id", "cand_b")
            same = matched.tied_equal(led.where("cand_a <> cand_b")).withColumn("same", F.lit(True))
            told = led.join(same, ["task_id", "cand_a", "cand_b"], "left").withColumn("same", F.col("same").isNotNull() | (F.col("cand_a") == F.col("cand_b"))).checkpoint()
            parts.append(told.where("same").select("task_id", F.col("cand_b").alias("cand_id"), F.concat_ws(",", "fp", F.col("cand_a").cast("string")).alias("fp")))
            rest = told.where("not same").select("task_id", F.col("cand_b").alias("cand_id"), "fp")
        fp = reduce(DataFrame.unionByName, parts)
    return candidates.select("task_id", "cand_id").distinct().join(fp, ["task_id", "cand_id"], "left").fillna("0", ["fp"])


def vote_by_result(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per task: group runnable candidates by equal results (empty results are equal);
    take the first candidate of the largest group, ties to the group seen first;
    no runnable candidate -> the first candidate.
    candidates(task_id, cand_id, cand_no, runnable)."""
    run = candidates.where("runnable")
    groups = (run.join(result_fingerprints(results, run), ["task_id", "cand_id"])
              .groupBy("task_id", "fp").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("cand_no", "cand_id")).alias("lead")))
    best = groups.groupBy("task_id").agg(F.min(F.struct((-F.col("size")).alias("order"), "lead", "size")).alias("b"))
    first = candidates.groupBy("task_id").agg(F.min_by("cand_id", "cand_no").alias("first_cand"))
    return (first.join(best, "task_id", "left")
            .select("task_id", F.coalesce("b.lead.cand_id", "first_cand").alias("chosen"),
                    F.coalesce("b.size", F.lit(0).cast("long")).alias("group_size")))


def execution_accuracy(results: DataFrame, pred: str, gold: str, candidates: DataFrame | None = None) -> DataFrame:
    """Share of the tasks with a gold candidate whose predicted result equals it (column order free). A gold or
    predicted result without rows counts as empty if ``candidates`` lists it; a task without prediction is wrong."""
    listed = (results if candidates is None else candidates).select("task_id", "cand_id").distinct()
    fp = result_fingerprints(results.where(F.col("cand_id").isin(gold, pred)), listed.where(F.col("cand_id").isin(gold, pred)))
    side = lambda c, name: fp.where(F.col("cand_id") == c).select("task_id", F.col("fp").alias(name))
    both = side(gold, "g").join(side(pred, "p"), "task_id", "left")
    return both.agg(F.lit(pred).alias("pred"), F.count(F.lit(1)).alias("n_tasks"),
                    F.round(F.avg(F.coalesce(F.col("g") == F.col("p"), F.lit(False)).cast("double")), 6).alias("accuracy"))


# ------------------------------------------------------------------ workloads
def _run_one(spark: SparkSession, r, max_rows: int):
    if not r["safe"]:
        return (r["qid"], False, 0, None, None, "READ_ONLY_GUARD", f"refused: {r['reason']}")
    try:
        df = spark.sql(r["sql"])
        rows = df.limit(max_rows + 1).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
                                             .alias("j")).collect()
        n = len(rows) if len(rows) <= max_rows else df.count()
        return (r["qid"], True, n, df.columns, [x["j"] for x in rows[:max_rows]], None, None)
    except AnalysisException as e:
        return (r["qid"], False, 0, None, None, e.getCondition() or "ANALYSIS", str(e).split("\n")[0])
    except Exception as e:  # noqa: BLE001
        cond = getattr(e, "getCondition", lambda: None)() or type(e).__name__
        return (r["qid"], False, 0, None, None, cond, str(e).split("\n")[0])


def run_workload(spark: SparkSession, queries: DataFrame, max_rows: int = RESULT_ROWS_KEPT,
                 parallel: int = 4) -> DataFrame:
    """Run each (qid, sql) as its own Spark job; the driver only submits, from a small
    thread pool so independent statements share the cluster. Keeps at most
    ``max_rows`` rows as JSON text to show (n_rows is the whole result's count; results
    are compared from tables, never from these), or the error condition and message. Refused
    statements (read-only guard) are not run. Returns
    (qid, ok, n_rows, columns, rows_json, error_class, error)."""
    from concurrent.futures import ThreadPoolExecutor

    guarded = read_only_guard(queries, "sql").select("qid", "sql", "safe", "reason")
    stmts = list(guarded.toLocalIterator())  # statements, not data; results are bounded
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        out = list(pool.map(lambda r: _run_one(spark, r, max_rows), stmts))
    return spark.createDataFrame(out, "qid long, ok boolean, n_rows long, columns array<string>, "
                                      "rows_json array<string>, error_class string, error string")


MIN_RATIO = 0.5   # of the closest name that may stand for an unknown one


def _characters(df: DataFrame, name: str, out: str) -> DataFrame:
    """(db_id, name, out) with one row per character; its second occurrence in a name is another one."""
    chars = df.select("db_id", name, F.posexplode(F.split(name, "")).alias("at", "ch")).where(F.col("ch") != "")
    again = F.row_number().over(Window.partitionBy("db_id", name, "ch").orderBy("at"))
    return chars.select("db_id", name, F.concat(F.col("ch"), again.cast("string")).alias(out))


@F.pandas_udf(DoubleType())
def _block_ratio(name: pd.Series, bad: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, n, b).ratio() for n, b in zip(name, bad)], dtype=float)


def closest_names(bad: DataFrame, names: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(db_id, bad, name): per distinct (db_id, bad) the name of its database with the greatest matching-block ratio,
    if it is at least ``min_ratio``; of equal ones the last by name.

    The characters that two names share, as multisets, bound the ratio from above. They are counted by a join on
    characters; only pairs whose bound reaches ``min_ratio`` are compared in full, each once."""
    bad, names = bad.select("db_id", "bad").distinct(), names.select("db_id", "name").distinct()
    shared = (_characters(bad, "bad", "ch").join(_characters(names, "name", "ch"), ["db_id", "ch"])
              .groupBy("db_id", "bad", "name").agg(F.count(F.lit(1)).alias("m")))
    can = shared.where(2 * F.col("m") >= min_ratio * (F.length("bad") + F.length("name")))
    ratio = can.withColumn("ratio", _block_ratio("name", "bad")).where(F.col("ratio") >= min_ratio)
    return ratio.groupBy("db_id", "bad").agg(F.max(F.struct("ratio", "name")).alias("b")).select("db_id", "bad", F.col("b.name").alias("name"))


def repair_identifier(failures: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """Pick a replacement for an unknown column (kind "column") or table (kind
    "table"). failures(fid, db_id, bad); names(db_id, name, ord) in catalog order.

    column: first name equal to, containing, or contained in the bad one (case-
    insensitive); table: equal, or equal to the bad one without trailing `s`.
    Otherwise the closest name with a matching-block ratio >= 0.5 (`closest_names`).
    Both are looked up once per distinct (database, bad name) and joined back."""
    distinct = failures.select("db_id", "bad").distinct()
    bad_l, name_l = F.lower("bad"), F.lower("name")
    if kind == "column":
        rule = (name_l == bad_l) | (F.instr(bad_l, name_l) > 0) | (F.instr(name_l, bad_l) > 0)
    else:
        rule = (name_l == bad_l) | (name_l == F.expr("TRIM(TRAILING 's' FROM lower(bad))"))
    first = distinct.join(names, "db_id").where(rule).groupBy("db_id", "bad").agg(F.min(F.struct("ord", "name")).alias("f"))
    first = first.select("db_id", "bad", F.col("f.name").alias("by_rule"))
    fuzzy = closest_names(distinct.join(first, ["db_id", "bad"], "left_anti"), names).withColumnRenamed("name", "by_ratio")
    return (failures.join(first, ["db_id", "bad"], "left").join(fuzzy, ["db_id", "bad"], "left")
            .select("fid", "db_id", "bad", F.coalesce("by_rule", "by_ratio").alias("replacement"),
                    F.when(F.col("by_rule").isNotNull(), "rule").when(F.col("by_ratio").isNotNull(), "ratio")
                    .alias("method")))


def apply_repair(sql: Column, bad: Column, replacement: Column) -> Column:
    """Replace the bad identifier as a whole word, any case."""
    pattern = F.concat(F.lit("(?i)\\b"), F.regexp_replace(bad, r"([\\.\[\]\(\)\*\+\?\^\$\|\{\}])", "\\\\$1"),
                       F.lit("\\b"))
    literal = F.regexp_replace(replacement, r"([\\$])", r"\\$1")
    return F.when(replacement.isNull(), sql).otherwise(F.regexp_replace(sql, pattern, literal))


def repair_rounds(spark: SparkSession, queries: DataFrame, names_col: DataFrame, names_tab: DataFrame,
                  n_rounds: int = 3) -> DataFrame:
    """Run, repair only the failed statements, run again; at most ``n_rounds``
    repairs. queries(qid, db_id, sql); names_*(db_id, name, ord) in catalog order.
    Returns the history (iteration, qid, ok, error_class, sql, repaired_sql, method).
    Unknown names come from Spark's error parameters (objectName / relationName)."""
    current = queries.select("qid", "db_id", "sql")
    history = []
    for it in range(n_rounds + 1):
        res = run_workload(spark, current.select("qid", "sql"))
        res = res.join(current, "qid")
        history.append(res.select(F.lit(it).alias("iteration"), "qid", "ok", "error_class", "sql"))
        failed = res.where(~F.col("ok") & F.col("error_class").isin(
            "UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION", "TABLE_OR_VIEW_NOT_FOUND"))
        if it == n_rounds or failed.limit(1).count() == 0:
            break
        # names come quoted part by part (`T1`.`names`); the last part is the unknown one
        last_part = lambda text: F.regexp_extract(F.element_at(F.split(text, r"\."), -1), "`([^`]+)`", 1)
        quoted = r"((?:`[^`]+`\.)*`[^`]+`)"
        bad = last_part(F.regexp_extract("error", f"with name {quoted}", 1))
        bad_t = last_part(F.regexp_extract("error", f"The table or view {quoted}", 1))
        f = failed.select("qid", "db_id", "sql", "error_class",
                          F.when(F.col("error_class").startswith("UNRESOLVED_COLUMN"), bad)
                          .otherwise(bad_t).alias("bad"))
        cols = repair_identifier(f.where(F.col("error_class").startswith("UNRESOLVED_COLUMN"))
                                 .select(F.col("qid").alias("fid"), "db_id", "bad"), names_col, "column")
        tabs = repair_identifier(f.where(F.col("error_class") == "TABLE_OR_VIEW_NOT_FOUND")
                                 .select(F.col("qid").alias("fid"), "db_id", "bad"), names_tab, "table")
        fixes = cols.unionByName(tabs).withColumnRenamed("fid", "qid")
        repaired = f.join(fixes.select("qid", "replacement", "method"), "qid", "left").select(
            "qid", "db_id", apply_repair(F.col("sql"), F.col("bad"), F.col("replacement")).alias("sql"), "method")
        history[-1] = history[-1].join(repaired.select("qid", F.col("sql").alias("repaired_sql"), "method"), "qid", "left")
        current = repaired.select("qid", "db_id", "sql").cache()
    out = None
    for h in history:
        if "repaired_sql" not in h.columns:
            h = h.withColumn("repaired_sql", F.lit(None).cast("string")).withColumn("method", F.lit(None).cast("string"))
        out = h if out is None else out.unionByName(h)
    return out


def workload_outcomes(history: DataFrame) -> DataFrame:
    """Per question: final status and number of repairs; success share per round
    is the mean of `ok` per iteration (see `round_success`)."""
    w = Window.partitionBy("qid").orderBy(F.desc("iteration"))
    last = history.withColumn("r", F.row_number().over(w)).where("r = 1")
    return last.select("qid", F.when(F.col("ok"), "SUCCESS").otherwise("FAILED").alias("status"),
                       F.col("iteration").alias("n_repairs"))


def round_success(history: DataFrame) -> DataFrame:
    return history.groupBy("iteration").agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_share"))
