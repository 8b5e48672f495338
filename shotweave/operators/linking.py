"""Schema and cell-value linking as equi joins.

Questions are `(q_id, db_id, toks ARRAY<STRING>)`; the catalog is the long
`columns` table; cells are `(table_name_orig, col_name_orig, cell)` text values.
Links come out long: `(q_id, tok_pos, kind, obj_id, flag)` with kind in
col / tab / num / cell. N-gram matching is an equi join on the gram text
(exact names, and each name's word prefixes for partial matches), never a regex
theta join; cell matching joins lower-cased words against an exploded, distinct
word index of the cell values, never a scan per token.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotweave.session import checkpoint_dir

# ---------------------------------------------------------------------------
# English stop words (the common 179-word list) and punctuation.
# ---------------------------------------------------------------------------
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his "
    "himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom "
    "this that that'll these those am is are was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
    "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
PUNCTUATION = list(string.punctuation)
FLAGS = {"col_exact": "CEM", "col_partial": "CPM", "tab_exact": "TEM", "tab_partial": "TPM",
         "cell_exact": "EXACTMATCH", "cell_partial": "PARTIALMATCH"}
MAX_N = 5


def _large(rows: DataFrame) -> DataFrame:
    """A side with rows per question or per cell word, never broadcast: its size is judged by the files or by compressed
    blocks, and its tokens and links take many times that on the driver. What holds rows of the schema catalog alone is
    broadcast by name, for else the questions may be taken for the smaller side."""
    return rows.hint("merge")


def _skip():
    return F.array(*[F.lit(w) for w in STOPWORDS + PUNCTUATION])


def tokenize_question(question):
    """Lower-case word and punctuation tokens."""
    return F.regexp_extract_all(F.lower(question), F.lit(r"\w+|[^\w\s]"), 0)


def question_ngrams(questions: DataFrame, max_n: int = MAX_N, columns: DataFrame | None = None) -> DataFrame:
    """(q_id, db_id, n, pos, gram): every n-gram (n = 1..max_n) with its start; blank grams dropped.
    With ``columns`` only those that begin with the first word of a name of their database: no other gram
    equals a name or a word prefix of one, and the rest is never built."""
    at = questions.where(F.size("toks") > 0).select("q_id", "db_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("toks") - 1), lambda pos: F.struct(
            pos.alias("pos"), F.slice("toks", pos + 1, F.lit(max_n)).alias("w")))).alias("at"))
    at = at.select("q_id", "db_id", F.col("at.pos").alias("pos"), F.col("at.w").alias("w"))
    if columns is not None:
        first = lambda text: F.substring_index(text, " ", 1)
        starts = schema_names(columns).select("db_id", first(F.col("name")).alias("start")).distinct()
        at = at.withColumn("start", first(F.array_join("w", " "))).join(F.broadcast(starts), ["db_id", "start"], "left_semi")
    grams = at.select("q_id", "db_id", "pos", F.posexplode(F.transform(
        "w", lambda _, i: F.array_join(F.slice("w", F.lit(1), i + 1), " "))).alias("i", "gram"))
    return grams.select("q_id", "db_id", (F.col("i") + 1).alias("n"), "pos", "gram").where(F.trim("gram") != "")


def schema_names(columns: DataFrame) -> DataFrame:
    """(db_id, kind, obj_id, name, n_words): lower-case column words (column 0 skipped)
    and table words."""
    cols = columns.where(F.col("col_id") > 0).select("db_id", F.lit("col").alias("kind"),
                                                     F.col("col_id").alias("obj_id"), F.lower("col_name").alias("name"))
    tabs = columns.where(F.col("table_id") >= 0).select(
        "db_id", F.lit("tab").alias("kind"), F.col("table_id").alias("obj_id"), F.lower("table_name").alias("name")
    ).distinct()
    return cols.unionByName(tabs)


def _cover(df: DataFrame) -> DataFrame:
    """Expand a gram match to every token position it covers."""
    return df.select("q_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("tok_pos"),
                     "kind", "obj_id", "prio")


def link_exact(ngrams: DataFrame, columns: DataFrame) -> DataFrame:
    """(q_id, tok_pos, kind, obj_id, flag): gram equals a column / table name -> CEM / TEM."""
    names = schema_names(columns)
    m = ngrams.join(F.broadcast(names), (ngrams.db_id == names.db_id) & (ngrams.gram == names.name)).select(
        "q_id", "pos", "n", "kind", "obj_id", F.lit(0).alias("prio"))
    return _flagged(_cover(m).distinct())


def link_partial(ngrams: DataFrame, columns: DataFrame) -> DataFrame:
    """Partial (word-prefix) matches, not stop words or punctuation -> CPM / TPM;
    an exact match of the same (token, object) wins."""
    names = schema_names(columns)
    words = F.split("name", " ")
    prefixes = names.select("db_id", "kind", "obj_id", F.explode(F.sequence(F.lit(1), F.size(words))).alias("j"),
                            words.alias("w"), "name")
    prefixes = prefixes.select("db_id", "kind", "obj_id", F.array_join(F.slice("w", 1, F.col("j")), " ").alias("prefix"), "name") \
        .groupBy("db_id", "kind", "obj_id", "prefix").agg(F.max(F.col("prefix") == F.col("name")).alias("whole"))
    # a whole name is one of its prefixes, so one join finds both kinds
    met = ngrams.join(F.broadcast(prefixes), (ngrams.db_id == prefixes.db_id) & (ngrams.gram == prefixes.prefix)) \
        .where(F.col("whole") | ~F.array_contains(_skip(), F.col("gram")))
    both = _cover(met.select("q_id", "pos", "n", "kind", "obj_id", F.when(F.col("whole"), 0).otherwise(1).alias("prio")))
    best = both.groupBy("q_id", "tok_pos", "kind", "obj_id").agg(F.min("prio").alias("prio"))
    return _flagged(best)


def _flagged(df: DataFrame) -> DataFrame:
    flag = (F.when((F.col("kind") == "col") & (F.col("prio") == 0), FLAGS["col_exact"])
            .when(F.col("kind") == "col", FLAGS["col_partial"])
            .when(F.col("prio") == 0, FLAGS["tab_exact"]).otherwise(FLAGS["tab_partial"]))
    return df.select("q_id", F.col("tok_pos").cast("int"), "kind", F.col("obj_id").cast("int"), flag.alias("flag"))


def schema_links(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """Exact and partial column / table links, exact winning."""
    return link_partial(question_ngrams(questions, columns=columns), columns)


def _tokens(questions: DataFrame) -> DataFrame:
    t = questions.select("q_id", "db_id", F.posexplode("toks").alias("tok_pos", "tok"))
    return t.where((F.trim("tok") != "") & ~F.array_contains(_skip(), F.col("tok")))


def link_numbers(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """Numeric token x column of type number / time -> NUMBER / TIME."""
    t = _tokens(questions).where(F.col("tok").try_cast("double").isNotNull())
    c = columns.where((F.col("col_id") > 0) & F.col("col_type").isin("number", "time")).select("db_id", "col_id", "col_type")
    return t.join(F.broadcast(c), "db_id").select("q_id", F.col("tok_pos").cast("int"), F.lit("num").alias("kind"),
                                     F.col("col_id").cast("int").alias("obj_id"), F.upper("col_type").alias("flag"))


def cell_index(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cells(table_name_orig, col_name_orig, cell) -> (words, exact): distinct lower-case
    space-delimited words per column, and distinct cells with at most one leading /
    trailing space removed, lower-cased."""
    c = cells.where(F.col("cell").isNotNull()).select("table_name_orig", "col_name_orig", "cell").distinct()
    words = c.select("table_name_orig", "col_name_orig", F.explode(F.split(F.lower("cell"), " ")).alias("word")) \
        .where(F.col("word") != "").distinct()
    exact = c.select("table_name_orig", "col_name_orig",
                     F.lower(F.regexp_replace(F.regexp_replace("cell", "^ ", ""), " $", "")).alias("cell_l")).distinct()
    return words, exact


def link_cells_partial(questions: DataFrame, columns: DataFrame, words: DataFrame) -> DataFrame:
    """(q_id, db_id, tok_pos, col_id): a non-number, non-stop token equals a
    space-delimited word of some cell of the column (ASCII case-insensitive)."""
    t = _tokens(questions).where(F.col("tok").try_cast("double").isNull())
    cols = columns.where(F.col("col_id") > 0).select("db_id", "col_id", "table_name_orig", "col_name_orig")
    hits = words.join(F.broadcast(cols), ["table_name_orig", "col_name_orig"]).select("db_id", "col_id", "word")
    return t.join(_large(hits), (t.db_id == hits.db_id) & (F.lower(t.tok) == hits.word)).select(
        "q_id", t.db_id, "tok_pos", "col_id").distinct()


def link_cells_exact(questions: DataFrame, partial: DataFrame, columns: DataFrame, exact: DataFrame) -> DataFrame:
    """Runs of adjacent partially matched tokens per (question, column): a run equal
    to a whole cell -> EXACTMATCH on its tokens, else PARTIALMATCH."""
    w = Window.partitionBy("q_id", "col_id").orderBy("tok_pos")
    runs = partial.withColumn("grp", F.col("tok_pos") - F.row_number().over(w))
    spans = runs.groupBy("q_id", "db_id", "col_id", "grp").agg(F.min("tok_pos").alias("start"),
                                                               F.max("tok_pos").alias("stop"))
    spans = spans.join(_large(questions.select("q_id", "toks")), "q_id").withColumn(
        "run", F.lower(F.array_join(F.slice("toks", F.col("start") + 1, F.col("stop") - F.col("start") + 1), " ")))
    cols = columns.where(F.col("col_id") > 0).select("db_id", "col_id", "table_name_orig", "col_name_orig")
    ex = exact.join(F.broadcast(cols), ["table_name_orig", "col_name_orig"]).select("db_id", "col_id", F.col("cell_l").alias("run"),
                                                                       F.lit(True).alias("is_exact")).distinct()
    flagged = spans.join(_large(ex), ["db_id", "col_id", "run"], "left")
    return flagged.select("q_id", F.explode(F.sequence("start", "stop")).alias("tok_pos"), F.lit("cell").alias("kind"),
                          F.col("col_id").cast("int").alias("obj_id"),
                          F.when(F.col("is_exact"), FLAGS["cell_exact"]).otherwise(FLAGS["cell_partial"]).alias("flag")
                          ).withColumn("tok_pos", F.col("tok_pos").cast("int"))


def all_links(questions: DataFrame, columns: DataFrame, cells: DataFrame) -> DataFrame:
    """Schema links, number links and cell links of every question."""
    words, exact = cell_index(cells)
    partial = link_cells_partial(questions, columns, words)
    return (schema_links(questions, columns)
            .unionByName(link_numbers(questions, columns))
            .unionByName(link_cells_exact(questions, partial, columns, exact)))


def mask_question(questions: DataFrame, links: DataFrame, mask_tag: str = "<mask>", value_tag: str = "<unk>",
                  out: str = "masked") -> DataFrame:
    """Value tokens (number / cell links) -> value_tag, then schema tokens (column /
    table links) -> mask_tag; the schema tag wins. Shifting never removes a token's
    last schema link, so the masked text equals the one after shifting."""
    m = links.groupBy("q_id").agg(
        F.collect_set(F.when(F.col("kind").isin("col", "tab"), F.col("tok_pos"))).alias("s_pos"),
        F.collect_set(F.when(F.col("kind").isin("num", "cell"), F.col("tok_pos"))).alias("v_pos"))
    j = questions.join(_large(m), "q_id", "left")
    s_pos = F.coalesce("s_pos", F.array().cast("array<int>"))
    v_pos = F.coalesce("v_pos", F.array().cast("array<int>"))
    masked = F.transform("toks", lambda t, i: F.when(F.array_contains(s_pos, i), F.lit(mask_tag))
                         .when(F.array_contains(v_pos, i), F.lit(value_tag)).otherwise(t))
    return j.withColumn(out, F.array_join(masked, " ")).drop("s_pos", "v_pos")


def question_pattern(questions: DataFrame, links: DataFrame) -> DataFrame:
    """Both value and schema tokens -> `_` (no shifting)."""
    return mask_question(questions, links, "_", "_", out="pattern")


def shift_links(links: DataFrame) -> DataFrame:
    """Greedy link shifting per question: tokens in order of (number of schema links, position); a token keeps the
    links that earlier tokens have kept already, else its exact links, else all it has. Cell links survive on tokens
    without schema links. One aggregate per question (a question's links are bounded by its tokens times its schema)
    and a fold over its tokens."""
    exact = [FLAGS["col_exact"], FLAGS["tab_exact"]]
    one = F.struct("kind", "obj_id", "flag")
    at = (links.where(F.col("kind").isin("col", "tab", "cell")).groupBy("q_id", "tok_pos")
          .agg(F.collect_set(F.when(F.col("kind") != "cell", one)).alias("own"), F.collect_list(F.when(F.col("kind") == "cell", one)).alias("cells")))
    tokens = at.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct(F.size("own").alias("n"), "tok_pos", "own", "cells"))).alias("tokens"))
    link = "struct<kind:string,obj_id:int,flag:string>"
    start = F.struct(F.array().cast(f"array<{link}>").alias("known"), F.array().cast(f"array<struct<tok_pos:int,kept:array<{link}>>>").alias("out"))

    def step(acc, token):
        seen = F.array_intersect(token["own"], acc["known"])
        sure = F.filter(token["own"], lambda x: x["flag"].isin(exact))
        kept = F.when(F.size(seen) > 0, seen).when(F.size(sure) > 0, sure).otherwise(token["own"])
        left = F.when(F.size(token["own"]) > 0, kept).otherwise(token["cells"])
        return F.struct(F.array_union(acc["known"], kept).alias("known"),
                        F.concat(acc["out"], F.array(F.struct(token["tok_pos"].alias("tok_pos"), left.alias("kept")))).alias("out"))

    folded = tokens.select("q_id", F.explode(F.aggregate("tokens", start, step, lambda acc: acc["out"])).alias("t"))
    return folded.select("q_id", F.col("t.tok_pos").alias("tok_pos"), F.explode("t.kept").alias("l")).select("q_id", "tok_pos", "l.kind", "l.obj_id", "l.flag")


def linked_tables(questions: DataFrame, links: DataFrame, columns: DataFrame) -> DataFrame:
    """(q_id, table_id): tables of column links, table links and exact cell links;
    a question with none gets every table of its database."""
    col_tab = columns.where(F.col("col_id") > 0).select("db_id", F.col("col_id").alias("obj_id"), F.col("table_id").alias("of_col"))
    is_tab = F.col("kind") == "tab"
    wanted = (links.where(F.col("kind").isin("col", "tab") | ((F.col("kind") == "cell") & (F.col("flag") == FLAGS["cell_exact"])))
              .select("q_id", is_tab.alias("is_tab"), "obj_id").distinct())
    ql = wanted.join(_large(questions.select("q_id", "db_id")), "q_id").join(F.broadcast(col_tab), ["db_id", "obj_id"], "left")
    checkpoint_dir(questions.sparkSession)
    # links are found once: the tables of a question are read here and by the questions without any
    got = (ql.where(F.col("is_tab") | F.col("of_col").isNotNull())
           .select("q_id", F.when(F.col("is_tab"), F.col("obj_id")).otherwise(F.col("of_col")).alias("table_id")).distinct().checkpoint())
    none = questions.select("q_id", "db_id").join(_large(got.select("q_id").distinct()), "q_id", "left_anti")
    all_tabs = columns.where(F.col("table_id") >= 0).select("db_id", "table_id").distinct()
    return got.unionByName(none.join(F.broadcast(all_tabs), "db_id").select("q_id", "table_id"))


def linked_table_recall(questions: DataFrame, linked: DataFrame, columns: DataFrame) -> DataFrame:
    """Share of questions where some table used by the SQL (a query token split on
    `.` naming the table) is not among the linked tables. Returns (n_bad, n_total, share)."""
    tabs = columns.where(F.col("table_id") >= 0).select("db_id", "table_id",
                                                        F.lower("table_name_orig").alias("t")).distinct()
    toks = questions.select("q_id", "db_id", F.explode(F.split(F.lower("query"), r"\s+")).alias("tok"))
    parts = toks.select("q_id", "db_id", F.explode(F.split("tok", r"\.")).alias("p"))
    used = parts.join(F.broadcast(tabs), (parts.db_id == tabs.db_id) & (parts.p == tabs.t)).select("q_id", "table_id").distinct()
    bad = used.join(_large(linked), ["q_id", "table_id"], "left_anti").select("q_id").distinct() \
        .withColumn("bad", F.lit(1))
    per_q = questions.select("q_id").distinct().join(_large(bad), "q_id", "left")
    return per_q.agg(F.count("bad").alias("n_bad"), F.count(F.lit(1)).alias("n_total")).select(
        "n_bad", "n_total", F.round(F.col("n_bad") / F.col("n_total"), 6).alias("share"))
