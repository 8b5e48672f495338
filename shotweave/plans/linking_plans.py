"""Registered schema-linking queries.

Questions: every exemplar (with its SQL) plus one generated question per part,
`Which parts are called <p_name>?` (FIXTURES), so cell values occur in text.
Cells: the FIXTURES text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotweave.operators import linking as lk
from shotweave.plans.oracle_sql import CATALOG, EXEMPLARS, q
from shotweave.plans.registry import register
from shotweave.session import checkpoint_dir
from shotweave.sources.catalog import driver_columns
from shotweave.sources.tables import exemplar_keys, exemplars, read_table

# The text columns whose cells are linked (FIXTURES).
CELL_COLUMNS = [("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"),
                ("part", "p_type"), ("part", "p_name")]
PART_Q_OFFSET = 1_000_000_000


def link_questions(spark, sf):
    """Questions of all exemplars and parts, dealt out to all tasks: few scan tasks hold many, and grams are made of each."""
    ex = exemplars(spark, sf, exemplar_keys(spark, sf)).select(F.col("ex_id").alias("q_id"), "db_id", "question", "query")
    part = read_table(spark, sf, "part").select("p_partkey", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select(
        (F.lit(PART_Q_OFFSET) + F.col("p_partkey")).alias("q_id"),
        F.concat(F.lit("db_"), (F.col("p_partkey") % 20).cast("string")).alias("db_id"),
        F.concat(F.lit("Which parts are called "), F.col("p_name"), F.lit("?")).alias("question"),
        F.concat(F.lit("SELECT p_partkey FROM part WHERE p_name = '"), F.col("p_name"), F.lit("'")).alias("query"))
    return ex.unionByName(part).withColumn("toks", lk.tokenize_question(F.col("question")))


def cells(spark, sf):
    out = None
    for t, c in CELL_COLUMNS:
        one = read_table(spark, sf, t).select(F.lit(t).alias("table_name_orig"), F.lit(c).alias("col_name_orig"),
                                              F.col(c).alias("cell"))
        out = one if out is None else out.unionByName(one)
    return out


_SKIP_SQL = "[" + ", ".join(q(w) for w in lk.STOPWORDS + lk.PUNCTUATION) + "]"
_CELLS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name_orig, '{c}' AS col_name_orig, {c} AS cell FROM {t}"
                                for t, c in CELL_COLUMNS)

LINK_BODY = f"""
lq AS (SELECT ex_id AS q_id, db_id, question, query FROM exemplars
       UNION ALL SELECT {PART_Q_OFFSET} + p_partkey, 'db_' || CAST(p_partkey % 20 AS VARCHAR),
         'Which parts are called ' || p_name || '?', 'SELECT p_partkey FROM part WHERE p_name = ''' || p_name || '''' FROM part),
qt AS (SELECT q_id, db_id, query, regexp_extract_all(lower(question), '\\w+|[^\\w\\s]') AS toks FROM lq),
ng0 AS (SELECT q_id, db_id, toks, n FROM qt, (SELECT unnest(range(1, 6)) AS n) WHERE len(toks) >= n),
ng AS (SELECT q_id, db_id, CAST(n AS INTEGER) AS n, CAST(pos AS INTEGER) AS pos,
         array_to_string(toks[pos + 1 : pos + n], ' ') AS gram
       FROM (SELECT *, unnest(range(0, len(toks) - n + 1)) AS pos FROM ng0) WHERE trim(array_to_string(toks[pos + 1 : pos + n], ' ')) <> ''),
names AS (SELECT db_id, 'col' AS kind, col_id AS obj_id, lower(col_name) AS name FROM columns WHERE col_id > 0
          UNION SELECT DISTINCT db_id, 'tab', table_id, lower(table_name) FROM columns WHERE table_id >= 0),
pref AS (SELECT DISTINCT db_id, kind, obj_id, array_to_string(w[1 : j], ' ') AS prefix
         FROM (SELECT *, string_split(name, ' ') AS w FROM names), (SELECT unnest(range(1, 50)) AS j) WHERE j <= len(w)),
ex AS (SELECT g.q_id, g.pos, g.n, m.kind, m.obj_id, 0 AS prio FROM ng g JOIN names m ON g.db_id = m.db_id AND g.gram = m.name),
pa AS (SELECT g.q_id, g.pos, g.n, m.kind, m.obj_id, 1 AS prio FROM ng g JOIN pref m ON g.db_id = m.db_id AND g.gram = m.prefix
       WHERE NOT list_contains({_SKIP_SQL}, g.gram)),
cov AS (SELECT q_id, CAST(unnest(range(pos, pos + n)) AS INTEGER) AS tok_pos, kind, obj_id, prio FROM (SELECT * FROM ex UNION ALL SELECT * FROM pa)),
sl AS (SELECT q_id, tok_pos, kind, CAST(obj_id AS INTEGER) AS obj_id,
         CASE WHEN kind = 'col' AND min(prio) = 0 THEN 'CEM' WHEN kind = 'col' THEN 'CPM'
              WHEN min(prio) = 0 THEN 'TEM' ELSE 'TPM' END AS flag FROM cov GROUP BY q_id, tok_pos, kind, obj_id),
tk AS (SELECT q_id, db_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS tok_pos, unnest(toks) AS tok FROM qt),
tk2 AS (SELECT * FROM tk WHERE trim(tok) <> '' AND NOT list_contains({_SKIP_SQL}, tok)),
nl AS (SELECT t.q_id, t.tok_pos, 'num' AS kind, CAST(c.col_id AS INTEGER) AS obj_id, upper(c.col_type) AS flag
       FROM tk2 t JOIN columns c ON c.db_id = t.db_id AND c.col_id > 0 AND c.col_type IN ('number', 'time')
       WHERE TRY_CAST(t.tok AS DOUBLE) IS NOT NULL),
cl0 AS (SELECT DISTINCT * FROM ({_CELLS_SQL}) WHERE cell IS NOT NULL),
cw AS (SELECT DISTINCT table_name_orig, col_name_orig, word FROM
         (SELECT table_name_orig, col_name_orig, unnest(string_split(lower(cell), ' ')) AS word FROM cl0) WHERE word <> ''),
ce AS (SELECT DISTINCT table_name_orig, col_name_orig,
         lower(regexp_replace(regexp_replace(cell, '^ ', ''), ' $', '')) AS cell_l FROM cl0),
cc AS (SELECT db_id, col_id, table_name_orig, col_name_orig FROM columns WHERE col_id > 0),
cp AS (SELECT DISTINCT t.q_id, t.db_id, t.tok_pos, cc.col_id FROM tk2 t
       JOIN cc ON cc.db_id = t.db_id JOIN cw ON cw.table_name_orig = cc.table_name_orig AND cw.col_name_orig = cc.col_name_orig
        AND cw.word = lower(t.tok) WHERE TRY_CAST(t.tok AS DOUBLE) IS NULL),
runs AS (SELECT *, tok_pos - row_number() OVER (PARTITION BY q_id, col_id ORDER BY tok_pos) AS grp FROM cp),
spans AS (SELECT r.q_id, r.db_id, r.col_id, min(r.tok_pos) AS st, max(r.tok_pos) AS en FROM runs r GROUP BY r.q_id, r.db_id, r.col_id, r.grp),
sp2 AS (SELECT s.*, lower(array_to_string(qt.toks[s.st + 1 : s.en + 1], ' ')) AS run FROM spans s JOIN qt ON qt.q_id = s.q_id),
sp3 AS (SELECT s.*, EXISTS (SELECT 1 FROM cc JOIN ce ON ce.table_name_orig = cc.table_name_orig AND ce.col_name_orig = cc.col_name_orig
                      WHERE cc.db_id = s.db_id AND cc.col_id = s.col_id AND ce.cell_l = s.run) AS is_exact FROM sp2 s),
cel AS (SELECT q_id, CAST(unnest(range(st, en + 1)) AS INTEGER) AS tok_pos, 'cell' AS kind, CAST(col_id AS INTEGER) AS obj_id,
          CASE WHEN is_exact THEN 'EXACTMATCH' ELSE 'PARTIALMATCH' END AS flag FROM sp3),
links AS (SELECT * FROM sl UNION ALL SELECT * FROM nl UNION ALL SELECT * FROM cel)"""
_BASE = LINKS_SQL = f"WITH {EXEMPLARS}, {CATALOG}," + LINK_BODY


def _questions(spark, sf):
    return link_questions(spark, sf)


def catalog(spark, sf):
    """The catalog's columns, derived from the tables once: linking reads them in many joins, each of which would
    else scan the exemplars for their databases and carry the whole schema in its plan."""
    checkpoint_dir(spark)
    return driver_columns(spark, sf).checkpoint()


@register("question_ngrams", oracle=_BASE + "\nSELECT q_id, n, pos, gram FROM ng")
def q_question_ngrams(spark, sf):
    return lk.question_ngrams(_questions(spark, sf)).select("q_id", "n", "pos", "gram")


@register("link_exact", oracle=_BASE + """
SELECT DISTINCT q_id, tok_pos, kind, CAST(obj_id AS INTEGER) AS obj_id, CASE WHEN kind = 'col' THEN 'CEM' ELSE 'TEM' END AS flag
FROM cov WHERE prio = 0""")
def q_link_exact(spark, sf):
    cols = catalog(spark, sf)
    return lk.link_exact(lk.question_ngrams(_questions(spark, sf), columns=cols), cols)


@register("link_partial", oracle=_BASE + "\nSELECT * FROM sl")
def q_link_partial(spark, sf):
    return lk.schema_links(_questions(spark, sf), catalog(spark, sf))


@register("link_numbers", oracle=_BASE + "\nSELECT * FROM nl")
def q_link_numbers(spark, sf):
    return lk.link_numbers(_questions(spark, sf), catalog(spark, sf))


@register("link_cells_partial", oracle=_BASE + "\nSELECT q_id, tok_pos, CAST(col_id AS INTEGER) AS col_id FROM cp")
def q_link_cells_partial(spark, sf):
    words, _ = lk.cell_index(cells(spark, sf))
    p = lk.link_cells_partial(_questions(spark, sf), catalog(spark, sf), words)
    return p.select("q_id", F.col("tok_pos").cast("int"), F.col("col_id").cast("int"))


@register("link_cells_exact", oracle=_BASE + "\nSELECT * FROM cel")
def q_link_cells_exact(spark, sf):
    qs = _questions(spark, sf)
    cols = catalog(spark, sf)
    words, exact = lk.cell_index(cells(spark, sf))
    return lk.link_cells_exact(qs, lk.link_cells_partial(qs, cols, words), cols, exact)


def question_links(spark, sf, columns=None):
    return lk.all_links(_questions(spark, sf), catalog(spark, sf) if columns is None else columns, cells(spark, sf))


_MASK = """,
pos AS (SELECT q_id, tok_pos, max(CAST(kind IN ('col', 'tab') AS INT)) AS s, max(CAST(kind IN ('num', 'cell') AS INT)) AS v
        FROM links GROUP BY q_id, tok_pos),
mk AS (SELECT q_id, list(tok_pos) FILTER (WHERE s = 1) AS sp, list(tok_pos) FILTER (WHERE v = 1) AS vp FROM pos GROUP BY q_id)"""


def _mask_sql(mtag: str, vtag: str, out: str) -> str:
    return _BASE + _MASK + f"""
SELECT qt.q_id, array_to_string(list_transform(qt.toks, lambda t, i:
  CASE WHEN list_contains(coalesce(mk.sp, []), CAST(i - 1 AS INTEGER)) THEN '{mtag}'
       WHEN list_contains(coalesce(mk.vp, []), CAST(i - 1 AS INTEGER)) THEN '{vtag}' ELSE t END), ' ') AS {out}
FROM qt LEFT JOIN mk ON mk.q_id = qt.q_id"""


@register("mask_question", oracle=_mask_sql("<mask>", "<unk>", "masked"))
def q_mask_question(spark, sf):
    return lk.mask_question(_questions(spark, sf), question_links(spark, sf)).select("q_id", "masked")


@register("question_pattern", oracle=_mask_sql("_", "_", "pattern"))
def q_question_pattern(spark, sf):
    return lk.question_pattern(_questions(spark, sf), question_links(spark, sf)).select("q_id", "pattern")


@register("shift_links")
def q_shift_links(spark, sf):
    return lk.shift_links(question_links(spark, sf))


_LT = _BASE + """,
ct AS (SELECT db_id, col_id, table_id FROM columns WHERE col_id > 0),
ql AS (SELECT l.*, qt.db_id FROM links l JOIN qt ON qt.q_id = l.q_id),
got AS (SELECT DISTINCT ql.q_id, ct.table_id FROM ql JOIN ct ON ct.db_id = ql.db_id AND ct.col_id = ql.obj_id
          WHERE ql.kind = 'col' OR (ql.kind = 'cell' AND ql.flag = 'EXACTMATCH')
        UNION SELECT DISTINCT q_id, obj_id FROM ql WHERE kind = 'tab'),
tabs AS (SELECT DISTINCT db_id, table_id FROM columns WHERE table_id >= 0),
lt AS (SELECT * FROM got UNION ALL
       SELECT qt.q_id, t.table_id FROM qt JOIN tabs t ON t.db_id = qt.db_id WHERE qt.q_id NOT IN (SELECT q_id FROM got))"""


@register("linked_tables", oracle=_LT + "\nSELECT q_id, CAST(table_id AS INTEGER) AS table_id FROM lt")
def q_linked_tables(spark, sf):
    cols = catalog(spark, sf)
    t = lk.linked_tables(_questions(spark, sf), question_links(spark, sf, cols), cols)
    return t.select("q_id", F.col("table_id").cast("int"))


@register("linked_table_recall", oracle=_LT + """,
tn AS (SELECT DISTINCT db_id, table_id, lower(table_name_orig) AS t FROM columns WHERE table_id >= 0),
qp AS (SELECT q_id, db_id, unnest(string_split(tok, '.')) AS p FROM
        (SELECT q_id, db_id, unnest(regexp_split_to_array(lower(query), '\\s+')) AS tok FROM qt)),
used AS (SELECT DISTINCT qp.q_id, tn.table_id FROM qp JOIN tn ON tn.db_id = qp.db_id AND tn.t = qp.p),
bad AS (SELECT DISTINCT u.q_id FROM used u WHERE NOT EXISTS (SELECT 1 FROM lt WHERE lt.q_id = u.q_id AND lt.table_id = u.table_id))
SELECT (SELECT count(*) FROM bad) AS n_bad, (SELECT count(*) FROM qt) AS n_total,
       round((SELECT count(*) FROM bad) / (SELECT count(*) FROM qt), 6) AS share""")
def q_linked_table_recall(spark, sf):
    qs = _questions(spark, sf)
    cols = catalog(spark, sf)
    return lk.linked_table_recall(qs, lk.linked_tables(qs, question_links(spark, sf, cols), cols), cols)
