"""DuckDB SQL fragments shared by the oracles (CTE bodies over the driver views).

These are written from SURVEY's operator specification in plain DuckDB SQL;
only fixed values (word lists, key lists, the exemplar templates) are shared
with the Spark side.
"""

from __future__ import annotations

from shotweave.functions.sqltext import SQL_TOKEN_RE
from shotweave.sources.catalog import FOREIGN_KEYS, PRIMARY_KEYS, RELATIONAL_TABLES
from shotweave.sources.tables import EXEMPLARS_SQL


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


EXEMPLARS = f"exemplars AS ({EXEMPLARS_SQL})"

# Model responses derived from every exemplar (fenced, commented, spaced operators,
# a current-year call) so the cleaners have work on the whole table.
RESPONSES_SELECT = """CASE CAST(ex_id % 4 AS INT)
 WHEN 0 THEN query
 WHEN 1 THEN concat('```sql' || chr(10), query, chr(10) || '```')
 WHEN 2 THEN concat('  ', replace(replace(query, '>=', '> ='), '!=', '! ='), ' /* again */ ', query)
 ELSE concat('Here it is:' || chr(10) || '```' || chr(10), query, ' AND year ( CURDATE( ) ) > 1999', chr(10) || '```') END"""
RESPONSES = f"responses AS (SELECT ex_id, db_id, {RESPONSES_SELECT} AS response FROM exemplars)"

_REL_VALUES = ", ".join(f"({q(t)}, {i})" for i, t in enumerate(RELATIONAL_TABLES))
_PK_VALUES = ", ".join(f"({q(t)}, {q(c)})" for t, cs in PRIMARY_KEYS.items() for c in cs)
_FK_VALUES = ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {q(d)})" for a, b, c, d in FOREIGN_KEYS)

# `columns` catalog: one copy of the relational schema per exemplar database.
CATALOG = f"""
dbs AS (SELECT DISTINCT concat('db_', CAST(o_custkey % 20 AS VARCHAR)) AS db_id FROM orders),
rel AS (SELECT * FROM (VALUES {_REL_VALUES}) v(tname, table_id)),
phys AS (SELECT r.table_id, r.tname, c.column_name, c.ordinal_position, c.data_type
         FROM information_schema.columns c JOIN rel r ON c.table_name = r.tname),
numbered AS (SELECT table_id, tname, column_name,
               CAST(row_number() OVER (ORDER BY table_id, ordinal_position) AS INTEGER) AS col_id,
               CASE WHEN data_type = 'VARCHAR' THEN 'text'
                    WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'time'
                    WHEN data_type = 'BOOLEAN' THEN 'boolean'
                    WHEN data_type IN ('TINYINT','SMALLINT','INTEGER','BIGINT','HUGEINT','FLOAT','DOUBLE')
                         OR data_type LIKE 'DECIMAL%' THEN 'number'
                    ELSE 'others' END AS col_type
             FROM phys),
pkv AS (SELECT * FROM (VALUES {_PK_VALUES}) v(tname, cname)),
fkv AS (SELECT * FROM (VALUES {_FK_VALUES}) v(ft, fc, tt, tc)),
cat0 AS (
  SELECT CAST(-1 AS INTEGER) AS table_id, CAST(NULL AS VARCHAR) AS table_name_orig, CAST(0 AS INTEGER) AS col_id,
         '*' AS col_name_orig, 'text' AS col_type, FALSE AS is_pk, CAST(NULL AS INTEGER) AS fk_col_id
  UNION ALL
  SELECT n.table_id, n.tname, n.col_id, n.column_name, n.col_type,
         EXISTS (SELECT 1 FROM pkv p WHERE p.tname = n.tname AND p.cname = n.column_name),
         (SELECT m.col_id FROM fkv f JOIN numbered m ON m.tname = f.tt AND m.column_name = f.tc
           WHERE f.ft = n.tname AND f.fc = n.column_name)
  FROM numbered n),
columns AS (
  SELECT d.db_id, c.table_id, replace(c.table_name_orig, '_', ' ') AS table_name, c.table_name_orig, c.col_id,
         replace(c.col_name_orig, '_', ' ') AS col_name, c.col_name_orig, c.col_type, c.is_pk, c.fk_col_id
  FROM dbs d CROSS JOIN cat0 c)"""

TOKEN_RE = q(SQL_TOKEN_RE)
_TERM = "[a-z0-9_]+([.][a-z0-9_]+)?( [(] [^ ]+ [)])?"
ORDER_RE = q(f"order by {_TERM}( [-+<>]=? {_TERM})*")


def normalize_ctes(src: str, id_cols: str, text_col: str, out: str) -> str:
    """CTE chain `{out}_n1..` ending in `{out}(id_cols, norm)` normalising `text_col` of `src`."""
    return f"""
{out}_a AS (SELECT {id_cols}, {text_col} AS raw_text,
    replace(regexp_replace(regexp_replace({text_col}, '^\\s+|\\s+$', '', 'g'), ';$', ''), '"', '''') AS s0 FROM {src}),
{out}_b AS (SELECT *, array_to_string(list_transform(regexp_extract_all(s0, {TOKEN_RE}),
    lambda t: CASE WHEN starts_with(t, '''') THEN t ELSE lower(t) END), ' ') AS s1 FROM {out}_a),
{out}_c AS (SELECT *, CASE WHEN contains(s1, 'order by') AND NOT contains(s1, 'asc') AND NOT contains(s1, 'desc')
    THEN regexp_replace(s1, {ORDER_RE}, '\\0 asc', 'g') ELSE s1 END AS s2 FROM {out}_b),
{out}_d AS (SELECT *, regexp_extract_all(s2, {TOKEN_RE}) AS toks,
    list_transform(regexp_extract_all(s2, '(?:from|join) [a-z_][a-z0-9_]* as [a-z_][a-z0-9_]*'),
       lambda p: {{'alias': split_part(p, ' ', 4), 'tbl': split_part(p, ' ', 2)}}) AS pairs FROM {out}_c),
{out}_e AS (SELECT *, list_filter(pairs, lambda e: regexp_matches(e.alias, '^t([1-9]|10)$')
    OR list_contains(list_transform(list_filter(toks, lambda x: contains(x, '.')), lambda x: split_part(x, '.', 1)), e.alias))
    AS kept FROM {out}_d),
{out}_f AS (SELECT *, list_filter(list_transform(toks, lambda t, i:
    CASE WHEN len(list_filter(kept, lambda e: e.alias = t)) > 0 THEN
           CASE WHEN i > 1 AND toks[i - 1] = 'as' THEN t
                WHEN i > 1 AND toks[i - 1] = list_filter(kept, lambda e: e.alias = t)[1].tbl THEN NULL
                ELSE list_filter(kept, lambda e: e.alias = t)[1].tbl END
         WHEN contains(t, '.') THEN array_to_string(list_transform(string_split(t, '.'),
              lambda x: coalesce(list_filter(kept, lambda e: e.alias = x)[1].tbl, x)), '.')
         ELSE t END), lambda t: t IS NOT NULL) AS toks2 FROM {out}_e),
{out} AS (SELECT {id_cols}, raw_text, array_to_string(list_filter(toks2, lambda t, i: t <> 'as'
    AND (i = 1 OR toks2[i - 1] <> 'as')), ' ') AS norm FROM {out}_f)"""


# per database: lower-case table names, column names, and original table names
DB_NAMES = """
dbnames AS (SELECT db_id,
    list(DISTINCT lower(table_name_orig)) FILTER (WHERE table_id >= 0) AS tl,
    list(DISTINCT lower(col_name_orig)) FILTER (WHERE table_id >= 0) AS cl,
    list(DISTINCT table_name_orig) FILTER (WHERE table_id >= 0) AS torig
  FROM columns GROUP BY db_id)"""


def skeleton_ctes(norm: str, id_cols: str, out: str) -> str:
    """From `{norm}(id_cols, db_id, raw_text, norm)` to `{out}(id_cols, skel)`."""
    return f"""
{out}_m AS (SELECT n.*, array_to_string(list_transform(regexp_extract_all(n.norm, {TOKEN_RE}), lambda t:
    CASE WHEN list_contains(d.tl, t) OR list_contains(d.cl, t) OR t = '*'
           OR (contains(t, '.') AND list_contains(d.tl, split_part(t, '.', 1)) AND list_contains(d.cl, split_part(t, '.', 2)))
           OR list_contains(list_transform(d.torig, lambda x: x || '.*'), t) THEN '_'
         WHEN starts_with(t, '''') AND ends_with(t, '''') THEN '_'
         WHEN regexp_matches(t, '^-?[0-9]+(\\.[0-9]+)?$') THEN '_'
         ELSE trim(t) END), ' ') AS k0
  FROM {norm} n JOIN dbnames d ON n.db_id = d.db_id),
{out}_j AS (SELECT *, regexp_replace(regexp_replace(k0, ' on _ = _( and _ = _)?( or _ = _)?', '', 'g'), '_( join _)+( |$)', '_ ', 'g') AS kj FROM {out}_m),
{out}_r AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(kj, '_( , _)+', '_', 'g'), '_ (=|!=|[<>]=?) _', '_', 'g'),
    'where _( (and|or) _)+', 'where _', 'g'), ' +', ' ', 'g') AS k1 FROM {out}_j),
{out}_p AS (SELECT *, string_split(k1, ' ') AS parts FROM {out}_r),
{out} AS (SELECT {id_cols}, CASE WHEN starts_with(raw_text, 'SELECT') THEN
    array_to_string(list_transform(parts, lambda t, i: CASE WHEN i >= 3 AND parts[i - 2] = 'order'
      AND parts[i - 1] = 'by' THEN '_' ELSE t END), ' ') ELSE raw_text END AS skel FROM {out}_p)"""


def bm25_ctes(targets: str, corpus: str, out: str = "bm") -> str:
    """`{targets}(target_id, text)`, `{corpus}(cand_id, text)` -> `{out}(target_id, cand_id, score)`."""
    return f"""
{out}_docs AS (SELECT cand_id, string_split(lower(text), ' ') AS toks FROM {corpus}),
{out}_dl AS (SELECT cand_id, len(toks) AS dl FROM {out}_docs),
{out}_st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM {out}_dl),
{out}_post AS (SELECT cand_id, term, count(*) AS tf FROM (SELECT cand_id, unnest(toks) AS term FROM {out}_docs)
               GROUP BY cand_id, term),
{out}_df AS (SELECT term, count(*) AS n FROM {out}_post GROUP BY term),
{out}_idf0 AS (SELECT term, ln(s.n_docs - n + 0.5) - ln(n + 0.5) AS idf FROM {out}_df, {out}_st s),
{out}_idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM {out}_idf0) ELSE idf END AS idf
              FROM {out}_idf0),
{out}_q AS (SELECT target_id, term, count(*) AS qtf FROM
              (SELECT target_id, unnest(string_split(lower(text), ' ')) AS term FROM {targets}) GROUP BY target_id, term),
{out} AS (SELECT q.target_id, p.cand_id,
            sum(q.qtf * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (1 - 0.75 + 0.75 * d.dl / s.avgdl))) AS score
          FROM {out}_q q JOIN {out}_idf i ON q.term = i.term JOIN {out}_post p ON p.term = q.term
               JOIN {out}_dl d ON d.cand_id = p.cand_id, {out}_st s
          GROUP BY q.target_id, p.cand_id)"""


EXEMPLAR_VECTORS = """
ev AS (SELECT e.ex_id, e.db_id, e.question, e.query, CAST(m.embedding AS DOUBLE[]) AS v
       FROM exemplars e JOIN embeddings m ON e.ex_id = m.vec_id)"""


def sparse_cosine_sql(rows: str, other_text: bool, k: int = 5, every: bool = False) -> str:
    """Top k by cosine of term counts: `{rows}(ex_id, db_id, question, txt)` with an id divisible by 20, or every one, against all of them."""
    rule = "AND c.question <> t.question" if other_text else ""
    query, its = ("", "") if every else (" WHERE ex_id % 20 = 0", "e.ex_id % 20 = 0 AND ")
    return f"""
tf AS (SELECT txt, tok, count(*) AS c FROM (SELECT txt, unnest(string_split(txt, ' ')) AS tok FROM (SELECT DISTINCT txt FROM {rows})) GROUP BY ALL),
nm AS (SELECT txt, sum(c * c) AS n2 FROM tf GROUP BY txt),
tgt AS (SELECT DISTINCT txt, db_id, question FROM {rows}{query}),
dots AS (SELECT a.txt AS ta, b.txt AS tb, sum(a.c * b.c) AS d FROM tf a JOIN tf b USING (tok) WHERE a.txt IN (SELECT txt FROM tgt) GROUP BY ALL),
mp AS (SELECT t.txt, t.db_id, t.question, c.ex_id AS cand_id, coalesce(d, 0) / (sqrt(x.n2) * sqrt(y.n2)) AS s FROM tgt t JOIN {rows} c ON c.db_id <> t.db_id {rule}
       JOIN nm x ON x.txt = t.txt JOIN nm y ON y.txt = c.txt LEFT JOIN dots ON ta = t.txt AND tb = c.txt),
rr AS (SELECT *, row_number() OVER (PARTITION BY txt, db_id, question ORDER BY round(s, 12) DESC, cand_id) AS rk FROM mp)
SELECT e.ex_id AS target_id, cand_id, round(s, 6) AS score, CAST(rk AS INTEGER) AS rk
FROM {rows} e JOIN rr USING (txt, db_id, question) WHERE {its}rk <= {k}"""


def exemplar_white_ctes() -> str:
    """`ev` as in EXEMPLAR_VECTORS with the whitened vector `wv` besides."""
    return white_ctes() + """,
ev AS (SELECT e.ex_id, e.db_id, e.question, e.query, CAST(m.embedding AS DOUBLE[]) AS v, w.v AS wv
       FROM exemplars e JOIN embeddings m ON e.ex_id = m.vec_id JOIN white w ON w.vec_id = m.vec_id)"""


def pred_skeleton_ctes() -> str:
    """`psk(ex_id, skel)`: skeleton of every exemplar's cleaned response."""
    return f"""{RESPONSES}, {CATALOG}, {DB_NAMES},
evr AS (SELECT e.*, r.response, regexp_replace(r.response, '^\\s+|\\s+$', '', 'g') AS rr FROM exemplars e JOIN responses r ON e.ex_id = r.ex_id),
evp AS (SELECT *, CASE WHEN contains(rr, '```sql') THEN regexp_replace(split_part(split_part(rr, '```sql', 2), '```', 1), '^\\s+|\\s+$', '', 'g')
     WHEN contains(rr, '```') THEN regexp_replace(split_part(split_part(rr, '```', 2), '```', 1), '^\\s+|\\s+$', '', 'g')
     ELSE rr END AS pred FROM evr),
{normalize_ctes('evp', 'ex_id, db_id', 'pred', 'pn')},
{skeleton_ctes('pn', 'ex_id', 'psk')}"""


def white_ctes(rounds: int = 14) -> str:
    """`wmat(i, j, w)`, the inverse square root of the covariance of `embeddings`, and `white(vec_id, v)`, its vectors
    centred and multiplied by it. The root comes from coupled Newton-Schulz steps on matrices of (i, j, x) rows."""
    mul = lambda a, b: f"(SELECT a.i, b.j, sum(a.x * b.x) AS x FROM {a} a JOIN {b} b ON a.j = b.i GROUP BY a.i, b.j)"
    steps = ""
    for k in range(rounds):
        steps += f""",
wt{k} AS MATERIALIZED (SELECT i, j, (CASE WHEN i = j THEN 1.5 ELSE 0 END) - 0.5 * x AS x FROM {mul(f'wz{k}', f'wy{k}')}),
wy{k + 1} AS MATERIALIZED {mul(f'wy{k}', f'wt{k}')},
wz{k + 1} AS MATERIALIZED {mul(f'wt{k}', f'wz{k}')}"""
    return f"""
wx AS MATERIALIZED (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
wmu AS MATERIALIZED (SELECT i, avg(x) AS mu FROM wx GROUP BY i),
wcov AS MATERIALIZED (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) + CASE WHEN a.i = b.i THEN 1e-5 ELSE 0 END AS x FROM wx a JOIN wx b USING (vec_id) GROUP BY a.i, b.i),
wsize AS MATERIALIZED (SELECT sqrt(sum(x * x)) AS f FROM wcov),
wy0 AS MATERIALIZED (SELECT i, j, x / f AS x FROM wcov, wsize),
wz0 AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS x FROM wcov){steps},
wmat AS MATERIALIZED (SELECT i, j, x / sqrt(f) AS w FROM wz{rounds}, wsize),
wout AS MATERIALIZED (SELECT vec_id, j, sum((x - mu) * w) AS y FROM wx JOIN wmu USING (i) JOIN wmat USING (i) GROUP BY vec_id, j),
white AS MATERIALIZED (SELECT vec_id, list(y ORDER BY j) AS v FROM wout GROUP BY vec_id)"""
