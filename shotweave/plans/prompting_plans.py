"""Registered prompt-assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotweave.operators import prompting as pr
from shotweave.operators.knn import block_knn
from shotweave.plans.oracle_sql import CATALOG, EXEMPLAR_VECTORS, EXEMPLARS
from shotweave.plans.registry import register
from shotweave.plans.retrieval_plans import _ev, _ev_skel
from shotweave.sources.catalog import driver_columns
from shotweave.sources.tables import exemplars


def _tables(spark, sf):
    cols = driver_columns(spark, sf).where("table_id >= 0")
    return cols.groupBy("db_id", "table_id", F.col("table_name_orig").alias("table_name")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_id", "col_name_orig"))),
                    lambda s: s["col_name_orig"]).alias("cols"))


def _parts(spark, sf):
    from shotweave.operators import catalog as cat

    cols = driver_columns(spark, sf)
    ddl = cat.catalog_ddl(cols).join(cat.catalog_tables(cols), ["db_id", "table_name"]).select("db_id", "table_id", "ddl")
    real = cols.where("table_id >= 0")
    dst = real.select("db_id", F.col("col_id").alias("fk_col_id"),
                      F.concat_ws(".", "table_name_orig", "col_name_orig").alias("b"))
    fks = real.where(F.col("fk_col_id").isNotNull()).join(dst, ["db_id", "fk_col_id"]).select(
        "db_id", F.col("col_id").alias("fk_no"), F.concat_ws(".", "table_name_orig", "col_name_orig").alias("a"), "b")
    return pr.schema_parts(_tables(spark, sf), ddl, fks)


def _lit(text: str) -> str:
    """SQL literal with newlines as chr(10)."""
    parts = text.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


def _sql_lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PARTS_SQL = f"""{CATALOG},
tabs AS (SELECT db_id, table_id, table_name_orig AS table_name, list(col_name_orig ORDER BY col_id) AS cols
         FROM columns WHERE table_id >= 0 GROUP BY ALL),
ddl_fk AS (SELECT c.db_id, c.table_id, c.col_id,
             'FOREIGN KEY (' || c.col_name_orig || ') REFERENCES ' || t.table_name_orig || ' (' || t.col_name_orig || ')' AS line
           FROM columns c JOIN columns t ON c.db_id = t.db_id AND c.fk_col_id = t.col_id WHERE c.table_id >= 0),
ddl_per AS (SELECT db_id, table_id, table_name_orig,
          list(col_name_orig || ' ' || CASE col_type WHEN 'text' THEN 'TEXT' WHEN 'number' THEN 'NUMERIC'
               WHEN 'time' THEN 'TIMESTAMP' WHEN 'boolean' THEN 'BOOLEAN' ELSE 'BLOB' END ORDER BY col_id) AS cl,
          list(col_name_orig ORDER BY col_id) FILTER (WHERE is_pk) AS pks
        FROM columns WHERE table_id >= 0 GROUP BY ALL),
ddl_fks AS (SELECT db_id, table_id, list(line ORDER BY col_id) AS lines FROM ddl_fk GROUP BY ALL),
ddlt AS (SELECT p.db_id, p.table_id,
  'CREATE TABLE ' || p.table_name_orig || ' (' || chr(10) || '  ' || array_to_string(list_concat(p.cl,
     CASE WHEN len(coalesce(p.pks, [])) > 0 THEN ['PRIMARY KEY (' || array_to_string(p.pks, ', ') || ')'] ELSE [] END,
     coalesce(f.lines, [])), ',' || chr(10) || '  ') || chr(10) || ')' AS ddl
  FROM ddl_per p LEFT JOIN ddl_fks f ON p.db_id = f.db_id AND p.table_id = f.table_id),
fkp AS (SELECT c.db_id, c.col_id AS fk_no, c.table_name_orig || '.' || c.col_name_orig || '=' || t.table_name_orig || '.' || t.col_name_orig AS ab
        FROM columns c JOIN columns t ON c.db_id = t.db_id AND c.fk_col_id = t.col_id WHERE c.table_id >= 0),
parts AS (SELECT t.db_id,
   (SELECT string_agg(d.ddl, chr(10) || chr(10) ORDER BY d.table_id) FROM ddlt d WHERE d.db_id = t.db_id) AS ddl,
   coalesce((SELECT string_agg(ab, ', ' ORDER BY fk_no) FROM fkp f WHERE f.db_id = t.db_id), '') AS fks,
   string_agg(t.table_name, ', ' ORDER BY t.table_id) AS tables,
   (SELECT string_agg(c.table_name_orig || '.' || c.col_name_orig, ', ' ORDER BY c.col_id) FROM columns c
     WHERE c.db_id = t.db_id AND c.table_id >= 0) AS columns_txt
  FROM tabs t GROUP BY t.db_id)"""


def _style_sql(style: str) -> str:
    """DuckDB expression of the style's info text over `parts` (alias p) and `tabs`."""
    s = pr.SCHEMA_STYLES[style]
    if s["table"] is not None:
        line = _sql_lit(s["table"]).replace("{t}", "' || x.table_name || '").replace(
            "{cols}", "' || array_to_string(x.cols, ', ') || '")
        lines = f"(SELECT string_agg({line}, chr(10) ORDER BY x.table_id) FROM tabs x WHERE x.db_id = p.db_id)"
    else:
        lines = "''"
    expr = _sql_lit(s["info"])
    for key, val in (("{schemas}", lines), ("{ddl}", "p.ddl"), ("{fks}", "p.fks"), ("{tables}", "p.tables"),
                     ("{columns}", "p.columns_txt")):
        expr = f"replace({expr}, '{key}', {val})"
    return expr


def _schema_sql(style: str) -> str:
    return f"sch AS (SELECT p.db_id, {_style_sql(style)} AS schema_text FROM parts p)"


_TABLES_SQL = _PARTS_SQL


@register("render_schema", oracle=f"WITH {_PARTS_SQL}\n" + "\nUNION ALL\n".join(
    f"SELECT p.db_id, '{st}' AS style, {_style_sql(st)} AS schema_text FROM parts p" for st in pr.SCHEMA_STYLES))
def q_render_schema(spark, sf):
    parts = _parts(spark, sf).cache()
    out = None
    for st in pr.SCHEMA_STYLES:
        one = pr.render_schema(parts, st).select("db_id", F.lit(st).alias("style"), "schema_text")
        out = one if out is None else out.unionByName(one)
    return out


@register("render_target", oracle=f"""WITH {EXEMPLARS}, {_TABLES_SQL}, {_schema_sql('NUMBERSIGN')}
SELECT e.ex_id AS target_id, s.schema_text || chr(10) || '### ' || e.question || chr(10) || 'SELECT ' AS target_text
FROM exemplars e JOIN sch s ON e.db_id = s.db_id""")
def q_render_target(spark, sf):
    q = exemplars(spark, sf).select(F.col("ex_id").alias("target_id"), "db_id", "question")
    return pr.render_target(q, pr.render_schema(_parts(spark, sf), "NUMBERSIGN"), "NUMBERSIGN").select(
        "target_id", "target_text")


@register("render_example", oracle=f"""WITH {EXEMPLARS}, {_TABLES_SQL}, {_schema_sql('NUMBERSIGN')},
x AS (SELECT e.*, s.schema_text || chr(10) || '### ' || question AS shown FROM exemplars e JOIN sch s USING (db_id))
SELECT ex_id, 'ONLYSQL' AS style, query AS example_text FROM x
UNION ALL SELECT ex_id, 'QA', '/* Answer the following: ' || question || ' */' || chr(10) || query FROM x
UNION ALL SELECT ex_id, 'QAWRULE', '/* Answer the following with no explanation: ' || question || ' */' || chr(10) || query FROM x
UNION ALL SELECT ex_id, 'COMPLETE', shown || chr(10) || query FROM x
UNION ALL SELECT ex_id, 'NUMBERSIGNQA', '### ' || question || chr(10) || query FROM x
UNION ALL SELECT ex_id, 'BASELINEQA', 'Example Q: ' || question || chr(10) || 'Example A: ' || query FROM x""")
def q_render_example(spark, sf):
    ex = exemplars(spark, sf)
    asked = pr.render_target(ex.select(F.col("ex_id").alias("target_id"), "db_id", "question"), pr.render_schema(_parts(spark, sf), "NUMBERSIGN"), "NUMBERSIGN")
    shots = ex.join(asked.select(F.col("target_id").alias("ex_id"), "question_text"), "ex_id")
    out = None
    for style in pr.EXAMPLE_STYLES:
        one = pr.render_example(shots, style).select("ex_id", F.lit(style).alias("style"), "example_text")
        out = one if out is None else out.unionByName(one)
    return out


def _packed(spark, sf):
    ev = _ev(spark, sf)
    t = ev.select(F.col("ex_id").alias("target_id"), "vec", F.col("db_id").alias("domain"))
    c = ev.select(F.col("ex_id").alias("cand_id"), "vec", F.col("db_id").alias("domain"))
    top = block_knn(t, c, 7, metric="cosine")
    shots = pr.render_example(top.join(ev.select(F.col("ex_id").alias("cand_id"), "question", "query"), "cand_id"),
                              "QA")
    q = ev.select(F.col("ex_id").alias("target_id"), "db_id", "question")
    targets = pr.render_target(q, pr.render_schema(_parts(spark, sf), "TEXT"), "TEXT")
    return pr.pack_prompt(targets, shots.select("target_id", "rk", "cand_id", "example_text"), 7, "QA")


_PACK_SQL = f"""WITH {EXEMPLARS}, {EXEMPLAR_VECTORS}, {_TABLES_SQL}, {_schema_sql('TEXT')},
tg AS (SELECT e.ex_id AS target_id, s.schema_text || chr(10) || 'Answer the following: ' || e.question
             || chr(10) || 'SELECT ' AS target_text FROM ev e JOIN sch s ON e.db_id = s.db_id),
p AS (SELECT t.ex_id AS target_id, c.ex_id AS cand_id,
        list_dot_product(t.v, c.v) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(c.v, c.v))) AS s,
        '/* Answer the following: ' || c.question || ' */' || chr(10) || c.query AS ex_text
      FROM ev t JOIN ev c ON t.db_id <> c.db_id),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(s, 12) DESC, cand_id) AS rk FROM p),
sh AS (SELECT * FROM r WHERE rk <= 7),
fold AS (
  WITH RECURSIVE w(target_id, rk, n, chars, ids, texts) AS (
    SELECT target_id, 0, 0, 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) FROM tg
    UNION ALL
    SELECT w.target_id, sh.rk,
      CASE WHEN fits THEN w.n + 1 ELSE w.n END, CASE WHEN fits THEN w.chars + length(sh.ex_text) ELSE w.chars END,
      CASE WHEN fits THEN list_append(w.ids, sh.cand_id) ELSE w.ids END,
      CASE WHEN fits THEN list_append(w.texts, sh.ex_text) ELSE w.texts END
    FROM w JOIN sh ON sh.target_id = w.target_id AND sh.rk = w.rk + 1
    JOIN tg ON tg.target_id = w.target_id,
    LATERAL (SELECT w.n < 7 AND
        greatest(1, (length('{pr.EXAMPLE_STYLES['QA']['prefix'].replace(chr(10), '')}') + 1 + w.chars + length(sh.ex_text)
                     + length(tg.target_text) + 2 * (w.n + 1)) // 4) + 512 <= 4096 AS fits))
  SELECT * FROM w),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY rk DESC) AS x FROM fold) WHERE x = 1),
pk AS (SELECT l.target_id, CASE WHEN l.n > 0 THEN {_lit(pr.EXAMPLE_STYLES['QA']['prefix'])} ||
          array_to_string(list_append(l.texts, tg.target_text), chr(10) || chr(10)) ELSE tg.target_text END AS prompt,
          CAST(l.n AS INTEGER) AS n_examples, l.ids AS kept
       FROM last l JOIN tg ON tg.target_id = l.target_id)"""


@register("pack_prompt", oracle=_PACK_SQL + """
SELECT target_id, CAST(CASE WHEN length(prompt) = 0 THEN 0 ELSE greatest(1, length(prompt) // 4) END AS INTEGER)
         AS prompt_tokens, n_examples, array_to_string(kept, ',') AS kept, md5(prompt) AS prompt_md5 FROM pk""")
def q_pack_prompt(spark, sf):
    p = _packed(spark, sf)
    return p.select("target_id", "prompt_tokens", "n_examples", F.array_join("kept", ",").alias("kept"),
                    F.md5("prompt").alias("prompt_md5"))


@register("prompt_stats", oracle=_PACK_SQL + """
SELECT count(*) AS n_prompts, sum(CAST(greatest(1, length(prompt) // 4) AS INTEGER)) AS total_tokens,
       sum(n_examples) AS total_examples, round(sum(greatest(1, length(prompt) // 4)) * 0.002 / 1000, 6) AS cost
FROM pk""")
def q_prompt_stats(spark, sf):
    return pr.prompt_stats(_packed(spark, sf), 0.002)


@register("example_quality", oracle=_ev_skel("gold_skel", "gold_skel") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(cos, 12) DESC, cand_id) AS rk FROM pjj),
k AS (SELECT * FROM r WHERE rk <= 7)
SELECT target_id, round(avg(jac), 6) AS quality, round((SELECT avg(jac) FROM k), 6) AS overall FROM k GROUP BY target_id""")
def q_example_quality(spark, sf):
    from shotweave.plans.retrieval_plans import _ev_sides

    t, c = _ev_sides(spark, sf, t_skel="gold_skel", c_skel="gold_skel")
    top = block_knn(t, c, 7, metric="cosine", skeleton_rule="score_only", keep_jaccard=True)
    q = pr.example_quality(top.select("target_id", "jaccard"))
    return q.select("target_id", F.round("quality", 6).alias("quality"), F.round("overall", 6).alias("overall"))


@register("agent_prompt")
def q_agent_prompt(spark, sf):
    from shotweave.operators import catalog as cat

    ev = _ev(spark, sf)
    cols = driver_columns(spark, sf)
    t = ev.select(F.col("ex_id").alias("target_id"), "vec", F.col("db_id").alias("domain"))
    c = ev.select(F.col("ex_id").alias("cand_id"), "vec", F.col("db_id").alias("domain"))
    top = block_knn(t, c, 2, metric="cosine")
    shots = top.join(ev.select(F.col("ex_id").alias("cand_id"), "question", "query"), "cand_id")
    targets = ev.select(F.col("ex_id").alias("target_id"), "db_id", "question")
    relevant = cat.prune_tables_by_name(targets.select(F.col("target_id").alias("q_id"), "db_id", "question"), cols) \
        .select(F.col("q_id").alias("target_id"), "table_name")
    ddl = cat.catalog_ddl(cols).join(cat.catalog_tables(cols), ["db_id", "table_name"])
    # foreign keys in text order
    fks = cat.catalog_foreign_keys(cols, style="eq").select("db_id", F.col("fk").alias("fk_no"), "fk")
    return pr.agent_prompt(targets, ddl, fks, relevant, shots.select("target_id", "rk", "question", "query"))


@register("pattern_similarity")
def q_pattern_similarity(spark, sf):
    from shotweave.operators import linking as lk
    from shotweave.plans.linking_plans import catalog, cells

    ev = _ev(spark, sf)
    qs = ev.select(F.col("ex_id").alias("q_id"), "db_id", "question",
                   lk.tokenize_question(F.col("question")).alias("toks"))
    pat = lk.question_pattern(qs, lk.all_links(qs, catalog(spark, sf), cells(spark, sf))) \
        .select(F.col("q_id").alias("ex_id"), "pattern")
    t = ev.select(F.col("ex_id").alias("target_id"), "vec", F.col("db_id").alias("domain"))
    c = ev.select(F.col("ex_id").alias("cand_id"), "vec", F.col("db_id").alias("domain"))
    top = block_knn(t, c, 7, metric="cosine")
    pairs = (top.join(pat.select(F.col("ex_id").alias("target_id"), F.col("pattern").alias("t_pattern")), "target_id")
             .join(pat.select(F.col("ex_id").alias("cand_id"), F.col("pattern").alias("c_pattern")), "cand_id"))
    out = pr.pattern_similarity(pairs)
    return out.select("target_id", F.round("similarity", 6).alias("similarity"), F.round("overall", 6).alias("overall"))
