"""Registered query-text and question-text queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotweave.functions import sqltext as st
from shotweave.operators.catalog import prune_tables_by_name
from shotweave.plans.oracle_sql import (CATALOG, DB_NAMES, EXEMPLARS, RESPONSES, normalize_ctes, q,
                                        skeleton_ctes)
from shotweave.plans.registry import register
from shotweave.sources.catalog import driver_columns
from shotweave.sources.derived import database_names, in_catalog, responses
from shotweave.sources.tables import exemplar_keys, exemplars, read_table

_WORDS = "[" + ", ".join(q(w) for w in st.SINGLE_KEYWORDS) + "]"


def features_list_sql(low: str) -> str:
    """DuckDB expression: sorted distinct feature list of a lower-cased, trimmed text column."""
    phrases = ", ".join(f"CASE WHEN contains({low}, {q(p)}) THEN {q(p)} END" for p in st.MULTI_WORD_PHRASES)
    ops = ", ".join(f"CASE WHEN contains({low}, {q(o)}) THEN {q(o)} END" for o in st.OPERATORS)
    return f"""list_sort(list_distinct(list_concat(
      list_filter([{phrases},
        CASE WHEN len(regexp_extract_all({low}, '\\bselect\\b')) > 1 THEN 'subquery' END,
        {ops},
        CASE WHEN contains({low}, 'cast') AND contains({low}, ' as ') THEN 'cast' END], lambda e: e IS NOT NULL),
      list_filter(regexp_extract_all({low}, '[a-z_]+|[!=<>]+'), lambda t: list_contains({_WORDS}, t)))))"""


def _features_sql(text_expr: str) -> str:
    """DuckDB expression: comma-joined feature set of the column `low`."""
    return f"array_to_string({features_list_sql('low')}, ',')"


@register("sql_features", oracle=f"""
WITH {EXEMPLARS},
x AS (SELECT ex_id, regexp_replace(lower(coalesce(query, '')), '^\\s+|\\s+$', '', 'g') AS low FROM exemplars)
SELECT ex_id, {_features_sql('low')} AS features FROM x
""")
def q_sql_features(spark, sf):
    ex = exemplars(spark, sf)
    return ex.select("ex_id", F.array_join(st.sql_features(F.col("query")), ",").alias("features"))


@register("style_fingerprint", oracle=f"""
WITH {EXEMPLARS}
SELECT ex_id,
  CASE WHEN contains(query, '<>') THEN '<>' WHEN contains(query, '!=') THEN '!=' ELSE 'none' END AS neq_style,
  CASE WHEN len(regexp_extract_all(query, '\\b[tT]\\d+\\b')) > 0 THEN 'short' ELSE 'full' END AS alias_style,
  CASE WHEN length(query) - length(replace(query, '"', '')) > length(query) - length(replace(query, '''', ''))
       THEN 'double' ELSE 'single' END AS quote_style,
  CASE WHEN len(regexp_extract_all(query, {q(st.UPPER_KEYWORDS_RE)})) > len(regexp_extract_all(query, {q(st.LOWER_KEYWORDS_RE)}))
       THEN 'upper' ELSE 'lower' END AS case_style
FROM exemplars
""")
def q_style_fingerprint(spark, sf):
    fp = st.style_fingerprint(F.col("query"))
    return exemplars(spark, sf).select("ex_id", fp["neq_style"].alias("neq_style"), fp["alias_style"].alias(
        "alias_style"), fp["quote_style"].alias("quote_style"), fp["case_style"].alias("case_style"))


def _resp(spark, sf):
    return responses(spark, sf)


_RESP_WITH = f"WITH {EXEMPLARS}, {RESPONSES}"


@register("clean_cut_comment", oracle=f"""{_RESP_WITH}
SELECT ex_id, split_part(regexp_replace(response, '^\\s+|\\s+$', '', 'g'), '/*', 1) AS cleaned FROM responses""")
def q_clean_cut_comment(spark, sf):
    return _resp(spark, sf).select("ex_id", st.clean_cut_comment(F.col("response")).alias("cleaned"))


@register("clean_operators", oracle=f"""{_RESP_WITH}
SELECT ex_id, replace(replace(replace(response, '> =', '>='), '< =', '<='), '! =', '!=') AS cleaned FROM responses""")
def q_clean_operators(spark, sf):
    return _resp(spark, sf).select("ex_id", st.clean_operators(F.col("response")).alias("cleaned"))


@register("clean_current_year", oracle=f"""{_RESP_WITH}
SELECT ex_id, regexp_replace(response, '(?i)YEAR\\s*\\(\\s*CURDATE\\s*\\(\\s*\\)\\s*\\)\\s*', '2020', 'g') AS cleaned
FROM responses""")
def q_clean_current_year(spark, sf):
    return _resp(spark, sf).select("ex_id", st.clean_current_year(F.col("response")).alias("cleaned"))


@register("clean_distinct", oracle=f"""{_RESP_WITH}
SELECT ex_id, array_to_string(list_transform(regexp_extract_all(response, '''[^'']*''|"[^"]*"|[^''"]+|[''"]'),
   lambda ch: CASE WHEN starts_with(ch, '''') OR starts_with(ch, '"') THEN ch
              ELSE regexp_replace(ch, '(?i)\\bdistinct\\b', '', 'g') END), '') AS cleaned
FROM responses""")
def q_clean_distinct(spark, sf):
    return _resp(spark, sf).select("ex_id", st.clean_distinct(F.col("response")).alias("cleaned"))


def _fence_sql(v: str) -> str:
    trim = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    return (f"CASE WHEN contains({v}, '```sql') THEN "
            + trim.format(f"split_part(split_part({v}, '```sql', 2), '```', 1)")
            + f" WHEN contains({v}, '```') THEN "
            + trim.format(f"split_part(split_part({v}, '```', 2), '```', 1)")
            + f" ELSE {v} END")


_FENCE_SQL = _fence_sql("s")


@register("clean_fences", oracle=f"""{_RESP_WITH},
x AS (SELECT ex_id, regexp_replace(response, '^\\s+|\\s+$', '', 'g') AS s FROM responses)
SELECT ex_id, {_FENCE_SQL} AS cleaned FROM x""")
def q_clean_fences(spark, sf):
    return _resp(spark, sf).select("ex_id", st.clean_fences(F.col("response")).alias("cleaned"))


@register("clean_select_prefix", oracle=f"""{_RESP_WITH},
t AS (SELECT ex_id, regexp_replace(response, '^\\s+|\\s+$', '', 'g') AS s0 FROM responses),
p AS (SELECT ex_id, CASE WHEN starts_with(upper(s0), 'SELECT') THEN s0 ELSE 'SELECT ' || s0 END AS prefixed FROM t),
x AS (SELECT ex_id, prefixed, regexp_replace(prefixed, '^\\s+|\\s+$', '', 'g') AS s FROM p)
SELECT ex_id, prefixed, {_FENCE_SQL} AS cleaned FROM x""")
def q_clean_select_prefix(spark, sf):
    # the generator adds the prefix before removing fences, so fenced answers lose it again
    r = _resp(spark, sf).withColumn("prefixed", st.clean_select_prefix(F.col("response")))
    return r.select("ex_id", "prefixed", st.clean_fences(F.col("prefixed")).alias("cleaned"))


@register("extract_json_object", oracle="""
SELECT page_id, nullif(regexp_extract(html, '(?s)\\{.*\\}', 0), '') AS obj FROM pages""")
def q_extract_json_object(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", st.extract_json_object(F.col("html")).alias("obj"))


@register("parse_subquestions")
def q_parse_subquestions(spark, sf):
    conv = read_table(spark, sf, "conversations")
    items = st.parse_subquestions(F.col("text"))
    return conv.select("conv_id", "turn", F.posexplode(items).alias("sub_no", "sub_question"))


@register("token_count", oracle="""
SELECT doc_id, CAST(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS INTEGER) AS n_tokens
FROM documents""")
def q_token_count(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", st.token_count(F.col("text")).alias("n_tokens"))


_PRICE_VALUES = ", ".join(f"({q(m)}, {p})" for m, p in st.LLM_PRICES)


@register("llm_cost", oracle=f"""
WITH prices AS (SELECT * FROM (VALUES {_PRICE_VALUES}) v(model, price)),
t AS (SELECT sum(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE greatest(1, length(text) // 4) END) AS n FROM documents)
SELECT model, CAST(n AS BIGINT) AS n_tokens, round(price * n / 1000, 6) AS cost FROM prices, t""")
def q_llm_cost(spark, sf):
    n = read_table(spark, sf, "documents").agg(F.sum(st.token_count(F.col("text"))).cast("long")).first()[0]
    prices = spark.createDataFrame(st.LLM_PRICES, "model string, price double")
    return prices.select("model", F.lit(n).cast("long").alias("n_tokens"),
                         F.round(F.col("price") * F.lit(n) / 1000, 6).alias("cost"))


@register("response_target", oracle=f"""
WITH {EXEMPLARS}
SELECT ex_id, substr(regexp_replace(regexp_replace(query, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 8) AS response
FROM exemplars""")
def q_response_target(spark, sf):
    return exemplars(spark, sf).select("ex_id", st.response_target(F.col("query")).alias("response"))


@register("intent_features", oracle=f"""
WITH {EXEMPLARS}, {CATALOG},
tabs AS (SELECT DISTINCT db_id, table_name_orig AS table_name FROM columns WHERE table_id >= 0),
pairs AS (SELECT e.ex_id, lower(e.question) AS ql, t.table_name,
           contains(lower(e.question), lower(t.table_name)) OR contains(lower(e.question), rtrim(lower(t.table_name), 's')) AS hit
          FROM exemplars e JOIN tabs t ON e.db_id = t.db_id),
n AS (SELECT ex_id, any_value(ql) AS ql,
        CASE WHEN max(CAST(hit AS INT)) = 1 THEN sum(CAST(hit AS INT)) ELSE count(*) END AS n_tables
      FROM pairs GROUP BY ex_id)
SELECT ex_id, CAST(n_tables AS INTEGER) AS n_tables, array_to_string(list_sort(list_distinct(list_filter([
  CASE WHEN contains(ql, 'count') OR contains(ql, 'how many') OR contains(ql, 'total number') THEN 'count' END,
  CASE WHEN contains(ql, 'join') OR contains(ql, 'and their') OR n_tables > 1 THEN 'join' END,
  CASE WHEN contains(ql, 'group by') OR contains(ql, 'per') OR contains(ql, 'each') THEN 'group by' END,
  CASE WHEN contains(ql, 'order by') OR contains(ql, 'sorted by') OR contains(ql, 'highest') OR contains(ql, 'desc') THEN 'order by' END,
  CASE WHEN contains(ql, 'order by') OR contains(ql, 'sorted by') OR contains(ql, 'highest') OR contains(ql, 'desc') THEN 'desc' END,
  CASE WHEN contains(ql, 'average') OR contains(ql, 'avg') THEN 'avg' END,
  CASE WHEN contains(ql, 'maximum') OR contains(ql, 'max') THEN 'max' END,
  'select', 'from'], lambda e: e IS NOT NULL))), ',') AS features
FROM n""")
def q_intent_features(spark, sf):
    ex = exemplars(spark, sf)
    relevant = prune_tables_by_name(ex.select(F.col("ex_id").alias("q_id"), "db_id", "question"),
                                    driver_columns(spark, sf))
    n = relevant.groupBy(F.col("q_id").alias("ex_id")).agg(F.count("*").cast("int").alias("n_tables"))
    return ex.join(n, "ex_id").select("ex_id", "n_tables", F.array_join(
        st.intent_features(F.col("question"), F.col("n_tables")), ",").alias("features"))


@register("sql_normalize", oracle=f"""
WITH {EXEMPLARS}, {normalize_ctes('exemplars', 'ex_id', 'query', 'nrm')}
SELECT ex_id, norm FROM nrm""")
def q_sql_normalize(spark, sf):
    return st.with_sql_normalize(exemplars(spark, sf), "query").select("ex_id", "norm")


@register("sql_skeleton", oracle=f"""
WITH {EXEMPLARS}, {CATALOG}, {DB_NAMES}, {normalize_ctes('exemplars', 'ex_id, db_id', 'query', 'nrm')},
{skeleton_ctes('nrm', 'ex_id', 'sk')}
SELECT ex_id, skel FROM sk""")
def q_sql_skeleton(spark, sf):
    names = database_names(spark, sf)
    ex = in_catalog(exemplars(spark, sf, exemplar_keys(spark, sf)), names)
    return st.with_sql_skeleton_once(ex, "query", "db_id", names).select("ex_id", "skel")


@register("skeleton_jaccard", oracle=f"""
WITH {EXEMPLARS}, {RESPONSES}, {CATALOG}, {DB_NAMES},
{normalize_ctes('exemplars', 'ex_id, db_id', 'query', 'gn')},
{skeleton_ctes('gn', 'ex_id', 'gold')},
pred_src AS (SELECT ex_id, db_id, {_fence_sql('r')} AS pred
             FROM (SELECT ex_id, db_id, regexp_replace(response, '^\\s+|\\s+$', '', 'g') AS r FROM responses)),
{normalize_ctes('pred_src', 'ex_id, db_id', 'pred', 'pn')},
{skeleton_ctes('pn', 'ex_id', 'predsk')},
toks AS (SELECT g.ex_id, string_split(trim(g.skel), ' ') AS a, string_split(trim(p.skel), ' ') AS b
         FROM gold g JOIN predsk p ON g.ex_id = p.ex_id),
inter AS (SELECT ex_id, a, b, list_sum(list_transform(list_distinct(a),
            lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))) AS i FROM toks)
SELECT ex_id, round(coalesce(i, 0) / (len(a) + len(b) - coalesce(i, 0)), 6) AS jaccard FROM inter""")
def q_skeleton_jaccard(spark, sf):
    """Gold skeleton of each exemplar against the skeleton of its cleaned response."""
    names = database_names(spark, sf)
    keys = exemplar_keys(spark, sf).checkpoint()
    ex = in_catalog(exemplars(spark, sf, keys), names)
    pred = responses(spark, sf, keys).select("ex_id", st.clean_fences(F.col("response")).alias("pred"))
    j = ex.join(pred, "ex_id")
    j = st.with_sql_skeleton_once(j, "query", "db_id", names, out="gold")
    j = st.with_sql_skeleton_once(j, "pred", "db_id", names, out="pre")
    j = st.with_skeleton_jaccard(j, "gold", "pre")
    return j.select("ex_id", F.round("jaccard", 6).alias("jaccard"))
