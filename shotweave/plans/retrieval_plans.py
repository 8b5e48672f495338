"""Registered retrieval queries: every vector is a target against the
whole corpus, leaving itself and (by default) its own domain out."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotweave.operators.knn import block_knn
from shotweave.plans.registry import register
from shotweave.sources.tables import vectors

# Shared oracle fragment: all vectors as DOUBLE[] with their label as domain.
_VEC_CTE = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _vec_sides(spark, sf):
    v = vectors(spark, sf)
    targets = v.select(F.col("vec_id").alias("target_id"), "vec", F.col("label").cast("string").alias("domain"))
    corpus = v.select(F.col("vec_id").alias("cand_id"), "vec", F.col("label").cast("string").alias("domain"))
    return targets, corpus


@register("knn_cosine", headline=True, oracle=f"""
WITH {_VEC_CTE},
p AS (SELECT t.vec_id AS target_id, c.vec_id AS cand_id,
             list_dot_product(t.v, c.v) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(c.v, c.v))) AS s
      FROM e t JOIN e c ON t.label <> c.label AND t.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(s, 12) DESC, cand_id) AS rk FROM p)
SELECT target_id, cand_id, round(s, 6) AS score, CAST(rk AS INTEGER) AS rk FROM r WHERE rk <= 5
""")
def knn_cosine(spark, sf):
    t, c = _vec_sides(spark, sf)
    return block_knn(t, c, 5, metric="cosine")


@register("knn_euclid", oracle=f"""
WITH {_VEC_CTE},
p AS (SELECT t.vec_id AS target_id, c.vec_id AS cand_id, list_distance(t.v, c.v) AS s
      FROM e t JOIN e c ON t.label <> c.label AND t.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(s, 12), cand_id) AS rk FROM p)
SELECT target_id, cand_id, round(s, 6) AS score, CAST(rk AS INTEGER) AS rk FROM r WHERE rk <= 5
""")
def knn_euclid(spark, sf):
    t, c = _vec_sides(spark, sf)
    return block_knn(t, c, 5, metric="euclid")


@register("knn_euclid_threshold", oracle=f"""
WITH {_VEC_CTE},
p AS (SELECT t.vec_id AS target_id, c.vec_id AS cand_id, list_distance(t.v, c.v) AS s
      FROM e t JOIN e c ON t.label <> c.label AND t.vec_id <> c.vec_id
      WHERE list_distance(t.v, c.v) <= 1.25),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(s, 12), cand_id) AS rk FROM p)
SELECT target_id, cand_id, round(s, 6) AS score, CAST(rk AS INTEGER) AS rk FROM r WHERE rk <= 7
""")
def knn_euclid_threshold(spark, sf):
    # the driver vectors have no pair within 0.85, so the threshold is a parameter (1.25)
    t, c = _vec_sides(spark, sf)
    return block_knn(t, c, 7, metric="euclid", max_distance=1.25)


# --------------------------------------------------------------------------- BM25
from shotweave.functions import sqltext as st  # noqa: E402
from shotweave.operators import pools as pl  # noqa: E402
from shotweave.operators.bm25 import bm25_index, bm25_scores, bm25_topk  # noqa: E402
from shotweave.operators.sparse import sparse_topk  # noqa: E402
from shotweave.operators.whitening import whiten  # noqa: E402
from shotweave.session import checkpoint_dir  # noqa: E402
from shotweave.plans.oracle_sql import (CATALOG, DB_NAMES, EXEMPLAR_VECTORS, EXEMPLARS, RESPONSES,  # noqa: E402
                                        bm25_ctes, exemplar_white_ctes, normalize_ctes, skeleton_ctes, sparse_cosine_sql)
from shotweave.sources.derived import database_names, in_catalog, responses  # noqa: E402
from shotweave.sources.tables import exemplar_keys, exemplars, read_table  # noqa: E402

_BENCH_DOCS = """tq AS (SELECT item_id AS target_id, text FROM benchmark),
cd AS (SELECT doc_id AS cand_id, text FROM documents)"""


@register("bm25_scores", headline=True, oracle=f"""
WITH {_BENCH_DOCS}, {bm25_ctes('tq', 'cd')}
SELECT target_id, cand_id, round(score, 6) AS score FROM bm""")
def q_bm25_scores(spark, sf):
    t = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"), "text")
    c = read_table(spark, sf, "documents").select(F.col("doc_id").alias("cand_id"), "text")
    return bm25_scores(t, c).select("target_id", "cand_id", F.round("score", 6).alias("score"))


@register("bm25_topk", oracle=f"""
WITH {_BENCH_DOCS}, {bm25_ctes('tq', 'cd')},
f AS (SELECT b.* FROM bm b JOIN tq ON tq.target_id = b.target_id JOIN cd ON cd.cand_id = b.cand_id WHERE tq.text <> cd.text),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(score, 12) DESC, cand_id) AS rk FROM f)
SELECT target_id, cand_id, round(score, 6) AS score, CAST(rk AS INTEGER) AS rk FROM r WHERE rk <= 5""")
def q_bm25_topk(spark, sf):
    t = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"), "text")
    c = read_table(spark, sf, "documents").select(F.col("doc_id").alias("cand_id"), "text")
    return bm25_topk(t, c, 5, exclude_same_text=True)


# ------------------------------------------------------------ exemplar-level sides
def _ev(spark, sf):
    """Exemplars with vectors, gold skeleton and predicted skeleton; text is made only for those that have a vector."""
    names = database_names(spark, sf)
    keys = exemplar_keys(spark, sf, with_vector=True).checkpoint()
    ex = in_catalog(exemplars(spark, sf, keys), names)
    emb = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("ex_id"), F.col("embedding").cast("array<double>").alias("vec"))
    pred = responses(spark, sf, keys).select("ex_id", st.clean_fences(F.col("response")).alias("pred"))
    ev = ex.join(emb, "ex_id").join(pred, "ex_id")
    ev = st.with_sql_skeleton_once(ev, "query", "db_id", names, out="gold_skel")
    ev = st.with_sql_skeleton_once(ev, "pred", "db_id", names, out="pre_skel")
    return ev.checkpoint()  # targets, corpus and joins of skeletons read it


def _ev_sides(spark, sf, t_skel=None, c_skel=None):
    ev = _ev(spark, sf)
    t = ev.select(F.col("ex_id").alias("target_id"), "vec", F.col("db_id").alias("domain"),
                  F.col("question").alias("text"), *([F.col(t_skel).alias("skel")] if t_skel else []))
    c = ev.select(F.col("ex_id").alias("cand_id"), "vec", F.col("db_id").alias("domain"),
                  F.col("question").alias("text"), *([F.col(c_skel).alias("skel")] if c_skel else []))
    return t, c


_EV_SKEL = f"""WITH {EXEMPLARS}, {RESPONSES}, {CATALOG}, {DB_NAMES}, {EXEMPLAR_VECTORS},
evr AS (SELECT ev.*, r.response, regexp_replace(r.response, '^\\s+|\\s+$', '', 'g') AS rr FROM ev JOIN responses r ON ev.ex_id = r.ex_id),
evp AS (SELECT *, CASE WHEN contains(rr, '```sql') THEN regexp_replace(split_part(split_part(rr, '```sql', 2), '```', 1), '^\\s+|\\s+$', '', 'g')
     WHEN contains(rr, '```') THEN regexp_replace(split_part(split_part(rr, '```', 2), '```', 1), '^\\s+|\\s+$', '', 'g')
     ELSE rr END AS pred FROM evr),
{normalize_ctes('evp', 'ex_id, db_id', 'query', 'gn')},
{skeleton_ctes('gn', 'ex_id', 'gsk')},
{normalize_ctes('evp', 'ex_id, db_id', 'pred', 'pn')},
{skeleton_ctes('pn', 'ex_id', 'psk')},
evs AS (SELECT e.*, g.skel AS gold_skel, p.skel AS pre_skel FROM ev e JOIN gsk g ON e.ex_id = g.ex_id JOIN psk p ON e.ex_id = p.ex_id),
pairs AS (SELECT t.ex_id AS target_id, c.ex_id AS cand_id, t.question = c.question AS same_q,
            list_dot_product(t.v, c.v) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(c.v, c.v))) AS cos,
            list_distance(t.v, c.v) AS dist,
            string_split(trim(t.__TSK__), ' ') AS a, string_split(trim(c.__CSK__), ' ') AS b
          FROM evs t JOIN evs c ON t.db_id <> c.db_id),
pj AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)),
          len(list_filter(b, lambda y: y = x))))) AS inter FROM pairs),
pjj AS (SELECT *, coalesce(inter, 0) / (len(a) + len(b) - coalesce(inter, 0)) AS jac FROM pj)"""


def _ev_skel(tsk: str, csk: str) -> str:
    return _EV_SKEL.replace("__TSK__", tsk).replace("__CSK__", csk)


def _question_topk(spark, sf, exclude_same_text):
    """Every exemplar against all of them, by the words of the questions."""
    ex = exemplars(spark, sf).select("ex_id", F.col("db_id").alias("domain"), F.col("question").alias("text"), F.col("question").alias("body"))
    return sparse_topk(ex.withColumnRenamed("ex_id", "target_id"), ex.withColumnRenamed("ex_id", "cand_id"), 5,
                       metric="cosine", exclude_same_text=exclude_same_text)


_QUESTIONS = f"WITH {EXEMPLARS}, qx AS (SELECT ex_id, db_id, question, question AS txt FROM exemplars),"


@register("filter_cross_domain", oracle=_QUESTIONS + sparse_cosine_sql("qx", other_text=False, every=True))
def q_filter_cross_domain(spark, sf):
    return _question_topk(spark, sf, exclude_same_text=False)


@register("filter_same_question", oracle=_QUESTIONS + sparse_cosine_sql("qx", other_text=True, every=True))
def q_filter_same_question(spark, sf):
    return _question_topk(spark, sf, exclude_same_text=True)


@register("knn_preskeleton_backfill", oracle=_ev_skel("pre_skel", "gold_skel") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY CASE WHEN jac >= 0.85 THEN 0 ELSE 1 END,
        round(dist, 12), cand_id) AS rk FROM pjj)
SELECT target_id, cand_id, round(dist, 6) AS score, CAST(rk AS INTEGER) AS rk, round(jac, 6) AS jaccard FROM r WHERE rk <= 5""")
def q_knn_preskeleton_backfill(spark, sf):
    t, c = _ev_sides(spark, sf, t_skel="pre_skel", c_skel="gold_skel")
    return block_knn(t, c, 5, metric="euclid", skeleton_rule="backfill", keep_jaccard=True).withColumn(
        "jaccard", F.round("jaccard", 6))


@register("knn_preskeleton_plus", oracle=_ev_skel("pre_skel", "gold_skel") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(dist - jac, 12), cand_id) AS rk FROM pjj)
SELECT target_id, cand_id, round(dist, 6) AS score, CAST(rk AS INTEGER) AS rk, round(jac, 6) AS jaccard FROM r WHERE rk <= 5""")
def q_knn_preskeleton_plus(spark, sf):
    t, c = _ev_sides(spark, sf, t_skel="pre_skel", c_skel="gold_skel")
    return block_knn(t, c, 5, metric="euclid", skeleton_rule="plus", keep_jaccard=True).withColumn(
        "jaccard", F.round("jaccard", 6))


def _random_sql(k: int = 5, most: int = 400) -> str:
    """Each exemplar walks its own order of all positions; ``most`` steps are many times what any of them needs."""
    key = lambda j: f"('0x' || substr(md5('0:' || CAST(ex_id AS VARCHAR) || ':{j}'), 1, 7))::BIGINT"
    rounds, l, r = "", "step // half", "step % half"
    for j in range(4):
        rounds += f""",
u{j} AS (SELECT target_id, db_id, half, step, {l} AS l, {r} AS r, (({r}) * 40503 + k{j}) % 2147483648 AS u, k0, k1, k2, k3 FROM {'walk' if j == 0 else f'f{j - 1}'}),
f{j} AS (SELECT target_id, db_id, half, step, r AS l, xor(l, ((((u % 65536) * 30269 + (u // 65536) * 27449 + k{j}) % 2147483648) // 1024) % half) AS r, k0, k1, k2, k3 FROM u{j})"""
        l, r = "l", "r"
    return f"""WITH {EXEMPLARS},
n AS (SELECT CAST(2 ** ceil(log2(count(*)) / 2) AS BIGINT) AS half FROM exemplars),
placed AS (SELECT ex_id AS cand_id, db_id AS c_domain, row_number() OVER (ORDER BY ex_id) - 1 AS pos FROM exemplars),
keyed AS (SELECT ex_id AS target_id, db_id, {", ".join(f"{key(j)} AS k{j}" for j in range(4))} FROM exemplars),
walk AS (SELECT *, unnest(range(least({most}, half * half))) AS step FROM keyed, n){rounds},
met AS (SELECT target_id, cand_id, row_number() OVER (PARTITION BY target_id ORDER BY step) AS rk FROM f3 JOIN placed ON pos = l * half + r WHERE db_id <> c_domain)
SELECT target_id, cand_id, CAST(rk AS INTEGER) AS rk FROM met WHERE rk <= {k}"""


@register("retrieve_random", oracle=_random_sql())
def q_retrieve_random(spark, sf):
    ex = exemplars(spark, sf)
    return pl.retrieve_random(ex.select(F.col("ex_id").alias("target_id"), F.col("db_id").alias("domain")),
                              ex.select(F.col("ex_id").alias("cand_id"), F.col("db_id").alias("domain")), 5, seed=0)


# ------------------------------------------------------------------ hybrid pools
K_SHOTS = 7
KPRIME = pl.candidate_k(K_SHOTS)


def _pool_stages(spark, sf):
    """Main pool (BM25 and whitened cosine lists interleaved) and the pool with sub-question
    stages (each sub-question's BM25 top 10), over exemplars with vectors."""
    checkpoint_dir(spark)
    ex = exemplars(spark, sf, exemplar_keys(spark, sf, with_vector=True))
    emb = whiten(vectors(spark, sf).select("vec_id", "vec")).withColumnRenamed("vec_id", "ex_id")
    ev = ex.join(emb, "ex_id").checkpoint()
    t_dom = ev.select(F.col("ex_id").alias("target_id"), F.col("db_id").alias("t_domain"))
    c_dom = ev.select(F.col("ex_id").alias("cand_id"), F.col("db_id").alias("c_domain"))
    tq = ev.select(F.col("ex_id").alias("target_id"), F.col("question").alias("text"))
    cd = ev.select(F.col("ex_id").alias("cand_id"), F.col("question").alias("text"))
    index = bm25_index(cd)
    bm = bm25_topk(tq, cd, KPRIME, exclude_same_text=False, index=index)
    cos = block_knn(ev.select(F.col("ex_id").alias("target_id"), "vec"), ev.select(F.col("ex_id").alias("cand_id"), "vec"),
                    KPRIME, metric="cosine", exclude_same_domain=False, exclude_self=False)
    main = pl.hybrid_interleave(bm, cos, t_dom, c_dom, KPRIME)
    subs = ev.select("ex_id", F.posexplode(st.parse_subquestions(F.col("question"))).alias("p", "text"))
    sub_t = subs.select(F.struct("ex_id", (F.col("p") + 1).alias("sub_no")).alias("target_id"), "text")
    sb = bm25_topk(sub_t, cd, 10, exclude_same_text=False, index=index).select(
        F.col("target_id.ex_id").alias("target_id"), F.col("target_id.sub_no").cast("int").alias("sub_no"),
        "cand_id", "rk")
    pool = pl.append_subquestion_pools(main, sb, t_dom, c_dom, per_sub=10)
    return main, pool


_POOL_SQL = f"""WITH {EXEMPLARS}, {exemplar_white_ctes()},
tq AS (SELECT ex_id AS target_id, question AS text FROM ev),
cd AS (SELECT ex_id AS cand_id, question AS text FROM ev),
{bm25_ctes('tq', 'cd', 'bm')},
allp AS (SELECT t.ex_id AS target_id, c.ex_id AS cand_id, coalesce(b.score, 0) AS score, t.db_id AS t_dom, c.db_id AS c_dom,
           list_dot_product(t.wv, c.wv) / (sqrt(list_dot_product(t.wv, t.wv)) * sqrt(list_dot_product(c.wv, c.wv))) AS cos
         FROM ev t CROSS JOIN ev c LEFT JOIN bm b ON b.target_id = t.ex_id AND b.cand_id = c.ex_id),
ra AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(score, 12) DESC, cand_id) AS rk_a,
                 row_number() OVER (PARTITION BY target_id ORDER BY round(cos, 12) DESC, cand_id) AS rk_b FROM allp),
u AS (SELECT target_id, cand_id, 2 * rk_a AS key, t_dom, c_dom FROM ra WHERE rk_a <= {KPRIME}
      UNION ALL SELECT target_id, cand_id, 2 * rk_b + 1, t_dom, c_dom FROM ra WHERE rk_b <= {KPRIME}),
mn AS (SELECT target_id, cand_id, min(key) AS key FROM u WHERE t_dom <> c_dom GROUP BY target_id, cand_id),
mainp AS (SELECT target_id, cand_id, 0 AS stage, row_number() OVER (PARTITION BY target_id ORDER BY key) AS ord FROM mn),
subl AS (SELECT ex_id, db_id, list_filter(list_transform(string_split(question, ','),
           lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM ev),
subs AS (SELECT ex_id, db_id, unnest(l) AS text, generate_subscripts(l, 1) AS sub_no FROM subl),
sq AS (SELECT {{'ex_id': ex_id, 'sub_no': sub_no}} AS target_id, text FROM subs),
{bm25_ctes('sq', 'cd', 'sb')},
sall AS (SELECT s.ex_id AS target_id, s.sub_no, c.ex_id AS cand_id, coalesce(b.score, 0) AS score, s.db_id AS t_dom,
           c.db_id AS c_dom
         FROM subs s CROSS JOIN ev c LEFT JOIN sb b ON b.target_id.ex_id = s.ex_id AND b.target_id.sub_no = s.sub_no AND b.cand_id = c.ex_id),
sr AS (SELECT *, row_number() OVER (PARTITION BY target_id, sub_no ORDER BY round(score, 12) DESC, cand_id) AS rk FROM sall),
sp AS (SELECT target_id, cand_id, sub_no AS stage, rk AS ord FROM sr WHERE rk <= 10 AND t_dom <> c_dom),
allpool AS (SELECT * FROM mainp UNION ALL SELECT * FROM sp),
firstp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, cand_id ORDER BY stage, ord) AS x
                          FROM allpool) WHERE x = 1),
pool AS (SELECT target_id, cand_id, CAST(stage AS INTEGER) AS stage,
           CAST(row_number() OVER (PARTITION BY target_id, stage ORDER BY ord) AS INTEGER) AS stage_rank,
           CAST(row_number() OVER (PARTITION BY target_id ORDER BY stage, ord) AS INTEGER) AS pos FROM firstp)"""


@register("hybrid_interleave", oracle=_POOL_SQL + """
SELECT target_id, cand_id, CAST(ord AS INTEGER) AS pos FROM mainp""")
def q_hybrid_interleave(spark, sf):
    main, _ = _pool_stages(spark, sf)
    return main.select("target_id", "cand_id", "pos")


@register("append_subquestion_pools", oracle=_POOL_SQL + """
SELECT target_id, cand_id, stage, stage_rank, pos FROM pool""")
def q_append_subquestion_pools(spark, sf):
    _, pool = _pool_stages(spark, sf)
    return pool


@register("cap_pool", oracle=_POOL_SQL + f"""
SELECT target_id, cand_id, pos FROM pool WHERE pos <= {2 * KPRIME}""")
def q_cap_pool(spark, sf):
    _, pool = _pool_stages(spark, sf)
    return pl.cap_pool(pool, KPRIME).select("target_id", "cand_id", "pos")


@register("round_robin_pick", oracle=_POOL_SQL + f""",
keyed AS (SELECT *, CASE WHEN stage = 0 AND stage_rank <= 2 THEN 0 WHEN stage > 0 THEN 1 ELSE 2 END AS a,
            CASE WHEN stage > 0 THEN stage ELSE 0 END AS c FROM pool),
pk AS (SELECT target_id, cand_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY a, stage_rank, c) AS INTEGER) AS pick
       FROM keyed)
SELECT * FROM pk WHERE pick <= {K_SHOTS}""")
def q_round_robin_pick(spark, sf):
    _, pool = _pool_stages(spark, sf)
    return pl.round_robin_pick(pool, K_SHOTS)


@register("greedy_fill", oracle=_POOL_SQL + f""",
pk AS (SELECT target_id, cand_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY pos) AS INTEGER) AS pick
       FROM pool WHERE pos <= {2 * KPRIME})
SELECT * FROM pk WHERE pick <= {K_SHOTS}""")
def q_greedy_fill(spark, sf):
    _, pool = _pool_stages(spark, sf)
    return pl.greedy_fill(pl.cap_pool(pool, KPRIME), K_SHOTS)
