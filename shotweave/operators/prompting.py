"""Prompt assembly, one row per target.

Schema and example styles are rows of a small template table, so one expression
renders every style. `pack_prompt` is an order-dependent fold with skipping (an
example that would overflow the budget is skipped and the walk goes on), run as a
Spark `aggregate` over the target's ranked shots with a struct accumulator; token
counts use the fallback rule max(1, chars // 4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Prompt texts of the schema, question and example styles.
# ---------------------------------------------------------------------------
_NS_HEAD = "### SQLite SQL tables, with their properties:\n#\n{schemas}\n#"
_INSTR_HEAD = ("Below is an instruction that describes a task, paired with an input that provides further context. "
               "Write a response that appropriately completes the request.\n\n")
_SQL_INFO = "/* Given the following database schema: */\n{ddl}"
_TEXT_INFO = "Given the following database schema:\n{schemas}"
# Each style: info template, table line, question line, joiner between them, answer suffix.
# Placeholders: {schemas} table lines, {ddl} CREATE TABLE texts, {fks} "a=b" pairs,
# {tables} / {columns} flat name lists, {q} the question.
SCHEMA_STYLES = {
    "SQL": {"info": _SQL_INFO, "table": None, "question": "/* Answer the following: {q} */", "join": "\n\n",
            "suffix": "\nSELECT "},
    "SQLWRULE": {"info": _SQL_INFO, "table": None, "question": "/* Answer the following with no explanation: {q} */",
                 "join": "\n\n", "suffix": "\nSELECT "},
    "SQLCOT": {"info": _SQL_INFO, "table": None,
               "question": "/* Let's think step by step. Answer the following: {q} */", "join": "\n\n", "suffix": ""},
    "TEXT": {"info": _TEXT_INFO, "table": "{t}: {cols}", "question": "Answer the following: {q}", "join": "\n",
             "suffix": "\nSELECT "},
    "TEXTWFK": {"info": "Given the following database schema:\n{schemas} \nAnd their foreign keys:\n{fks}",
                "table": "{t}: {cols}", "question": "Answer the following: {q}", "join": "\n", "suffix": "\nSELECT "},
    "TEXTWRULE": {"info": _TEXT_INFO, "table": "{t}: {cols}", "question": "Answer the following with no explanation: {q}",
                  "join": "\n", "suffix": "\nSELECT "},
    "TEXTCOT": {"info": _TEXT_INFO, "table": "{t}: {cols}",
                "question": "Let's think step by step. Answer the following: {q}", "join": "\n", "suffix": ""},
    "NUMBERSIGN": {"info": "### Complete sqlite SQL query only and with no explanation\n" + _NS_HEAD,
                   "table": "# {t}({cols})", "question": "### {q}", "join": "\n", "suffix": "\nSELECT "},
    "NUMBERSIGNWFK": {"info": "### Complete sqlite SQL query only and with no explanation\n" + _NS_HEAD
                              + "\n### Their foreign keys:\n#\n# Foreign_keys=({fks})\n#",
                      "table": "# {t}({cols})", "question": "### {q}", "join": "\n", "suffix": "\nSELECT "},
    "NUMBERSIGNWORULE": {"info": "### Complete sqlite SQL query\n" + _NS_HEAD, "table": "# {t}({cols})",
                         "question": "### {q}", "join": "\n", "suffix": "\nSELECT "},
    "NUMBERSIGNCOT": {"info": "### Let's think step by step. Complete sqlite SQL query only and with no explanation\n"
                              + _NS_HEAD, "table": "# {t}({cols})", "question": "### {q}", "join": "\n", "suffix": ""},
    "BASELINE": {"info": "{schemas}\nForeign_keys=[{fks}]\n", "table": "Table {t}, columns = [{cols}]",
                 "question": 'Q: "{q}"', "join": "", "suffix": "\nA: SELECT "},
    "BASELINEWOFK": {"info": "{schemas}\n", "table": "Table {t}, columns = [{cols}]", "question": 'Q: "{q}"',
                     "join": "", "suffix": "\nA: SELECT "},
    "INSTRUCTION": {"info": _INSTR_HEAD + "### Instruction:\nWrite a sql to answer the question \"{q}\"\n\n"
                                          "### Input:\n{schemas}\n",
                    "table": "{t}({cols})", "question": "### Response:", "join": "\n", "suffix": "\nSELECT "},
    "INSTRUCTIONWFK": {"info": _INSTR_HEAD + "### Instruction:\nWrite a sql to answer the question \"{q}\"\n\n"
                                             "### Input:\n{schemas}\nForeign Keys:{fks}\n",
                       "table": "{t}({cols})", "question": "### Response:", "join": "\n", "suffix": "\nSELECT "},
    "INSTRUCTIONWRULE": {"info": _INSTR_HEAD + "### Instruction:\nWrite a sql only and with no explanation to answer "
                                               "the question \"{q}\"\n\n### Input:\n{schemas}\n",
                         "table": "{t}({cols})", "question": "### Response:", "join": "\n", "suffix": "\nSELECT "},
    "INSTRUCTIONCOT": {"info": _INSTR_HEAD + "### Instruction:\nLet's think step by step. Write a sql to answer the "
                                             "question \"{q}\"\n\n### Input:\n{schemas}\n",
                       "table": "{t}({cols})", "question": "### Response:", "join": "\n", "suffix": ""},
    "CBR": {"info": "# The following are the table names and column names needed to generate SQL:\n"
                    "Tables: {tables}\nColumns: *, {columns}\nForeign keys: {fks}",
            "table": None, "question": '# translate "{q}" into SQL query only and with no explanation:',
            "join": "\n", "suffix": "\nSELECT "},
}
EXAMPLE_STYLES = {
    "ONLYSQL": {"prefix": "/* Some SQL examples are provided based on similar problems: */\n", "qa": None},
    "QA": {"prefix": "/* Some SQL examples are provided based on similar problems: */\n",
           "qa": "/* Answer the following: {q} */\n{s}"},
    "QAWRULE": {"prefix": "/* Some SQL examples are provided based on similar problems: */\n",
                "qa": "/* Answer the following with no explanation: {q} */\n{s}"},
    "COMPLETE": {"prefix": "", "qa": "{t}\n{s}"},  # {t}: the example's question as a target shows it
    "NUMBERSIGNQA": {"prefix": "### Some example pairs of question and corresponding SQL query are provided based on similar problems:\n\n",
                     "qa": "### {q}\n{s}"},
    "BASELINEQA": {"prefix": "", "qa": "Example Q: {q}\nExample A: {s}"},
}
SEP_EXAMPLE = "\n\n"
MAX_SEQ_LEN = 4096
MAX_ANS_LEN = 512


def tokens_of_length(n_chars):
    """Fallback token rule on a character count: 0 for empty, else max(1, n // 4)."""
    return F.when(n_chars <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n_chars / 4))).cast("int")


def schema_parts(tables: DataFrame, ddl: DataFrame, fks: DataFrame) -> DataFrame:
    """Per database, the pieces every style is made of.
    tables(db_id, table_id, table_name, cols ARRAY<STRING>); ddl(db_id, table_id, ddl);
    fks(db_id, fk_no, a, b). Returns (db_id, tl ARRAY<STRUCT<t, cols>>, ddl, fks, tables, columns)."""
    t = tables.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("table_id", F.col("table_name").alias("t"),
                                                                         "cols"))).alias("tl"))
    d = ddl.groupBy("db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_id", "ddl"))),
                                                          lambda x: x["ddl"]), "\n\n").alias("ddl"))
    f = fks.groupBy("db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fk_no", "a", "b"))),
                                                          lambda x: F.concat(x["a"], F.lit("="), x["b"])), ", ").alias("fks"))
    out = t.join(d, "db_id", "left").join(f, "db_id", "left")
    return out.select(
        "db_id", "tl", F.coalesce("ddl", F.lit("")).alias("ddl"), F.coalesce("fks", F.lit("")).alias("fks"),
        F.array_join(F.transform("tl", lambda x: x["t"]), ", ").alias("tables"),
        F.array_join(F.flatten(F.transform("tl", lambda x: F.transform(
            x["cols"], lambda c: F.concat(x["t"], F.lit("."), c)))), ", ").alias("columns"))


def render_schema(parts: DataFrame, style: str) -> DataFrame:
    """(db_id, schema_text): the style's info block with every placeholder but the
    question filled (instruction styles embed the question, filled per target)."""
    s = SCHEMA_STYLES[style]
    if s["table"] is not None:
        fmt = s["table"].replace("{t}", "%1$s").replace("{cols}", "%2$s")
        lines = F.array_join(F.transform("tl", lambda x: F.format_string(fmt, x["t"], F.array_join(x["cols"], ", "))),
                             "\n")
    else:
        lines = F.lit("")
    text = F.lit(s["info"])
    for key, val in (("{schemas}", lines), ("{ddl}", F.col("ddl")), ("{fks}", F.col("fks")),
                     ("{tables}", F.col("tables")), ("{columns}", F.col("columns"))):
        text = F.replace(text, F.lit(key), val)
    return parts.select("db_id", text.alias("schema_text"))


def render_target(questions: DataFrame, schemas: DataFrame, style: str) -> DataFrame:
    """questions(target_id, db_id, question) -> (target_id, db_id, question_text, target_text):
    info, question line (joined per style), then the style's answer prefix."""
    s = SCHEMA_STYLES[style]
    info = F.replace(F.col("schema_text"), F.lit("{q}"), F.col("question"))
    qline = F.replace(F.lit(s["question"]), F.lit("{q}"), F.col("question"))
    body = F.concat(info, F.lit(s["join"]), qline)
    return questions.join(schemas, "db_id").select("target_id", "db_id", body.alias("question_text"),
                                                   F.concat(body, F.lit(s["suffix"])).alias("target_text"))


def render_example(shots: DataFrame, style: str) -> DataFrame:
    """shots(..., question, query) -> + example_text. COMPLETE needs `question_text`, the example's question in its
    database's schema text as `render_target` gives it."""
    s = EXAMPLE_STYLES[style]
    if s["qa"] is None:
        text = F.col("query")
    else:
        fmt = s["qa"].replace("{q}", "%1$s").replace("{s}", "%2$s").replace("{t}", "%3$s")
        shown = F.col("question_text") if "{t}" in s["qa"] else F.lit("")
        text = F.format_string(fmt, F.col("question"), F.col("query"), shown)
    return shots.withColumn("example_text", text)


def pack_prompt(targets: DataFrame, shots: DataFrame, k: int, style: str = "QA", max_seq_len: int = MAX_SEQ_LEN,
                max_ans_len: int = MAX_ANS_LEN) -> DataFrame:
    """targets(target_id, target_text); shots(target_id, rk, cand_id, example_text).
    Walk shots in rank order; keep one if tokens(prefix + kept + it + target) +
    max_ans_len <= max_seq_len, otherwise skip it and go on; stop at k kept.
    Returns (target_id, prompt, prompt_tokens, n_examples, kept ARRAY<cand_id>)."""
    prefix = EXAMPLE_STYLES[style]["prefix"]
    sep = len(SEP_EXAMPLE)
    per = shots.groupBy("target_id").agg(F.array_sort(F.collect_list(
        F.struct("rk", "cand_id", F.length("example_text").alias("len"), "example_text"))).alias("sh"))
    j = targets.join(per, "target_id", "left").withColumn("tlen", F.length("target_text"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"),
                    F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<string>").alias("texts"))

    def step(acc, sh):
        # characters of prefix + (kept..., candidate, target) joined by the separator
        chars = F.lit(len(prefix)) + acc["chars"] + sh["len"] + F.col("tlen") + F.lit(sep) * (acc["n"] + 1)
        fits = (acc["n"] < k) & (tokens_of_length(chars) + max_ans_len <= max_seq_len)
        return F.when(fits, F.struct((acc["n"] + 1).alias("n"), (acc["chars"] + sh["len"]).alias("chars"),
                                     F.concat(acc["ids"], F.array(sh["cand_id"])).alias("ids"),
                                     F.concat(acc["texts"], F.array(sh["example_text"])).alias("texts"))
                      ).otherwise(acc)

    folded = j.withColumn("acc", F.aggregate(F.coalesce("sh", F.array().cast(j.schema["sh"].dataType)), zero, step))
    n = F.col("acc.n")
    prompt = F.when(n > 0, F.concat(F.lit(prefix), F.array_join(F.concat("acc.texts", F.array("target_text")),
                                                                SEP_EXAMPLE))).otherwise(F.col("target_text"))
    return folded.select("target_id", prompt.alias("prompt"), tokens_of_length(F.length(prompt)).alias("prompt_tokens"),
                         n.alias("n_examples"), F.col("acc.ids").alias("kept"))


def example_quality(pairs: DataFrame) -> DataFrame:
    """pairs(target_id, jaccard) of kept shots -> per-target mean `quality` and the
    micro mean over all pairs `overall` (1.0 when nothing was recorded)."""
    per = pairs.groupBy("target_id").agg(F.avg("jaccard").alias("quality"))
    overall = pairs.agg(F.avg("jaccard")).first()[0]
    return per.withColumn("overall", F.lit(1.0 if overall is None else float(overall)))


def prompt_stats(prompts: DataFrame, price_per_1k: float) -> DataFrame:
    """Totals over prompts: targets, tokens, shots kept, cost."""
    return prompts.agg(F.count(F.lit(1)).alias("n_prompts"), F.sum("prompt_tokens").alias("total_tokens"),
                       F.sum("n_examples").alias("total_examples"),
                       F.round(F.sum("prompt_tokens") * F.lit(price_per_1k) / 1000, 6).alias("cost"))


# Agent prompt section texts.
AGENT_SCHEMA_HEAD = "/* Given the following database schema: */\n"
AGENT_FK_HEAD = "/* Foreign Keys: */\n/* "
AGENT_SHOTS_HEAD = "/* Some SQL examples are provided based on similar problems: */\n\n"
AGENT_CLOSE = "/* Answer the following with ONLY valid SQLite SQL and no explanation: {q} */\nSELECT "


def agent_prompt(targets: DataFrame, ddl: DataFrame, fks: DataFrame, relevant: DataFrame, shots: DataFrame) -> DataFrame:
    """One prompt per target: DDL of its relevant tables, the database's foreign keys
    as a comment, the shots as question / SQL pairs, then the closing instruction.
    targets(target_id, db_id, question); ddl(db_id, table_name, table_id, ddl);
    fks(db_id, fk_no, fk); relevant(target_id, table_name); shots(target_id, rk, question, query)."""
    d = relevant.join(targets.select("target_id", "db_id"), "target_id").join(ddl, ["db_id", "table_name"]) \
        .groupBy("target_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_id", "ddl"))),
                                                           lambda s: s["ddl"]), "\n\n").alias("ddls"))
    f = fks.groupBy("db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fk_no", "fk"))),
                                                          lambda s: s["fk"]), ", ").alias("fk_text"))
    s = shots.groupBy("target_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rk", F.format_string("/* Answer the following: %s */\n%s\n\n", "question", "query").alias("t")))),
        lambda x: x["t"]), "").alias("shot_text"))
    j = targets.join(d, "target_id", "left").join(f, "db_id", "left").join(s, "target_id", "left")
    close = F.format_string(AGENT_CLOSE.replace("{q}", "%s"), F.col("question"))
    prompt = F.concat(
        F.lit(AGENT_SCHEMA_HEAD), F.coalesce("ddls", F.lit("")), F.lit("\n\n"),
        F.when(F.col("fk_text").isNotNull() & (F.col("fk_text") != ""),
               F.concat(F.lit(AGENT_FK_HEAD), F.col("fk_text"), F.lit(" */\n\n"))).otherwise(F.lit("")),
        F.when(F.col("shot_text").isNotNull(), F.concat(F.lit(AGENT_SHOTS_HEAD), F.col("shot_text"))).otherwise(F.lit("")),
        close)
    return j.select("target_id", prompt.alias("prompt"))


def pattern_similarity(pairs: DataFrame) -> DataFrame:
    """pairs(target_id, t_pattern, c_pattern) of kept shots (missing pattern = "") ->
    per-target mean Jaccard `similarity` and the micro mean `overall`."""
    from shotweave.functions.sqltext import with_skeleton_jaccard

    p = pairs.select("target_id", F.coalesce("t_pattern", F.lit("")).alias("a"), F.coalesce("c_pattern", F.lit("")).alias("b"))
    j = with_skeleton_jaccard(p, "a", "b")
    per = j.groupBy("target_id").agg(F.avg("jaccard").alias("similarity"))
    overall = j.agg(F.avg("jaccard")).first()[0]
    return per.withColumn("overall", F.lit(1.0 if overall is None else float(overall)))
