"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

A document's units are its lines, its paragraphs (between blank lines) and its whole text; besides,
every stretch of the text that is as long as a template is held against it (``window_matches``), so
that a notice among other words, over comment lines or in the middle of a line is found.
Bigrams count as often as they occur. A unit of a bigrams can reach Dice coefficient t with a template of b bigrams only if
a * t / (2 - t) <= b <= a * (2 - t) / t. These bounds are a small table from the number of
bigrams to the templates within reach, so a unit meets its few candidates by an equality join
with a broadcast table whose size depends on the templates alone; most units meet none and
their bigrams are never built. Only DataFrame functions are used. Texts stay in place; of the
stretches only bigrams that a template has are gathered, per text and template.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_DICE = 0.8

#: Licence notices and permission texts as they are published.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
                "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
                "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                      "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                      "option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def template_bigrams(templates: dict[str, str]) -> dict[str, Counter]:
    """Word bigrams of each template with their counts, normalised as ``words_of`` does."""
    out = {}
    for name, text in templates.items():
        words = re.findall(r"[a-z0-9]+", text.lower())
        out[name] = Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
        if not out[name]:
            raise ValueError(f"template {name} has no bigram")
    return out


def size_bounds(n: int, min_dice: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach ``min_dice`` with a template of ``n``."""
    return math.ceil(n * min_dice / (2 - min_dice) - 1e-9), math.floor(n * (2 - min_dice) / min_dice + 1e-9)


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text (the array may start and end with an empty string)."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def unit_words(docs: DataFrame) -> DataFrame:
    """(doc_id, words) of lines, paragraphs of several lines, and the whole text where it has several paragraphs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    paragraphs = F.split(text, r"\n[ \t]*\n")
    several = F.when(F.instr(text, "\n") > 0, F.concat(F.filter(paragraphs, lambda p: F.contains(p, F.lit("\n"))),
                                                       F.when(F.size(paragraphs) > 1, F.array(text)).otherwise(none))).otherwise(none)
    # Split inside the array: explode is a border that no projection above it is merged across, so it is done once.
    return docs.select("doc_id", F.explode(F.transform(F.concat(F.split(text, "\n"), several), words_of)).alias("split"))


def matches(docs: DataFrame, templates: dict[str, str] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """(doc_id, license, shared, unit_bigrams, template_bigrams) for each unit that reaches ``min_dice`` with a template."""
    grams = template_bigrams(TEMPLATES if templates is None else templates)
    reach = []
    for name, own in grams.items():
        low, high = size_bounds(own.total(), min_dice)
        reach += [(size, name, own.total(), own.total() - len(own), [{"gram": g, "n": n} for g, n in own.items()]) for size in range(low, high + 1)]
    table = docs.sparkSession.createDataFrame(
        reach, "unit_bigrams int, license string, template_bigrams int, repeated int, grams array<struct<gram string, n int>>")
    table = table.withColumn("template_hashes", F.transform("grams", lambda g: F.xxhash64(g["gram"])))
    shortest, longest = min(r[0] for r in reach) + 1, max(r[0] for r in reach) + 1
    found = (unit_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
             .filter(F.size("split").between(shortest, longest + 2))
             .select("doc_id", F.explode(F.array(bigrams(F.filter("split", lambda w: w != "")))).alias("unit_grams"))
             .select("doc_id", "unit_grams", F.size("unit_grams").alias("unit_bigrams")))
    # Rows of the broadcast table: the templates' size ranges. Distinct bigrams in common, and the template's repeated
    # ones, bound the exact count, which only units over that bound get.
    met = found.join(F.broadcast(table), "unit_bigrams")
    need = F.lit(min_dice) * (F.col("unit_bigrams") + F.col("template_bigrams"))
    distinct = F.size(F.array_intersect(F.transform("unit_grams", lambda g: F.xxhash64(g)), F.col("template_hashes")))
    shared = F.aggregate("grams", F.lit(0), lambda n, g: n + F.least(g["n"], F.size(F.filter("unit_grams", lambda u: u == g["gram"]))))
    return (met.filter(2 * (distinct + F.col("repeated")) >= need)
            .select("doc_id", "license", shared.alias("shared"), "unit_bigrams", "template_bigrams").filter(F.col("shared") * 2 >= need))


def window_matches(docs: DataFrame, templates: dict[str, str] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """(doc_id, license, dice): every stretch of a text, as long as the template, that reaches ``min_dice`` with it, from
    wherever a bigram of the template stands. Words run on over line ends and comment marks.

    Text bigrams meet the template's by a broadcast join, and only those that meet one go on, per row and template. At
    least ceil(min_dice * b) of a template's b bigrams must stand within b places; only such stretches are counted."""
    grams = template_bigrams(TEMPLATES if templates is None else templates)
    table = docs.sparkSession.createDataFrame([(g, name, n, own.total(), math.ceil(min_dice * own.total() - 1e-9)) for name, own in grams.items() for g, n in own.items()],
                                              "gram string, license string, n int, b int, need int")
    words = F.filter(words_of(F.coalesce(F.col("text"), F.lit(""))), lambda w: w != "")
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.posexplode(bigrams(words)).alias("at", "gram"))
    hits = (rows.join(F.broadcast(table), "gram").groupBy("row", "doc_id", "license", "b", "need")
            .agg(F.sort_array(F.collect_list(F.struct("at", "gram", "n"))).alias("h")).filter(F.size("h") >= F.col("need")))
    near = F.transform("h", lambda x, i: F.when(F.get("h", i + F.col("need") - 1)["at"] < x["at"] + F.col("b"), F.slice("h", i + 1, F.col("b"))))
    spans = hits.select("doc_id", "license", "b", F.explode(F.filter(near, lambda s: s.isNotNull())).alias("s"))
    spans = spans.select("doc_id", "license", "b", F.filter("s", lambda x: x["at"] < F.get("s", F.lit(0))["at"] + F.col("b")).alias("s"))
    own = F.array_distinct(F.transform("s", lambda x: F.struct(x["gram"].alias("gram"), x["n"].alias("n"))))
    shared = F.aggregate(own, F.lit(0), lambda n, g: n + F.least(g["n"], F.size(F.filter("s", lambda x: x["gram"] == g["gram"]))))
    return spans.select("doc_id", "license", (shared / F.col("b")).alias("dice")).filter(F.col("dice") >= min_dice)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """One row per document and licence found in it: doc_id, license, n_units (lines, paragraphs and texts that match as
    a whole; 0 if the licence only stands among other words), dice (the best of units and stretches, rounded to 6 places).

    Null and empty texts, and texts without two words in a row, match nothing. Repeated rows of a doc_id are scanned
    each and add up; rows with a null doc_id are summed as one document. Other columns are not read; an empty table
    gives an empty result. ``min_dice`` must be over 0.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = matches(docs, templates, min_dice).select("doc_id", "license", F.lit(1).alias("unit"), (2 * F.col("shared") / (F.col("unit_bigrams") + F.col("template_bigrams"))).alias("dice"))
    inside = window_matches(docs, templates, min_dice).select("doc_id", "license", F.lit(0).alias("unit"), "dice")
    return whole.unionByName(inside).groupBy("doc_id", "license").agg(F.sum("unit").alias("n_units"), F.round(F.max("dice"), 6).alias("dice"))
