"""Benchmark decontamination: SimHash of item-sized windows, searched in multi-index Hamming blocks.

A text is its words (lower-cased runs of letters and digits) and their 5-word shingles. For a
benchmark item of n words, every n-word window of a document that holds at least one of the
item's shingles is considered; a window that holds none has similarity 0. Each window and each
item has a 64-bit SimHash of its shingles, every occurrence counting once. The fingerprint is
cut into 8 blocks of 8 bits. The index has, for each item and block, all values within 2 bits
of the item's, so by the pigeonhole principle an equality join on (size, block, value) meets
every window within Hamming distance 23. Those pairs are verified by the exact weighted Jaccard
similarity of their shingle multisets. At similarity 0.8 about 7 of 64 bits differ (standard
deviation 2.5), so the radius is more than six standard deviations away.

DataFrame functions only. Documents are scanned in place against the items' shingles; only
documents with a hit go on. Tables derived from the benchmark are broadcast up to
``BROADCAST_ROWS`` rows, which are counted first, and joined by shuffle beyond.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave.llm.shared import free_name

SHINGLE = 5
MIN_SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
#: Greatest Hamming distance that the blocks guarantee to find.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Rows of at most 40 bytes in a broadcast table.
BROADCAST_ROWS = 200_000


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column computed once: projections aren't merged across explode."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _shifted(values: Column, by: int) -> tuple[Column, Column]:
    n = F.greatest(F.size(values) - by, F.lit(0))
    return F.slice(values, 1, n), F.slice(values, 1 + by, n)


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_shingles(df: DataFrame) -> DataFrame:
    """Adds n_words and ``grams``, the hashes of the 5-word shingles in order (a shorter text's words as one)."""
    pair = lambda a, b: F.xxhash64(a, b)
    df = bound(df, "w1", _word_hashes(F.col("text"))).drop("text")
    df = bound(df, "w2", F.zip_with(*_shifted(F.col("w1"), 1), pair))
    df = bound(df, "w4", F.zip_with(*_shifted(F.col("w2"), 2), pair))
    n = F.size("w1")
    last = F.greatest(n - (SHINGLE - 1), F.lit(0))
    grams = F.zip_with(F.slice("w4", 1, last), F.slice("w1", SHINGLE, last), pair)
    short = F.array(F.xxhash64(F.col("w1")))
    df = bound(df, "grams", F.when(n >= SHINGLE, grams).when(n > 0, short).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn("n_words", n).drop("w1", "w2", "w4")


def simhash(grams: Column) -> Column:
    """Bit b is set if more than half of the hashes have it set."""
    ones = lambda b: F.aggregate(grams, F.lit(0), lambda s, h: s + F.expr("cast(1 as int)") * (F.call_function("shiftright", h, b).bitwiseAND(F.lit(1))).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
                       lambda acc, b: acc.bitwiseOR(F.when(2 * ones(b) > F.size(grams), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of least over sum of greatest counts of the two arrays' values."""
    count = lambda values, v: F.size(F.filter(values, lambda u: u == v))
    common = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(plain, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda s, v: s + F.least(count(a, v), count(b, v))))
    return shared / (F.size(a) + F.size(b) - shared)


def _near(block: Column) -> Column:
    """All block values within ``BLOCK_RADIUS`` bits."""
    masks = [sum(1 << i for i in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)]
    return F.transform(F.array(*map(F.lit, masks)), lambda m: block.bitwiseXOR(m))


def _blocks(fingerprint: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(fingerprint, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int") for i in range(BLOCKS)])


def contaminated(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(doc_id, item_id, n_windows, similarity): pairs of a document and an item that one of its windows reaches.

    similarity is the best window's, rounded to 6 places; n_windows counts the windows that reach ``min_similarity``.

    * An item of fewer than 5 words is one shingle of all its words: windows of as many words either are the same or
      have similarity 0, so they are met by that shingle alone. A document shorter than an item is one window.
    * Null and empty texts, and rows with null ids, match nothing. Repeated rows of an id are judged as one (a window
      counts once). Other columns are not read; empty tables give an empty result.
    """
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
             .dropna().distinct())
    items = with_shingles(items).filter("n_words > 0").withColumnRenamed("n_words", "item_words")
    size = items.agg(F.sum(F.size("grams")).alias("grams"), F.count("*").alias("n")).first()
    small = (size["grams"] or 0) <= BROADCAST_ROWS and size["n"] * BLOCKS * len(list(_masks())) <= BROADCAST_ROWS
    sent = F.broadcast if small else (lambda df: df)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    few = [r["item_words"] for r in items.filter(F.col("item_words") < SHINGLE).select("item_words").distinct().collect()]  # 1 to 4
    short, items = items.filter(F.col("item_words") < SHINGLE), items.filter(F.col("item_words") >= SHINGLE)
    sizes_of = items.select("item_words", F.explode("grams").alias("gram")).distinct()
    hits = (with_shingles(texts).select("doc_id", F.posexplode("grams").alias("at", "gram"))
            .join(sent(sizes_of), "gram").groupBy("doc_id").agg(F.collect_set(F.struct("item_words", "at")).alias("hits")))
    hit_docs = bound(with_shingles(texts.join(hits, "doc_id")), "windows", _windows())
    window = (hit_docs.select("doc_id", "grams", F.explode("windows").alias("w"))
              .select("doc_id", F.col("w.item_words").alias("item_words"), F.col("w.start").alias("start"),
                      F.slice("grams", F.col("w.start") + 1, F.greatest(F.col("w.item_words") - (SHINGLE - 1), F.lit(1))).alias("own")))
    window = bound(window, "print", simhash(F.col("own")))

    prints = bound(items, "item_print", simhash(F.col("grams"))).select("item_id", "item_words", "item_print", F.posexplode(_blocks(F.col("item_print"))).alias("block", "exact"))
    index = prints.select("item_id", "item_words", "item_print", "block", F.explode(_near(F.col("exact"))).alias("value"))
    met = (window.select("*", F.posexplode(_blocks(F.col("print"))).alias("block", "value"))
           .join(sent(index), ["item_words", "block", "value"])
           .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS))
    # A pair met in several blocks counts in the first of them alone.
    first = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), _meets_in))
    met = met.filter(F.col("block") == first)
    verified = (met.join(sent(items.select("item_id", "grams")), "item_id")
                .withColumn("similarity", weighted_jaccard(F.col("own"), F.col("grams"))).filter(F.col("similarity") >= min_similarity))
    found = (verified.groupBy("doc_id", "item_id")
            .agg(F.count_distinct("start").alias("n_windows"), F.round(F.max("similarity"), 6).alias("similarity")))
    if not few:
        return found
    n = F.explode(F.array(*[F.lit(x) for x in few])).alias("item_words")
    cut = bound(texts, "w1", _word_hashes(F.col("text"))).select("doc_id", "w1", n).filter(F.size("w1") >= F.col("item_words"))
    starts = F.sequence(F.lit(1), F.size("w1") - F.col("item_words") + 1)
    whole = (cut.select("doc_id", "item_words", F.posexplode(F.transform(starts, lambda i: F.xxhash64(F.slice("w1", i, F.col("item_words"))))).alias("start", "gram"))
             .join(sent(short.select("item_id", "item_words", F.col("grams")[0].alias("gram"))), ["item_words", "gram"]).select("doc_id", "item_id", "start").distinct())
    return found.unionByName(whole.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.lit(1.0).alias("similarity")))


def _masks():
    return (c for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r))


def _meets_in(i: Column) -> Column:
    """i if the two fingerprints differ in at most ``BLOCK_RADIUS`` bits of block i, else null."""
    differ = F.call_function("shiftrightunsigned", F.col("print").bitwiseXOR(F.col("item_print")), i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    return F.when(F.bit_count(differ) <= BLOCK_RADIUS, i)


def _windows() -> Column:
    """Distinct (item_words, start) of the windows that hold a hit: all of them, cut at the document's borders."""
    def starts(hit: Column) -> Column:
        width = F.greatest(hit["item_words"] - SHINGLE, F.lit(0))
        last = F.greatest(F.col("n_words") - hit["item_words"], F.lit(0))
        return F.transform(F.sequence(F.least(F.greatest(hit["at"] - width, F.lit(0)), last), F.least(hit["at"], last)),
                           lambda s: F.struct(hit["item_words"].alias("item_words"), s.alias("start")))
    return F.array_distinct(F.flatten(F.transform("hits", starts)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` without the documents that ``contaminated`` finds, in all its columns; null ids and texts stay."""
    name = free_name(docs, "_found")
    found = contaminated(docs, benchmark, min_similarity).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col(name), "left_anti")
