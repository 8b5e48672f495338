"""Quality rules: base rules on a text's words, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word 1- and 2-grams are learned: one from trusted documents, one
from the whole corpus. A document's score is the mean, over its n-grams, of
log(p_trusted / p_corpus); it is kept if the base rules hold and the score reaches a threshold
that all labelled documents that weren't learned from set. Both passes read the documents in place without moving texts: counts are summed per
task over a fixed number of buckets and only then shuffled, so what reaches the driver is one
number per bucket and side, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.shared import written
from shotweave.llm.textbatch import find_words, hash_ngrams, hash_words, mix64, slices, text_bytes

#: Buckets of the hashed n-grams: two counts of 8 bytes each reach the driver, one float of 4 bytes is broadcast.
BUCKET_BITS = 16
#: Documents of quality 1 that are learned from, at most (those with the smallest hash of their id).
MAX_TRUSTED = 50_000
#: Width of the bins in which labelled scores are counted.
BIN = 0.005
#: Added to every bucket's count, as a share of the mean count.
SMOOTHING = 0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _features(data: np.ndarray, words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every 1- and 2-gram."""
    two, of_two = hash_ngrams(hashes, words, 2, short=False)
    shift = np.uint64(64 - BUCKET_BITS)
    of_one = np.repeat(np.arange(len(words.counts)), words.counts)
    return np.concatenate([hashes, two]) >> shift, np.concatenate([of_one, of_two])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            words = find_words(data, offsets)
            bucket, of = _features(data, words, hash_words(data, words))
            trusted = part.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            total[0] += np.bincount(bucket.astype(np.int64), minlength=total.shape[1])
            total[1] += np.bincount(bucket[trusted[of]].astype(np.int64), minlength=total.shape[1])
    used = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[0][used]), pa.array(total[1][used])],
                                     names=["bucket", "in_corpus", "in_trusted"])


def _base_columns(data: np.ndarray, offsets: np.ndarray, words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    counts = words.counts

    def per_text(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return run[offsets[1:]] - run[offsets[:-1]]

    windows, of = hash_ngrams(hashes, words, 3, short=False)
    first = words.first[:-1]
    before = np.concatenate([[0], np.cumsum(np.maximum(counts - 2, 0))])[:-1]
    at = np.arange(len(windows)) - before[of] + first[of]  # index of the window's first word
    order = np.lexsort((windows, of))
    w, o = windows[order], of[order]
    same = np.zeros(len(w) + 1, dtype=bool)
    same[1:-1] = (w[1:] == w[:-1]) & (o[1:] == o[:-1])
    repeated = at[order][same[:-1] | same[1:]]
    covered = np.zeros(len(hashes) + 2, dtype=bool)
    for k in range(3):
        covered[repeated + k] = True
    run = np.concatenate([[0], np.cumsum(covered[:len(hashes)], dtype=np.int64)])

    dup_lines = np.zeros(len(counts), dtype=np.int64)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        lines = raw[a:b].split(b"\n")
        if len(lines) > 1 and len(distinct := set(lines)) < len(lines):
            blank = sum(1 for x in lines if not x.split(None, 1))
            blank_kinds = sum(1 for x in distinct if not x.split(None, 1))
            dup_lines[i] = (len(lines) - blank) - (len(distinct) - blank_kinds)
    return {"n_words": counts, "word_chars": per_text(words.in_word & ((data & 0xC0) != 0x80)), "n_symbols": per_text(_SYMBOL[data]),
            "n_dup_lines": dup_lines, "n_repeat_words": run[words.first[1:]] - run[words.first[:-1]]}


def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            words = find_words(data, offsets)
            hashes = hash_words(data, words)
            out = _base_columns(data, offsets, words, hashes)
            bucket, of = _features(data, words, hashes)
            n = np.bincount(of, minlength=part.num_rows)
            score = np.bincount(of, weights=shared.value[bucket], minlength=part.num_rows) / np.maximum(n, 1)
            failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
            out |= {"base_failed": failed, "score": score}
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, out.values())], names=["doc_id", *out])


def _labelled(labels: DataFrame) -> DataFrame:
    """(label_id, quality, learn): one row per labelled document (its least quality); half of them, by hash, may teach."""
    return (labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality"))
            .withColumn("learn", F.pmod(F.xxhash64("label_id"), F.lit(2)) == 0))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")


def log_ratios(docs: DataFrame, labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """log(p_trusted / p_corpus) of each bucket. Trusted: half (by hash of the id) of the documents that ``labels``
    (doc_id, quality) gives quality 1, the other half calibrates the threshold.

    At most ``max_trusted`` of them are used; the corpus side counts every document. Without trusted
    documents all ratios are 0.
    """
    ids = _labelled(labels).filter("quality = 1 and learn").orderBy(F.xxhash64("label_id"), "label_id").limit(max_trusted).select("label_id")
    flagged = (_texts(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"), "left")  # max_trusted ids of 8 bytes
               .select("text", F.col("label_id").isNotNull().alias("trusted")))
    rows = (flagged.mapInArrow(_count_batches, "bucket int, in_corpus long, in_trusted long")
            .groupBy("bucket").agg(F.sum("in_corpus").alias("in_corpus"), F.sum("in_trusted").alias("in_trusted")).toArrow())
    count = np.zeros((2, 1 << BUCKET_BITS))
    at = rows.column("bucket").to_numpy()
    count[0][at], count[1][at] = rows.column("in_corpus").to_numpy(), rows.column("in_trusted").to_numpy()
    if not count[1].sum():
        return np.zeros(count.shape[1], dtype=np.float32)
    p = [(c + SMOOTHING * c.mean()) / (c.sum() * (1 + SMOOTHING)) for c in count]
    return (np.log(p[1]) - np.log(p[0])).astype(np.float32)


def calibrated_threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The score that best parts labelled documents of quality 0 from those of quality 1 that don't teach: the middle of
    the scores with the greatest sum of kept good and dropped bad shares. ``scored`` has doc_id, base_failed and score.

    With good ones alone all of them are kept, with bad ones alone all of those go, without either nothing goes. Scores of
    all labelled documents are joined by id and counted in bins of ``BIN``: a bounded table.
    """
    kinds = _labelled(labels).filter("quality = 0 or (quality = 1 and not learn)")
    held = scored.filter("not base_failed").join(kinds, F.col("doc_id") == F.col("label_id"))
    rows = held.groupBy("quality", F.floor(F.col("score") / BIN).alias("bin")).count().collect()
    good, bad = ({r["bin"]: r["count"] for r in rows if r["quality"] == k} for k in (1, 0))
    if not good or not bad:
        return min(good) * BIN if good else (max(bad) + 1) * BIN if bad else -np.inf
    edges = np.arange(min([*good, *bad]), max([*good, *bad]) + 2)
    below = lambda of: np.array([sum(n for b, n in of.items() if b < e) for e in edges]) / sum(of.values())
    gain = below(bad) - below(good)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    run = best[:int(np.argmax(np.diff(np.append(best, best[-1] + 2)) > 1)) + 1]  # the first stretch of equally good edges
    return float((edges[run[0]] + edges[run[-1]]) / 2 * BIN)


_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the base counts, base_failed, kept and score.

    * n_words, word_chars (code points in words), n_symbols (``#*$%&|<>``), n_dup_lines (lines with a word equal to
      an earlier line), n_repeat_words (words inside 3-word windows that occur twice or more in the text).
    * base_failed: fewer than 50 words, or over half of the words repeated. kept: not base_failed and score >= threshold.
    * A null or empty text has no words: all counts 0, base_failed, not kept. A null doc_id is passed on and is never
      trusted; repeated rows give repeated rows; other columns are not read; empty tables give an empty result
      (without trusted labels every score is 0). Null labels count as none.
    * Without a given threshold, labelled documents that were not learned from set it (``calibrated_threshold``).
    * Learning the two multinomials, scoring and the threshold run as jobs of their own when this is called; the scored
      rows, without texts, are written once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, max_trusted))
    scored = written(_texts(docs).mapInArrow(partial(_score_batches, shared=shared), _SCHEMA), "scored")
    if threshold is None:
        threshold = calibrated_threshold(scored, labels)
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(float(threshold)))
    return scored.select(*[c for c in scored.columns if c != "score"], kept.alias("kept"), "score")
