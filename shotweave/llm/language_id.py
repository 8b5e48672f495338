"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the 1- to 3-grams of letters per language in hashed buckets, summed inside each
task before one small shuffle. The log-probability matrix (languages x buckets) is broadcast;
its size is bounded by ``MATRIX_BYTES``, for which the number of buckets is halved as often as
needed. Scoring builds one sparse row per text (its n-gram buckets) and multiplies it with the
matrix in numpy, batch by batch. Nothing but the text and the training labels is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.textbatch import mix64, slices

BUCKET_BITS = 15
MATRIX_BYTES = 32 << 20
SMOOTHING = 0.5
UNKNOWN = "und"
#: Every FOLDS-th part of the documents (by CRC-32 of the id) is held out from training.
FOLDS = 5
_SLICE = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> code point of its lower-case letter, 0 for all that is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for run in regex.finditer(r"\p{L}+", "".join(map(chr, range(0x110000)))):
        for c in run.group():
            low = c.lower()
            table[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    return table


def _ngrams(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text index) of all 1-, 2- and 3-grams, and whether each text has a letter.

    Runs of anything but letters count as one word border each; an n-gram has a letter at its end or its start.
    """
    points = [np.frombuffer((" " + (t or "") + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(p) for p in points])
    c = _letters()[np.concatenate(points)]
    keep = c != 0
    keep[1:] |= c[:-1] != 0  # the first border after a letter
    first = np.ones(len(of), dtype=bool)
    first[1:] = of[1:] != of[:-1]
    keep |= first
    c, of = c[keep].astype(np.uint64), of[keep]
    shift = np.uint64(64 - bits)
    one = c != 0
    out, owner = [mix64(c[one]) >> shift], [of[one]]
    for n in (2, 3):
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h << np.uint64(21)) ^ c[k:len(c) - n + 1 + k]
        ok = (of[n - 1:] == of[:len(of) - n + 1]) & ((c[n - 1:] != 0) | (c[:len(c) - n + 1] != 0))
        out.append(mix64(h[ok]) >> shift)
        owner.append(of[:len(of) - n + 1][ok])
    has_letter = np.zeros(len(texts), dtype=bool)
    has_letter[of[one]] = True
    return np.concatenate(out).astype(np.int64), np.concatenate(owner), has_letter


def _count_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            bucket, of, _ = _ngrams(part.column("text").to_pylist(), bits)
            lang = np.array(part.column("lang").to_pylist(), dtype=object)
            for name in set(lang):
                found = np.bincount(bucket[(lang == name)[of]], minlength=1 << bits)
                counts[name] = counts[name] + found if name in counts else found
            if len(counts) << bits > 8 << 20:  # many languages: hand on what there is
                yield from _rows(counts)
                counts.clear()
    yield from _rows(counts)


def _rows(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, count in counts.items():
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(count[used])],
                                         names=["lang", "bucket", "n"])


class Model:
    """Languages in order of name, and their log probabilities (buckets x languages)."""

    def __init__(self, langs: list[str], counts: np.ndarray, bits: int):
        self.langs, self.bits = langs, bits
        smooth = counts + SMOOTHING
        self.logp = np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32) if langs else counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bucket, of, has_letter = _ngrams(texts, self.bits)
        total = np.stack([np.bincount(of, weights=self.logp[bucket, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1)
        best = total.argmax(axis=1)  # the first language by name on a tie
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        score = np.where(has_letter, 1 / odds.sum(axis=1), 0.0)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has_letter.tolist())], score


def train(docs: DataFrame, bits: int = BUCKET_BITS) -> Model:
    """Learns from every row of ``docs`` (text, lang) whose text and lang are not null."""
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    n = known.select("lang").distinct().count()
    while n << bits > MATRIX_BYTES // 4 and bits > 8:
        bits -= 1
    if n << bits > MATRIX_BYTES:
        raise ValueError(f"{n} languages are too many for a matrix of {MATRIX_BYTES} bytes")
    rows = (known.mapInArrow(partial(_count_batches, bits=bits), "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    names = rows.column("lang").to_pylist()
    langs = sorted(set(names))
    place = {name: k for k, name in enumerate(langs)}
    counts = np.zeros((1 << bits, len(langs)))
    counts[rows.column("bucket").to_numpy(), [place[name] for name in names]] = rows.column("n").to_numpy()
    return Model(langs, counts, bits)


def _predict_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            langs, score = shared.value.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score)],
                                             names=["doc_id", "held_out", "lang_pred", "score"])


def held_out() -> F.Column:
    """Whether CRC-32 of doc_id as text (null: the empty text) leaves no remainder when divided by ``FOLDS``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior probability, every language alike before) of every row.

    Null texts, texts without a letter, and all texts when nothing was learned give ``und`` with score 0. A null doc_id
    is passed on; repeated rows give repeated rows; only doc_id and text are read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
            .mapInArrow(partial(_predict_batches, shared=shared), "doc_id long, held_out boolean, lang_pred string, score double"))


def train_and_identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out (as a job of its own when called), then identifies all."""
    return identify(docs, train(docs.filter(~held_out())))
