"""Arrow string columns as byte arrays: slices of bounded size, word spans and word hashes.

The helpers work on one Arrow batch inside a task. A word is a maximal run of bytes outside
space and 0x09-0x0D, which for UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U64 = np.uint64
_MASK = (1 << 64) - 1

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of uint64 (a bijection)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` well-mixed constants, the same on every machine."""
    start = (salt * 0x9E3779B97F4A7C15) & _MASK
    return mix64(np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(start))


_BYTE_CODE = seeds(256, 11)
_BASE = _U64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=_U64)
    out[0] = 1
    return np.cumprod(out, dtype=_U64)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batch with at most ``max_bytes`` of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, n = 0, batch.num_rows
    while at < n:
        floor = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, floor + max_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    col = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of several texts in order: byte spans, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1
    in_word: np.ndarray  # mask over the bytes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~_IS_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]  # a text's first byte can't go on with a word of the one before
    opens[edge] = inside[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    closes[edge] = inside[edge]
    starts = np.flatnonzero(opens)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets), inside)


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """One 64-bit hash per word, from its bytes alone."""
    if not len(words.starts):
        return np.zeros(0, dtype=_U64)
    lens = words.ends - words.starts
    cut = np.cumsum(lens) - lens
    body = _BYTE_CODE[data[words.in_word]]
    body *= _powers(int(lens.max()))[np.arange(len(body)) - np.repeat(cut, lens)]
    return mix64(np.add.reduceat(body, cut) + lens.astype(_U64))


def hash_ngrams(word_hash: np.ndarray, words: Words, n: int, *, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of every text, and the index of each one's text.

    With ``short``, a text of 1 to n-1 words gives its whole sequence as one window.
    """
    counts = words.counts
    text = np.repeat(np.arange(len(counts)), counts)
    total = len(word_hash)
    at = np.arange(total)
    left = words.first[1:][text] - at  # words from here to the text's end
    ok = left >= n
    h = word_hash.copy()
    for k in range(1, n):
        nxt = np.zeros(total, dtype=_U64)
        nxt[:total - k] = word_hash[k:]
        h = h * _BASE + nxt
    out, owner = mix64(h[ok]), text[ok]
    if short and n > 1:
        for size in range(1, n):
            of = np.flatnonzero(counts == size)
            if len(of):
                first = words.first[of]
                h = word_hash[first]
                for k in range(1, size):
                    h = h * _BASE + word_hash[first + k]
                out = np.concatenate([out, mix64(h + _U64(size))])
                owner = np.concatenate([owner, of])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner
