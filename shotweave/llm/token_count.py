"""Token counts: byte-pair merging with a heap of pairs over a linked list of symbols.

A piece of text starts as one symbol per byte. The lowest-ranked adjacent pair (leftmost on a
tie) is popped and merged until no pair has a rank; the piece has as many tokens as it had
symbols less the merges made. No token identifier is written.

Rows are independent: one scan, no shuffle. The vocabulary file is read on the driver and
broadcast (its size is that of the file, a few MB whatever the corpus).
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from shotweave.llm.textbatch import slices

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same cut for texts made of ``COMMON`` characters alone, on which the faster ``re`` has the same classes.
COMMON_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\w\s]+|\s+(?!\S)|\s+"
COMMON = "\\x00-\\x1b\\x20-\\x5e\\x60-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u2010-\u2027"

#: Pieces a worker remembers in each of two generations, and the longest piece that it remembers.
MEMO_PIECES = 400_000
MEMO_LENGTH = 64
#: Texts beyond so many characters are split piece by piece instead of into one list.
LIST_CHARS = 4_000_000


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """piece -> value in two generations: a full young one becomes the old one, what is used again moves over."""

    def __init__(self, compute, size: int = MEMO_PIECES, longest: int = MEMO_LENGTH):
        super().__init__()
        self.old: dict = {}
        self.compute, self.size, self.longest = compute, size, longest

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.compute(piece)
            if len(piece) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


class MergeCounter:
    """Counts tokens of texts under one byte-level BPE vocabulary (the ``.json`` file's bytes)."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] is not None:
            raise ValueError("a plain byte-level vocabulary is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need whole words are not supported")
        vocab = spec["model"]["vocab"]
        letters = byte_alphabet()
        self.symbol = [vocab[letters[b]] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(BYTE_LEVEL_SPLIT)
        self.common_split, self.uncommon = re.compile(COMMON_SPLIT), re.compile(f"[^{COMMON}]")
        self.memo = Memo(self.count_piece)

    def count_piece(self, piece: str) -> int:
        symbols = [self.symbol[b] for b in piece.encode("utf-8")]
        n = len(symbols)
        if n == 1:
            return 1
        rank, nxt, prev = self.rank, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = rank.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = nxt[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = joined, -1
            merges += 1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                found = rank.get((joined, symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, joined, symbols[k], found[1]))
            h = prev[i]
            if h >= 0:
                found = rank.get((symbols[h], joined))
                if found:
                    heapq.heappush(heap, (found[0], h, symbols[h], joined, found[1]))
        return n - merges

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.cut:
            parts = self.cut.split(text)
            total = len(parts) - 1
        split = self.split if self.uncommon.search(text) else self.common_split
        for part in parts:
            if len(part) <= LIST_CHARS:
                total += sum(map(self.memo.__getitem__, split.findall(part)))
            else:
                total += sum(self.memo[m.group()] for m in split.finditer(part))
        return total


_loaded: dict[int, MergeCounter] = {}


def _counter(shared) -> MergeCounter:
    """The worker's counter for a broadcast vocabulary; Python workers serve many tasks."""
    if shared.value[0] not in _loaded:
        _loaded.clear()
        _loaded[shared.value[0]] = MergeCounter(shared.value[1])
    return _loaded[shared.value[0]]


def _count_batches(batches: Iterator[pa.RecordBatch], shared, limit: int) -> Iterator[pa.RecordBatch]:
    counter = _counter(shared)
    for batch in batches:
        for part in slices(batch, "text"):
            text = part.column("text")
            counts = pa.array([counter.count(t) if t else 0 for t in text.to_pylist()], pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), n_bytes, counts, pc.greater(counts, limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def read_vocabulary(path: str) -> tuple[int, bytes]:
    """(stable id, content) of a vocabulary file, read on the driver."""
    import zlib

    with open(path, "rb") as f:
        content = f.read()
    return zlib.crc32(content), content


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of ``docs``.

    * Needs columns ``doc_id`` and ``text``; others are not read.
    * A null or empty text has 0 bytes and 0 tokens; a null doc_id is passed on; repeated rows give repeated rows.
    * An empty table gives an empty result.
    * Strings of the vocabulary's added tokens inside a text count as one token each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    return (docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
            .mapInArrow(partial(_count_batches, shared=shared, limit=limit),
                        "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
