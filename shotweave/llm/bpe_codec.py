"""Exact BPE encoding by backtracking over longest token matches, and decoding by an offset table.

A word is a string over an alphabet of byte letters and byte letters that end a word. An
Aho-Corasick automaton of all tokens gives, for every position, the longest token that starts
there. The encoder walks left to right, takes the longest match, and keeps it if it may stand
after the token before it: two tokens are compatible when merging their joined text leaves
their border alone. The test looks down both merge trees and is remembered in a pair table. If
it fails, the next shorter token is tried, and if there is none the last token is taken back;
a position that once failed is never tried again, so the work is linear in the word. The result
is the one that the merges give.

Decoding gathers each token's text from one byte blob by an offset table.

Rows are independent: one scan, no shuffle. The vocabulary (a file of a few MB) is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import partial
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from shotweave.llm.textbatch import slices
from shotweave.llm.token_count import COMMON, LIST_CHARS, Memo, byte_alphabet, read_vocabulary

#: Fixed value: the split pattern of the word vocabulary's pre-tokenizer.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same cut for texts made of ``COMMON`` characters alone, on which the faster ``re`` has the same classes.
COMMON_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\w\s]+"
#: Added to a letter's code where it ends a word.
_FINAL = 0x10000


def _char_class(letters: str) -> str:
    """A pattern for one of the letters (in code point order), written as ranges; it fits nothing if there are none."""
    cuts = [0, *(i for i in range(1, len(letters)) if ord(letters[i]) != ord(letters[i - 1]) + 1), len(letters)]
    return "[" + "".join(f"{letters[a]}-{letters[b - 1]}" for a, b in zip(cuts, cuts[1:])) + "]" if letters else r"(?!)"


class BacktrackCodec:
    """Encoder and decoder for one word-level BPE vocabulary (the ``.json`` file's bytes)."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need whole words are not supported")
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("a lower-casing word vocabulary without a decoder is needed")
        vocab = model["vocab"]
        self.letter = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.common_split, self.uncommon = re.compile(COMMON_SPLIT), re.compile(f"[^{COMMON}]")
        self._build_split(vocabulary)
        self._build_tables(vocab, model["merges"])
        self._build_offsets(vocab | self.special)
        self.memo = Memo(self.encode_word)

    def _build_tables(self, vocab: dict[str, int], merges: list) -> None:
        """Token texts over the two-part alphabet, merge trees, the automaton and next shorter tokens."""
        text: dict[int, str] = {}
        for c in self.letter.values():
            if c in vocab:
                text[vocab[c]] = c
            if self.suffix and c + self.suffix in vocab:
                text[vocab[c + self.suffix]] = chr(ord(c) + _FINAL)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = dict.fromkeys(text, -1)
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge[left, right] = (r, whole)
            if whole not in text:
                text[whole] = text[left] + text[right]
                self.parts[whole], self.rank[whole] = (left, right), r
        self._singles = {t: i for i, t in text.items() if len(t) == 1}
        self.automaton = ahocorasick.Automaton()
        by_text = self.by_text = {t: i for i, t in text.items() if self._merges_to_itself(t, i)}
        for t, i in by_text.items():
            self.automaton.add_word(t, (len(t) - 1, i))
        self.automaton.make_automaton()
        self.length = {i: len(t) for t, i in by_text.items()}
        self.shorter: dict[int, int] = {}
        for t, i in by_text.items():
            self.shorter[i] = next((by_text[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_text), -1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.letters = {c for t in by_text if len(t) == 1 for c in t}
        self.complete = len(self.letters) == (512 if self.suffix else 256)  # else letters without a token are dropped

    def _merges_to_itself(self, text: str, token: int) -> bool:
        """Whether the merges, applied in order to the token's letters, give the token (else it never occurs)."""
        if token not in self.parts:
            return True
        symbols = [self._singles[c] for c in text]
        while len(symbols) > 1:
            best = min((self.merge[p] + (i,) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.merge), default=None)
            if best is None:
                return False
            symbols[best[2]:best[2] + 2] = [best[1]]
        return symbols == [token]

    def _build_split(self, vocabulary: bytes) -> None:
        """The split for any text. ``regex`` may know newer letters than the vocabulary's library, which takes them
        for symbols: the library is asked about those that this Python's Unicode table has not assigned. Texts with
        such characters are normalised by the library too."""
        library = Tokenizer.from_str(vocabulary.decode("utf-8"))
        unassigned = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
        found = regex.findall(r"[\p{L}\p{N}]", unassigned)
        newer = "".join(c for c in found if len(library.pre_tokenizer.pre_tokenize_str(f"!{c}!")) == 1)
        symbols, doubtful = (_char_class(x) for x in (newer, "".join(found)))
        slow = WORD_SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{symbols})")
        for kind in (r"\p{L}", r"\p{N}"):
            slow = slow.replace(f"[{kind}]", f"(?:(?!{symbols}){kind})")
        self.split, self.split_slow, self.doubtful = regex.compile(WORD_SPLIT), regex.compile(slow), regex.compile(doubtful)
        self.library = library.normalizer

    def _build_offsets(self, vocab: dict[str, int]) -> None:
        texts = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            texts[i] = t.encode("utf-8") + b" "  # without a decoder, tokens are joined by spaces
        self.offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of the two tokens' joined text leave the border between them alone."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self._border_holds(left, right)
            if len(self.pairs) >= 1_000_000:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Walk back through the merges on both sides of the border, latest first. At any moment the two symbols
        # at the border must not merge before the next merge that would swallow one of them.
        limit = len(self.merge) + 1
        while True:
            found = self.merge.get((left, right))
            if found and found[0] < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            # With equal ranks the left one merges first, so the right one is undone first.
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]

    def _letters_of(self, word: str) -> str:
        out = word.encode("utf-8").decode("latin-1").translate(self.letter)
        if self.suffix:
            out = out[:-1] + chr(ord(out[-1]) + _FINAL)
        return out if self.complete else "".join(c for c in out if c in self.letters)

    def encode_word(self, word: str) -> tuple[int, ...]:
        text = self._letters_of(word)
        whole = self.by_text.get(text)
        if whole is not None:
            return (whole,)
        n = len(text)
        longest = [-1] * n
        for end, (back, token) in self.automaton.iter(text):
            longest[end - back] = token  # matches that start at one place come by growing end: the last is the longest
        length, shorter, pairs = self.length, self.shorter, self.pairs
        tokens: list[int] = []
        failed = bytearray(n + 1)
        at, token, last = 0, longest[0] if n else -1, -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not failed[end]:
                    if last < 0:
                        break
                    fits = pairs.get((last, token))
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            else:
                failed[at] = 1
                token = tokens.pop()
                at -= length[token]
                token = shorter[token]
                last = tokens[-1] if tokens else -1
        return tuple(tokens)

    def normalize(self, text: str) -> str:
        """NFC and lower case, letter by letter (no rule for a sigma that ends a word)."""
        if text.isascii():
            return text.lower()
        if self.uncommon.search(text) and self.doubtful.search(text):
            return self.library.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, text: str) -> Iterator[list]:
        """Token tuples of the text's words, list by list."""
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield [(self.special[part],)]
                continue
            clean = self.normalize(part)
            split = self.common_split if not self.uncommon.search(clean) else self.split_slow if self.doubtful.search(clean) else self.split
            if len(clean) <= LIST_CHARS:
                yield list(map(self.memo.__getitem__, split.findall(clean)))
            else:
                yield [self.memo[m.group()] for m in split.finditer(clean)]

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(chain.from_iterable(self.words(text))), dtype=np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' texts joined by spaces."""
        if not len(ids):
            return b""
        lens = self.offsets[ids + 1] - self.offsets[ids]
        cut = np.cumsum(lens)
        at = np.arange(cut[-1]) + np.repeat(self.offsets[ids] - (cut - lens), lens)
        return self.blob[at].tobytes()[:-1]


_loaded: dict[int, BacktrackCodec] = {}


def _codec(shared) -> BacktrackCodec:
    if shared.value[0] not in _loaded:
        _loaded.clear()
        _loaded[shared.value[0]] = BacktrackCodec(shared.value[1])
    return _loaded[shared.value[0]]


def _encode_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    codec = _codec(shared)
    for batch in batches:
        for part in slices(batch, "text"):
            ids = [codec.encode(t) if t else np.zeros(0, dtype=np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    codec = _codec(shared)
    for batch in batches:
        texts = [codec.decode(np.array(i or [], dtype=np.int64)).decode("utf-8") for i in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _digest_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    codec = _codec(shared)
    names = [str(i) for i in range(len(codec.offsets) - 1)]
    hexes = lambda b: hashlib.sha256(b).hexdigest()
    for batch in batches:
        for part in slices(batch, "text"):
            counts, of_ids, of_text = [], [], []
            for t in part.column("text").to_pylist():
                ids = codec.encode(t) if t else np.zeros(0, dtype=np.int64)
                counts.append(len(ids))
                of_ids.append(hexes(" ".join(map(names.__getitem__, ids.tolist())).encode()))
                of_text.append(hexes(codec.decode(ids)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _run(docs: DataFrame, columns: list[str], step, vocabulary_path: str, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    return docs.selectExpr(*columns).mapInArrow(partial(step, shared=shared), schema)


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and token ids (array of int) of every row's whole text; a null or empty text gives an empty array.

    A null doc_id is passed on, repeated rows give repeated rows, other columns are not read, and an empty table
    gives an empty result. Strings of added tokens inside a text become those tokens.
    """
    return _run(docs, ["cast(doc_id as bigint) as doc_id", "cast(text as string) as text"], _encode_batches, vocabulary_path, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and text of rows of ``encode``; null or empty ids give an empty text."""
    return _run(encoded, ["cast(doc_id as bigint) as doc_id", "cast(ids as array<int>) as ids"], _decode_batches, vocabulary_path, "doc_id long, text string")


def codec_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids joined by spaces and of the decoded text, encoded and decoded in one pass.

    Edge cases as in ``encode``; an empty text has 0 tokens and the digests of the empty string.
    """
    return _run(docs, ["cast(doc_id as bigint) as doc_id", "cast(text as string) as text"], _digest_batches, vocabulary_path,
                "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
