import random

import public_tokenizers
import pytest
from helpers import awkward_docs, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shotweave.llm import bpe_codec, token_count

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def counter():
    return token_count.MergeCounter(open(BYTES, "rb").read())


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.BacktrackCodec(open(WORDS, "rb").read())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_counts_like_the_library(counter, text):
    assert counter.count(text) == len(LIBRARY[BYTES].encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_encodes_and_decodes_like_the_library(codec, text):
    ids = LIBRARY[WORDS].encode(text, add_special_tokens=False).ids
    assert codec.encode(text).tolist() == ids
    assert codec.decode(codec.encode(text)).decode() == LIBRARY[WORDS].decode(ids, skip_special_tokens=False)


LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def test_backtracking_gives_the_merges_on_hard_words(codec):
    rnd = random.Random(5)
    hard = ["".join(rnd.choice("aeinthrsl") for _ in range(rnd.randint(1, 80))) for _ in range(3000)] + ["an" * 200, "th" * 150 + "in", "a" * 1000]
    for word, e in zip(hard, LIBRARY[WORDS].encode_batch(hard, add_special_tokens=False)):
        assert codec.encode(word).tolist() == e.ids


def test_memo_forgets_and_stays_right():
    memo = token_count.Memo(len, size=3, longest=5)
    assert [memo["x" * n] for n in (1, 2, 3, 4, 5, 6, 1, 2, 9)] == [1, 2, 3, 4, 5, 6, 1, 2, 9]
    assert len(memo) <= 3 and "x" * 9 not in memo


def test_counts_of_awkward_documents(docs, clashing, empty):
    rows = token_count.count_tokens(clashing, BYTES, limit=100).collect()
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
    want = []
    for d, t, *_ in awkward_docs():
        n = len(LIBRARY[BYTES].encode(t or "", add_special_tokens=False).ids)
        want.append((d is None, d, len((t or "").encode()), n, n > 100))
    assert got == sorted(want)
    assert token_count.count_tokens(empty, BYTES).count() == 0


def test_codec_of_awkward_documents(docs, clashing, empty):
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.codec_digests(clashing, WORDS).collect())
    want = []
    for d, t, *_ in awkward_docs():
        ids = LIBRARY[WORDS].encode(t or "", add_special_tokens=False).ids
        want.append((d is None, d, len(ids), sha(" ".join(map(str, ids)).encode()), sha(LIBRARY[WORDS].decode(ids, skip_special_tokens=False).encode())))
    assert got == sorted(want)
    assert bpe_codec.codec_digests(empty, WORDS).count() == 0


def test_encode_then_decode(docs):
    texts = {r.doc_id: r.text for r in bpe_codec.decode(bpe_codec.encode(docs, WORDS), WORDS).collect()}
    assert texts[6] == "one</w> two</w>" and texts[3] == texts[4] == texts[5] == ""
