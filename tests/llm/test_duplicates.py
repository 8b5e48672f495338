import math
import random
from collections import defaultdict

import pytest
from helpers import SCHEMA, awkward_docs, components, prose, removed_bytes, sha, shingles, words
from hypothesis import given, settings
from hypothesis import strategies as st

from shotweave.llm import line_dedup, minhash_forest, suffix_dedup
from shotweave.llm.components import connected_components


def edited(text, seed, n):
    rnd, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def family(spark):
    """A hot group: copies and variants of one text, chains of variants, shared lines, and texts of their own."""
    base = prose(50, 150)
    texts = [base] * 40 + [edited(base, s, 1 + s % 3) for s in range(60)] + [prose(1000 + i, 90) for i in range(40)]
    chain = prose(60, 200)
    for s in range(12):
        chain = edited(chain, 500 + s, 2)
        texts.append(chain)
    texts += [prose(2000 + i, 40) + "\n" + base[:300] + "\n" + prose(3000 + i, 30) for i in range(20)]
    random.Random(1).shuffle(texts)
    return [(i, t, "", "", len(t)) for i, t in enumerate(texts)]


def near(rows):
    sets = {d: shingles(t) for d, t, *_ in rows if d is not None}
    return components(sets, 85), sets


def test_components_of_a_hot_family(spark, family, monkeypatch):
    want, sets = near(family)
    docs = spark.createDataFrame(family, SCHEMA)
    for rows in (minhash_forest.REGION_ROWS, 8):  # 8: regions are cut deeper and dealt out
        monkeypatch.setattr(minhash_forest, "REGION_ROWS", rows)
        monkeypatch.setattr(minhash_forest, "REGION_SHINGLES", 250 * rows)
        got = minhash_forest.near_duplicates(docs).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_pairs_far_from_the_first_of_a_large_region(spark, monkeypatch):
    """A text, its near copy, and before them 12 texts that each differ from it in another tenth: below the limit, but in all its regions."""
    rows = []
    for f in range(10):
        w = prose(7000 + f, 360).split()
        for k in range(12):
            rows.append((100 * f + k, " ".join([*w[:30 * k], *prose(8000 + 12 * f + k, 30).split(), *w[30 * k + 30:]])))
        rows += [(100 * f + 50, " ".join(w)), (100 * f + 51, edited(" ".join(w), 900 + f, 3))]
    rows = [(d, t, "", "", len(t)) for d, t in rows]
    want, _ = near(rows)
    assert want == {d: d - (d % 100 == 51) for d, *_ in rows}
    monkeypatch.setattr(minhash_forest, "REGION_ROWS", 2)
    monkeypatch.setattr(minhash_forest, "REGION_SHINGLES", 1000)
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_components_of_awkward_documents(spark, clashing, empty):
    rows = minhash_forest.near_duplicates(clashing).collect()
    want, sets = near(awkward_docs())
    assert len(rows) == len(awkward_docs())
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept is None
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(sets[r.doc_id]))
    assert minhash_forest.near_duplicates(empty).count() == 0


def test_connected_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in range(200, 250)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_removals(rows, percent=80):
    lines = [(d, i, frozenset(words(line))) for d, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]) for i, line in enumerate((t or "").split("\n"))]
    first = {}
    for d, i, s in lines:
        if s:
            first.setdefault(s, (d, i))
    order = sorted(first, key=first.get)
    late = {s for k, s in enumerate(order) for e in order[:k] if 100 * len(s & e) >= percent * len(s | e)}
    out = defaultdict(set)
    for d, i, s in lines:
        if s and (first[s] != (d, i) or s in late):
            out[d].add(i)
    return out


@pytest.mark.parametrize("hot", [line_dedup.HOT_ROWS, 2])
def test_lines_match_brute_force(spark, family, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    rows = family + [(1000 + i, "\n".join(edited(prose(77, 14), 40 * i + k, 1) for k in range(4)) + "\n\n" + "one two", "", "", 0) for i in range(15)]
    want = line_removals(rows)
    assert sum(map(len, want.values())) > 100
    got = line_dedup.line_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: set(r.removed) for r in got} == {d: want.get(d, set()) for d, *_ in rows}
    assert all(r.n_removed == len(r.removed) for r in got)


def test_lines_of_awkward_documents(spark, clashing, docs, empty):
    rows = line_dedup.line_report(clashing).collect()
    want = line_removals(awkward_docs())
    assert len(rows) == len(awkward_docs())
    for r in rows:
        assert set(r.removed) == (want.get(r.doc_id, set()) if r.doc_id is not None else set())
    assert line_dedup.line_report(empty).count() == 0
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    by_id = {r.doc_id: r for r in kept.collect()}
    assert by_id[2].text == "" and by_id[2].n_chars == 0 and by_id[3].text is None and by_id[0].text == awkward_docs()[0][1]
    assert by_id[16].text == prose(7, 30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_is_sorted(values):
    text = [*values, 0]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_lyndon_groups_are_longest_lyndon_prefixes():
    text = [2, 1, 3, 1, 3, 1, 2, 2, 1, 3, 0]

    def prefix(i):
        return max((text[i:j] for j in range(i + 1, len(text) + 1) if all(text[i:j] < text[k:j] for k in range(i + 1, j))), key=len)

    group, _ = suffix_dedup.lyndon_groups(text)
    for i in range(len(text) - 1):
        for j in range(len(text) - 1):
            assert (group[i] == group[j]) == (prefix(i) == prefix(j))


def check_bytes(rows, got):
    gone = removed_bytes([r[:2] for r in rows])
    texts = {d: (t or "").encode() for d, t, *_ in rows}
    for r in got:
        raw = texts[r.doc_id]
        mask = gone[r.doc_id] if r.doc_id is not None else bytes(len(raw))
        kept = bytes(b for b, g in zip(raw, mask) if not g)
        spans = sum(1 for i in range(len(mask)) if mask[i] and not (i and mask[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(mask), spans, sha(kept)), r.doc_id


@pytest.mark.parametrize("wide", [suffix_dedup.WIDE_KEY, 3])
def test_repeats_match_brute_force(spark, family, wide, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDE_KEY", wide)  # local mode: workers are forked and see it
    rng = random.Random(4)
    short = "a shared string of forty-five bytes, no more."
    rows = family + [(5000 + i, prose(9000 + i, 9) + short + prose(9500 + i, 9) + "\x00" * rng.randrange(3), "", "", 0) for i in range(30)]
    rows += [(6000 + i, "ab" * rng.randrange(20, 200) + "é" * rng.randrange(40), "", "", 0) for i in range(20)]
    check_bytes(rows, suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())


def test_repeats_in_awkward_documents(spark, clashing, docs, empty):
    got = suffix_dedup.remove_repeats(clashing).collect()
    assert len(got) == len(awkward_docs())
    check_bytes(awkward_docs(), got)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    texts = {r.doc_id: r.kept_text for r in suffix_dedup.remove_repeats(docs, texts=True).collect()}
    assert texts[2] == "" and texts[0] == awkward_docs()[0][1]


def test_share_of_pairs_that_no_tree_meets():
    assert (1 - 0.85 ** minhash_forest.DEPTH) ** minhash_forest.TREES < 1e-5
    p = sum(math.comb(64, k) * 0.85 ** k * 0.15 ** (64 - k) for k in range(minhash_forest.SKETCH_EQUAL))
    assert p < 1e-4


def test_forests_lose_few_pairs_at_any_limit():
    assert minhash_forest.forest_of(85) == (16, 4, 41)
    for percent in (20, 50, 70, 80, 85, 90, 99):
        trees, depth, equal = minhash_forest.forest_of(percent)
        share = percent / 100
        assert trees * depth <= minhash_forest.MINIMA and (1 - share ** depth) ** trees <= 1e-5
        assert sum(math.comb(64, k) * share ** k * (1 - share) ** (64 - k) for k in range(equal)) < 1e-4
    with pytest.raises(ValueError):
        minhash_forest.forest_of(5)
