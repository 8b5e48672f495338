import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shotweave.llm import prefix_trie

CONV = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def order(row):
    _, turn, role, text = row
    digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
    return turn is not None, turn or 0, int(digest[:15], 16), int(digest[16:31], 16)


def brute(rows):
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = int(not kids[p]), (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for k in kids[p]:
            leaves, saved = leaves + sums[k][0], saved + sums[k][1]
        sums[p] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[p]) if len(full[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def talks():
    """Blocks that share heads, a long chain with branches, copies, many alike, empty heads, nulls and repeats."""
    rnd = random.Random(5)
    rows = [(c, t, "user" if t % 2 == 0 else "bot", rnd.choice(["a b", "a b", "c", "d e f"]) if t < 3 else f"w {rnd.randrange(3)} x") for c in range(120) for t in range(rnd.randrange(1, 7))]
    base = [(t, "u", f"step {t} of many") for t in range(150)]
    rows += [(200 + k, *r) for k in range(4) for r in base[:150 - 40 * k]] + [(200 + k, 500, "u", f"branch {k}") for k in range(4)]
    rows += [(1000 + k, t, "u", "same") for k in range(60) for t in range(4)]
    rows += [(7, None, None, None), (7, None, "x", "null turn"), (7, 0, "u", "tie"), (7, 0, "u", "tie"), (7, 0, "u", "ties"), (None, 0, "u", "nobody"), (-41, 0, "u", "below\x0bzero é"), (-41, 1, "", "")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("local_nodes,run", [(prefix_trie.LOCAL_NODES, 1024), (60, 16), (1, 4)])
def test_equals_brute_force(spark, talks, monkeypatch, local_nodes, run):
    """Few nodes per task: components are split by rounds over the table, down to single nodes with 1."""
    monkeypatch.setattr(prefix_trie, "RUN_TURNS", run)
    rows = talks if local_nodes > 1 else [r for r in talks if r[0] is None or r[0] < 30 or r[0] in (200, 203)]
    assert got(prefix_trie.trie(spark.createDataFrame(rows, CONV), local_nodes)) == brute(rows)


def test_clashing_names_and_empty(spark, talks):
    rows = [r for r in talks if r[0] is not None and r[0] < 12]
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 as d", "2 as pos", "3 as n", "4 as len", "5 as words", "6 as depth", "7 as f1", "8 as _row")
    assert got(prefix_trie.trie(df)) == brute(rows)
    assert got(prefix_trie.trie(spark.createDataFrame([], CONV))) == []


def test_conversation_without_turns_is_the_roots(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    assert got(prefix_trie.trie(spark.createDataFrame([(c, 0, "u", "x")], CONV))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=60), st.booleans())
def test_decomposition_of_any_tree(draws, chain):
    parent = [-1] + [(i if chain and x % 4 else x % (i + 1)) for i, x in enumerate(draws)]
    n = len(parent)
    leaf, save = [int(i not in parent) for i in range(n)], [i * i for i in range(n)]
    want_leaf, want_save = leaf[:], save[:]
    for i in range(n - 1, 0, -1):
        want_leaf[parent[i]] += want_leaf[i]
        want_save[parent[i]] += want_save[i]
    assert prefix_trie.decompose(parent, leaf, save) == (want_leaf, want_save)


def test_different_turns_with_one_fingerprint_raise(spark):
    steps = spark.createDataFrame([(1, 1, 5, 5, 0, 0, 1, 1, 1, 1), (2, 1, 5, 5, 0, 0, 2, 1, 1, 1)], "conv_id long, d long, f1 long, f2 long, g1 long, g2 long, a1 long, a2 long, words long, len long")
    with pytest.raises(Exception, match="same fingerprint"):
        prefix_trie.nodes_of(steps).collect()
