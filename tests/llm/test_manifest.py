import hashlib
import zlib

import pytest
from helpers import SCHEMA, awkward_docs, prose

from shotweave.llm import merkle_manifest
from shotweave.llm.ranking import Ranked


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    d, _, lang, source, n = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)])


def levels(nodes, arity=3):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def climb(tree, i, node, arity=3):
    """(proof, digest of the top) for ``node`` in place i of the lowest level."""
    proof = []
    for level in tree[:-1]:
        at = i - i % arity
        run = level[at:at + arity]
        proof += run[:i - at] + run[i - at + 1:]
        run[i - at] = node
        node, i = h(*run), i // arity
    return proof, node


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, placed = [], []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        placed.append(own)
        trees.append(levels([leaf(r, r[1]) for r in own]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, own in enumerate(placed):
        for i, r in enumerate(own):
            bad = r[1] if r[1] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[1].replace("\n", "")
            proof, sub = climb(trees[k], i, leaf(r, bad))
            more, folded = climb(top, k, sub)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], h(*proof, *more), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def many():
    """A source with half of the rows, small ones, one of a single row, a null and an empty one."""
    rows = []
    for i in range(160):
        source = "hot" if i % 2 else [None, "", "é", "z", "Z", "a"][i // 2 % 6]
        rows.append((i * 7 % 160, prose(i, 5) + "\n" * (i % 3), None if i % 11 == 0 else "en", source, i))
    return [*rows, (999, "x\ny", "de", "lone", 3)]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_equals_trees_built_at_once(spark, many, height):
    """Low blocks make many rounds, over sources and over the leaves of one."""
    want = brute(many)
    assert got(merkle_manifest.manifest(spark.createDataFrame(many, SCHEMA), merkle_manifest.newline_loss(spark.createDataFrame(many, SCHEMA)), height=height)) == want
    assert {w[-1] for w in want} == {True, False}


def test_awkward_rows(spark, docs, clashing, empty):
    want = brute([(d, t, lang, s, n) for d, t, lang, s, n in awkward_docs()])
    assert got(merkle_manifest.manifest(docs, merkle_manifest.newline_loss(docs))) == want
    extra = clashing.selectExpr("*", "1 as pos", "2 as tree", "3 as digest", "4 as _row", "5 as n", "6 as block", "7 as changed")
    assert got(merkle_manifest.manifest(extra, merkle_manifest.newline_loss(extra))) == want
    assert got(merkle_manifest.manifest(empty)) == []


def test_a_single_row_is_its_own_root(spark):
    (row,) = merkle_manifest.manifest(spark.createDataFrame([(5, "t", None, None, 1)], SCHEMA)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h() and row.verified


def test_folding_hashes_nothing_to_the_left():
    children = [b"a" * 64, b"b" * 64, b"c" * 64]
    ((run, states),), = merkle_manifest.build(children, 1, 3)
    assert run == children
    for slot in range(3):
        changed = children[:slot] + [b"x" * 64] + children[slot + 1:]
        assert merkle_manifest.fold(states[slot], b"x" * 64, b"".join(children[slot + 1:])).decode() == hashlib.sha256(b"".join(changed)).hexdigest()


def test_places_in_groups_over_many_partitions(spark):
    """One group over all partitions, a null group, ties."""
    rows = [(None if i % 9 == 0 else "g" if i % 9 < 7 else f"s{i}", i * 31 % 1000 // 2) for i in range(1000)]
    ranked = Ranked(spark.createDataFrame(rows, "g string, v long").repartition(7), ["g"], ["v"], "test")
    by = {}
    for r in ranked.rows().collect():
        by.setdefault(r.g, []).append((r.pos, r.v, r.n))
    for g, found in by.items():
        assert [v for _, v, _ in sorted(found)] == sorted(v for x, v in rows if x == g)
        assert [p for p, *_ in sorted(found)] == list(range(len(found))) and {n for *_, n in found} == {len(found)}
    seats = {r.g: (r.seat, r.n) for r in ranked.groups().collect()}
    order = sorted({g for g, _ in rows}, key=lambda g: (g is not None, g or ""))
    assert [seats[g][0] for g in order] == list(range(len(order))) and all(seats[g][1] == len(by[g]) for g in order)
