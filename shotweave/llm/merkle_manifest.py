"""Merkle manifest of a dataset: a digest per row, a tree per source, a tree over the sources, and proofs by midstates.

A parent is the SHA-256 of its children's hex digests, one after the other. While it is built, a copy of the hash state
is kept before each child's slot. To fold a changed child, the state of its slot is resumed with the replacement and the
children to its right; what lies to the left is never hashed again.

Trees of any size are built in blocks of ``ARITY ** HEIGHT`` neighbouring nodes: one Arrow group builds the levels of its
block and hands its top on to the next round, so a source of n rows takes log(n) / (HEIGHT log ARITY) rounds. Every block
then folds its own leaves. Hash states can't leave a process: a block makes those of the parents above it from their left
children, once for all of its leaves.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave.llm.ranking import Ranked
from shotweave.llm.shared import written

ARITY = 3
#: Levels of a block: at most 3 ** 7 = 2,187 leaves in a group.
HEIGHT = 7

_PATH = "array<struct<left: string, right: string>>"
_PATH_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the values, each as its number of UTF-8 bytes, a colon and itself, or ``-`` if it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _height(n: int, arity: int) -> int:
    """Levels above ``n`` nodes."""
    h, room = 0, 1
    while room < n:
        h, room = h + 1, room * arity
    return h


def build(nodes: list[bytes], levels: int, arity: int) -> list[list[tuple[list[bytes], list]]]:
    """Parents of each level from the lowest: (children, hash states before each child's slot).

    The digests of a level are the nodes of the next; the single last one is the top.
    """
    tree = []
    for _ in range(levels):
        row, above = [], []
        for at in range(0, len(nodes), arity):
            children, state, states = nodes[at:at + arity], hashlib.sha256(), []
            for child in children:
                states.append(state.copy())
                state.update(child)
            row.append((children, states))
            above.append(state.hexdigest().encode())
        tree.append(row)
        nodes = above
    return tree


def fold(state, replacement: bytes, right: bytes) -> bytes:
    """The parent's digest when the child at the state's slot is ``replacement`` and ``right`` follows."""
    resumed = state.copy()
    resumed.update(replacement)
    resumed.update(right)
    return resumed.hexdigest().encode()


def _top(tree: list, nodes: list[bytes]) -> bytes:
    return fold(tree[-1][0][1][-1], tree[-1][0][0][-1], b"") if tree else nodes[0]


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _block(table: pa.Table, arity: int, height: int) -> tuple[pa.Table, list, bytes]:
    table = _in_order(table)
    nodes = [x.encode() for x in table.column("digest").to_pylist()]
    tree = build(nodes, min(height, _height(table.column("n")[0].as_py(), arity)), arity)
    return table, tree, _top(tree, nodes)


def _tops(key, table: pa.Table, arity: int, height: int) -> pa.Table:
    """One row for a block: its top, as a node of the next round."""
    _, _, top = _block(table, arity, height)
    size = arity ** height
    return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-table.column("n")[0].as_py() // size)], "digest": [top.decode()]})


def _paths(key, table: pa.Table, arity: int, height: int) -> pa.Table:
    """For each node of a block, its siblings on either side level by level, and the block's top."""
    table, tree, top = _block(table, arity, height)
    paths = []
    for i in range(table.num_rows):
        path = []
        for row in tree:
            i, slot = divmod(i, arity)
            children = row[i][0]
            path.append({"left": b"".join(children[:slot]).decode(), "right": b"".join(children[slot + 1:]).decode()})
        paths.append(path)
    return pa.table({"tree": table.column("tree"), "pos": table.column("pos"), "path": pa.array(paths, _PATH_ARROW), "top": pa.array([top.decode()] * len(paths), pa.string())})


def _climb(nodes: DataFrame, most: int, arity: int, height: int) -> DataFrame:
    """(tree, pos, path, top) for every node of trees with at most ``most`` nodes: its path to the tree's top, and that."""
    size = arity ** height
    block = F.expr(f"pos div {size}").alias("block")
    paths = written(nodes.groupBy("tree", block).applyInArrow(lambda key, nodes: _paths(key, nodes, arity, height), f"tree long, pos long, path {_PATH}, top string"), "paths")
    if most <= size:
        return paths
    tops = written(nodes.groupBy("tree", block).applyInArrow(lambda key, nodes: _tops(key, nodes, arity, height), "tree long, pos long, n long, digest string"), "tops")
    above = _climb(tops, -(-most // size), arity, height).select("tree", F.col("pos").alias("block"), F.col("path").alias("rest"), F.col("top").alias("_top"))
    return paths.withColumn("block", block).join(above, ["tree", "block"]).select("tree", "pos", F.concat("path", "rest").alias("path"), F.col("_top").alias("top"))


def _fold_block(left: pa.Table, right: pa.Table, arity: int, height: int) -> pa.Table:
    """Proof and folded root of every leaf of a block; ``right`` has the one path that the block's top has to the root."""
    table, tree, _ = _block(left, arity, height)
    above = right.to_pylist()[0]
    lefts, rights = [x["left"].encode() for x in above["path"]], [x["right"].encode() for x in above["path"]]
    states = [hashlib.sha256(x) for x in lefts]
    beyond = b"".join(x + y for x, y in zip(lefts, rights))
    proofs, folded = [], []
    for at, (leaf, changed) in enumerate(zip(table.column("digest").to_pylist(), table.column("changed").to_pylist())):
        node, proof, i = (changed or leaf).encode(), hashlib.sha256(), at
        for row in tree:
            i, slot = divmod(i, arity)
            children, kept = row[i]
            after = b"".join(children[slot + 1:])
            proof.update(b"".join(children[:slot]) + after)
            node = fold(kept[slot], node, after)
        proof.update(beyond)
        for state, after in zip(states, rights):
            node = fold(state, node, after)
        proofs.append(proof.hexdigest())
        folded.append(node.decode())
    n = table.num_rows
    return pa.table({"doc_id": table.column("doc_id"), "leaf": table.column("digest"), "subroot": pa.array([above["subroot"]] * n, pa.string()),
                     "root": pa.array([above["root"]] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
                     "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == above["root"] for x in folded], pa.bool_())})


def newline_loss(docs: DataFrame) -> Column:
    """The text that tampering leaves: documents whose unsigned crc32 of the decimal id is even lose their line ends."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """Tree, proof and check of every row of ``docs`` (doc_id, source, lang, n_chars, text; other columns are left alone).

    Columns: doc_id, leaf, subroot (of the row's source), root, proof_sha256 (of all siblings, from the leaf up, left to
    right), folded_root (from the leaf of the row with ``tampered`` in place of text), verified (folded_root is root).
    One row per row: repeated rows are leaves of their own. Within a source leaves go by doc_id, a null first; rows with
    equal doc_id go by their digests. A null source is a source of its own, before the others, and so is an empty one.
    Null columns have their own mark, so null and empty texts differ. A single row has no siblings: its leaf is the root
    and its proof is the digest of nothing. An empty table gives no rows.
    """
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    tampered = F.col("text") if tampered is None else tampered
    leaf, other = leaf_digest([*fields, F.col("text")]), leaf_digest([*fields, tampered])
    changed = F.when(tampered.eqNullSafe(F.col("text")), F.lit(None)).otherwise(other)
    ranked = Ranked(docs.select("doc_id", "source", leaf.alias("digest"), changed.alias("changed")), ["source"], ["doc_id", "digest"], "leaves")
    groups = written(ranked.groups().select(F.col("source").alias("_source"), "n", F.col("seat").alias("tree")), "sources")
    most, trees = groups.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    size = arity ** height
    leaves = written(ranked.rows().join(groups.select("_source", "tree"), F.col("source").eqNullSafe(F.col("_source")))
                     .select("tree", F.expr(f"pos div {size}").alias("block"), "pos", "n", "doc_id", "digest", "changed"), "placed")
    tops = written(leaves.groupBy("tree", "block").applyInArrow(lambda key, nodes: _tops(key, nodes, arity, height), "tree long, pos long, n long, digest string"), "tops")
    blocks = _climb(tops, -(-most // size), arity, height).withColumnRenamed("top", "subroot")
    subroots = written(blocks.filter("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), F.col("subroot").alias("digest")), "subroots")
    sources = _climb(subroots, trees, arity, height).select(F.col("pos").alias("tree"), F.col("path").alias("rest"), F.col("top").alias("root"))
    above = blocks.join(sources, "tree").select("tree", F.col("pos").alias("block"), F.concat("path", "rest").alias("path"), "subroot", "root")
    return leaves.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(lambda own, path: _fold_block(own, path, arity, height), _RESULT)
