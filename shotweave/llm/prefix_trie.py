"""Trie of conversations that share their first turns, with sums over subtrees by centroid decomposition.

A node is a distinct sequence of first turns. Each row of a conversation gets the running exclusive or of its turns'
128-bit hashes (bound to their places) as the fingerprint of the sequence so far; equal fingerprints make a node, and
every node checks that its members have the same last turn and the same parent.

Sums over subtrees come from splitting the forest of parent edges at centroids. In each round every component that is too
large for a task gives up a hub: the deepest node that still holds more than half of the component's weight, where a
node's weight is its number of members, as then the weight under a node follows from its members' lengths. The hub's
subtree in the component has a total; the hub and all nodes on its path to the component's top receive it. The component
falls apart into the subtrees under the hub, and the rest, each with at most half of the weight. So a chain of any length
and a node with any number of children take log(weight) rounds. Components of at most ``LOCAL_NODES`` are decomposed in the
same way inside a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.llm.ranking import Ranked
from shotweave.llm.shared import new_path, remove, written, written_at

#: A conversation takes at most this many turns of the one it is rebuilt on.
MOST_HEAD = 3
#: Conversations of a block are rebuilt on its first.
BLOCK = 20
#: Turns over which one window runs; longer conversations add up the sums of such runs.
RUN_TURNS = 1024
#: Components of more nodes are split by rounds over the whole table.
LOCAL_NODES = 8192

_EMPTY = hashlib.sha256().hexdigest()
_TOP = ["td", "t1", "t2"]


def _digest_bits(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len) of every rebuilt conversation, and its turns (conv_id, d, a1, a2, words), d from 1.

    Conversation c has the first h turns of conversation c - c % 20 (h is crc32 of c modulo 4; fewer if that has fewer,
    none if there is no such), then its own turns after its first h. Turns go by ``turn``, nulls first, equal ones by the
    hash of role and text. Null roles and texts are empty. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), word_count(text).alias("words"))
    turns = turns.select("conv_id", "turn", _digest_bits(F.col("digest"), 1).alias("a1"), _digest_bits(F.col("digest"), 17).alias("a2"), "words")
    own = Ranked(turns, ["conv_id"], ["turn", "a1", "a2"], "turns").rows()
    own = written(own.select("conv_id", "a1", "a2", "words", "pos", "n"), "turns")
    heads = own.filter((F.col("pos") < MOST_HEAD) & (F.col("conv_id") % BLOCK == 0))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    counts = own.filter("pos = 0").select("conv_id", "n", h.alias("h"), base.alias("base"))
    first = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("there"))
    k = F.least("h", F.coalesce("there", F.lit(0)))
    convs = written(counts.join(first, "base", "left").select("conv_id", "base", "h", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "rebuilt")
    taken = (convs.filter("k > 0").join(heads.select(F.col("conv_id").alias("base"), "a1", "a2", "words", "pos"), "base").filter("pos < k")
             .select("conv_id", (F.col("pos") + 1).alias("d"), "a1", "a2", "words"))
    kept = own.filter(F.col("pos") >= h).join(convs.select("conv_id", "h", "k"), "conv_id").select(
        "conv_id", (F.col("pos") + 1 - F.col("h") + F.col("k")).alias("d"), "a1", "a2", "words")
    return convs.select("conv_id", "len"), taken.unionByName(kept)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per conversation and depth, the root's 0 included: fingerprint f of its first d turns, g of the first d - 1."""
    bound = turns.withColumns({"x1": F.xxhash64("d", "a1", "a2"), "x2": F.xxhash64("a2", "d", "a1", F.lit(1)), "run": F.expr(f"(d - 1) div {RUN_TURNS}")})
    runs = bound.groupBy("conv_id", "run").agg(F.bit_xor("x1").alias("r1"), F.bit_xor("x2").alias("r2"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carry = runs.select("conv_id", "run", *[F.bit_xor(f"r{i}").over(before).alias(f"c{i}") for i in (1, 2)]).filter("run > 0")
    upto = Window.partitionBy("conv_id", "run").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    within = bound.select("conv_id", "d", "run", "a1", "a2", "words", "x1", "x2", *[F.bit_xor(f"x{i}").over(upto).alias(f"w{i}") for i in (1, 2)])
    whole = within.join(carry, ["conv_id", "run"], "left")
    f = [F.col(f"w{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))) for i in (1, 2)]
    steps = whole.select("conv_id", "d", f[0].alias("f1"), f[1].alias("f2"), f[0].bitwiseXOR(F.col("x1")).alias("g1"), f[1].bitwiseXOR(F.col("x2")).alias("g2"), "a1", "a2", "words")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", *[zero.alias(c) for c in ("d", "f1", "f2", "g1", "g2", "a1", "a2", "words")])
    return steps.unionByName(root).join(convs, "conv_id")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's ids, from rows sorted by node and id; only the running hash of a node is held."""
    schema = pa.schema([("d", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("ends_sha256", pa.string())])
    held, state = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("d", "f1", "f2")])
        ids = pc.cast(batch.column("conv_id"), pa.string()).to_pylist()
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
        done = []
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(keys[:, a].tolist())
            if key == held:
                state.update(b",")
            else:
                if held is not None:
                    done.append((*held, state.hexdigest()))
                held, state = key, hashlib.sha256()
            state.update(",".join(ids[a:b]).encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*held, state.hexdigest())))], schema)


def nodes_of(steps: DataFrame) -> DataFrame:
    """Nodes with parents, members, children, and weight: the rows of ``steps`` at or under the node."""
    turn = F.struct("a1", "a2", "g1", "g2")
    found = steps.groupBy("d", "f1", "f2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min(turn).alias("low"), F.max(turn).alias("high"),
        F.sum(F.col("len") - F.col("d") + 1).alias("weight"))
    same = F.when(F.col("low") == F.col("high"), F.col("low.g1")).otherwise(F.raise_error(F.lit("different first turns have the same fingerprint")).cast("long"))
    found = written(found.select("d", "f1", "f2", same.alias("g1"), F.col("low.g2").alias("g2"), "conv_id", "n_convs", "words", "weight"), "nodes")
    kids = found.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("g1").alias("f1"), F.col("g2").alias("f2")).agg(F.count("*").alias("n_children"))
    tops = found.select((F.col("d") + 1).alias("d"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("conv_id").alias("parent_conv_id"))
    return (found.join(kids, ["d", "f1", "f2"], "left").fillna(0, ["n_children"]).join(tops, ["d", "g1", "g2"], "left")
            .withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "save": (F.col("n_convs") - 1) * F.col("words")}))


def _split(parts: DataFrame, steps: DataFrame, local_nodes: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds over the components of more than ``local_nodes`` nodes, until there is none: (small components, hubs).

    parts: nodes with their component's top (td, t1, t2), weight in the component, and the sums received so far
    (leaves, saved). A round ends with two written tables, of the components that stay and of those to split on.
    """
    spark, small, done, held = parts.sparkSession, [], [], []
    while True:
        sizes = parts.groupBy(*_TOP).agg(F.count("*").alias("size"), F.max("weight").alias("total"))
        sized = parts.join(sizes, _TOP)
        small.append(written(sized.filter(F.col("size") <= local_nodes).drop("size", "total"), "small"))
        large = new_path(spark, "large")
        big = written_at(sized.filter(F.col("size") > local_nodes).drop("size"), large)
        for path in held:
            remove(spark, path)
        if big.isEmpty():
            remove(spark, large)
            return small, done
        hubs = written(big.filter("2 * weight > total").groupBy(*_TOP).agg(F.max(F.struct("d", "f1", "f2", "conv_id", "weight")).alias("h"))
                       .select(*_TOP, F.col("h.d").alias("hd"), F.col("h.f1").alias("h1"), F.col("h.f2").alias("h2"), F.col("h.conv_id").alias("hc"), F.col("h.weight").alias("hw")), "hubs")
        path = hubs.join(steps.select(F.col("conv_id").alias("hc"), "d", "f1", "f2"), "hc").filter("d >= td and d < hd").select("d", "f1", "f2", F.lit(True).alias("on_path"))
        marked = big.drop("total").join(hubs, _TOP)
        above = marked.filter("d <= hd").join(path, ["d", "f1", "f2"], "left").withColumn("part", F.when((F.col("f1") == F.col("h1")) & (F.col("f2") == F.col("h2")) & (F.col("d") == F.col("hd")), "hub")
                                                                                          .when(F.col("on_path"), "path").otherwise("rest")).drop("on_path")
        child = steps.select("conv_id", (F.col("d") - 1).alias("hd"), F.col("f1").alias("n1"), F.col("f2").alias("n2"), F.col("g1").alias("h1"), F.col("g2").alias("h2"))
        below = marked.filter("d > hd").join(child, ["conv_id", "hd", "h1", "h2"], "left").withColumn("part", F.when(F.col("n1").isNotNull(), "under").otherwise("rest"))
        cut = new_path(spark, "cut")
        both = written_at(above.withColumns({"n1": F.lit(None).cast("long"), "n2": F.lit(None).cast("long")}).unionByName(below), cut)
        totals = both.filter("part in ('hub', 'under')").groupBy(*_TOP, "part", "n1", "n2").agg(F.sum("leaf").alias("sl"), F.sum("save").alias("ss"))
        totals = totals.groupBy(*_TOP).agg(F.sum("sl").alias("sl"), F.sum("ss").alias("ss"))  # of the new components, then of the hub
        gets = F.col("part").isin("hub", "path")
        new_top = {"td": F.when(gets & (F.col("part") == "hub"), F.col("hd")).when(F.col("part") == "under", F.col("hd") + 1).otherwise(F.col("td")),
                   "t1": F.when(F.col("part") == "hub", F.col("h1")).when(F.col("part") == "under", F.col("n1")).otherwise(F.col("t1")),
                   "t2": F.when(F.col("part") == "hub", F.col("h2")).when(F.col("part") == "under", F.col("n2")).otherwise(F.col("t2"))}
        told = both.join(totals, _TOP)
        parts = told.withColumns({"leaves": F.col("leaves") + F.when(gets, F.col("sl")).otherwise(0), "saved": F.col("saved") + F.when(gets, F.col("ss")).otherwise(0),
                                  "weight": F.when(F.col("part") == "path", F.col("weight") - F.col("hw")).when(F.col("part") == "hub", 1).otherwise(F.col("weight")),
                                  "done": F.col("part") == "hub"}).withColumns(new_top)
        columns = [c for c in big.columns if c != "total"]
        settled = new_path(spark, "split")
        parts = written_at(parts.select(*columns, "done"), settled)
        done.append(written(parts.filter("done").select(*columns), "hubs-done"))  # a hub has all its sums
        parts = parts.filter("not done").select(*columns)
        held = [large, cut, settled]


def decompose(parent: list[int], leaf: list[int], save: list[int]) -> tuple[list[int], list[int]]:
    """Sums over subtrees of one component. Nodes stand after their parents; the first is the top, with parent -1."""
    n = len(parent)
    leaves, saved, size, group = [0] * n, [0] * n, [0] * n, [0] * n
    stack = [list(range(n))]
    while stack:
        nodes = stack.pop()
        top = nodes[0]
        if len(nodes) == 1:
            leaves[top] += leaf[top]
            saved[top] += save[top]
            continue
        for i in nodes:
            size[i] = 1
        hub = top
        for i in reversed(nodes):
            if 2 * size[i] > len(nodes):
                hub = i  # met from below: the first that holds more than half is the deepest
                break
            size[parent[i]] += size[i]
        parts, rest = {}, []
        for i in nodes:
            group[i] = i if i == hub else -1 if i == top else i if parent[i] == hub else -1 if group[parent[i]] in (-1, hub) else group[parent[i]]
            if group[i] == -1:
                rest.append(i)
            elif i != hub:
                parts.setdefault(group[i], []).append(i)
        total_leaf = leaf[hub] + sum(leaf[i] for p in parts.values() for i in p)
        total_save = save[hub] + sum(save[i] for p in parts.values() for i in p)
        i = hub
        while True:
            leaves[i] += total_leaf
            saved[i] += total_save
            if i == top:
                break
            i = parent[i]
        stack += parts.values()
        if rest:
            stack.append(rest)
    return leaves, saved


_LOCAL = [("td", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("d", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()),
          ("leaf", pa.int64()), ("save", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())]
_SUMS = pa.schema([("d", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def _sums_of(rows: list[np.ndarray]) -> pa.RecordBatch:
    _, _, _, d, f1, f2, g1, g2, leaf, save, leaves, saved = (x.tolist() for x in rows)
    at = {key: i for i, key in enumerate(zip(d, f1, f2))}
    parent = [-1, *(at[d[i] - 1, g1[i], g2[i]] for i in range(1, len(d)))]
    more_leaves, more_saved = decompose(parent, leaf, save)
    return pa.record_batch([pa.array(d), pa.array(f1), pa.array(f2), pa.array([a + b for a, b in zip(leaves, more_leaves)], pa.int64()),
                            pa.array([a + b for a, b in zip(saved, more_saved)], pa.int64())], schema=_SUMS)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components one after the other from rows sorted by (top, depth); at most one component is held besides a batch."""
    rest, out, n = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.stack([batch.column(name).to_numpy() for name, _ in _LOCAL])
        table = table if rest is None else np.concatenate([rest, table], axis=1)
        cuts = [0, *(np.flatnonzero((table[:3, 1:] != table[:3, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            out.append(_sums_of(list(table[:, a:b])))
            n += b - a
            if n > 50_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, n = [], 0
        rest = table[:, cuts[-1]:]
    if rest is not None:
        out.append(_sums_of(list(rest)))
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def rollup(nodes: DataFrame, steps: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """(d, f1, f2, n_leaves, saved_tokens): sums of ``leaf`` and ``save`` over every node's subtree."""
    zero = F.lit(0).cast("long")
    parts = nodes.select("d", "f1", "f2", "g1", "g2", "conv_id", "weight", "leaf", "save", zero.alias("leaves"), zero.alias("saved"), zero.alias("td"), zero.alias("t1"), zero.alias("t2"))
    small, done = _split(parts, steps, local_nodes)
    whole = reduce(DataFrame.unionByName, small).repartition(*_TOP).sortWithinPartitions(*_TOP, "d").select(*[name for name, _ in _LOCAL])
    sums = whole.mapInArrow(_local, "d long, f1 long, f2 long, n_leaves long, saved_tokens long")
    hubs = [x.select("d", "f1", "f2", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")) for x in done]
    return reduce(DataFrame.unionByName, hubs, sums)


def trie(conversations: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """Every node of the trie of rebuilt conversations (conv_id, turn, role, text; other columns are left alone).

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Repeated rows are turns of their own. A conversation whose turns are all replaced by none is
    a member of the root alone. An empty table has no conversations and gives no rows, not even a root.
    """
    convs, turns = rebuilt(conversations)
    steps = written(prefixes(convs, turns), "steps")
    nodes = written(nodes_of(steps), "nodes")
    sums = rollup(nodes, steps, local_nodes)
    last = steps.filter("d = len").select("d", "f1", "f2", "conv_id").repartition("d", "f1", "f2").sortWithinPartitions("d", "f1", "f2", "conv_id")
    ends = last.mapInArrow(_ends, "d long, f1 long, f2 long, ends_sha256 string")
    key = ["d", "f1", "f2"]
    return nodes.join(sums, key).join(ends, key, "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
