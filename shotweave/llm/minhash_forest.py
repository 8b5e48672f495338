"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Every text becomes its set of distinct 5-word shingles, a 128-bit fingerprint of the set, and
   64 minima. Documents with equal sets form one class; only its smallest doc_id goes on.
2. The forest has 16 trees for a limit of 85 %, each a different order of the signature. A region of
   a tree is a run of documents that share its first four minima (17 trees and three for 80 %). Regions of one document are dropped. A region
   of more than ``REGION_ROWS`` is dealt out to parts.
3. Inside a region documents are sorted by their signature in the tree's order. First, every
   document's candidate is the neighbour, among those with the longest common prefix, with the
   best estimate, over all trees. Confirmed links give components. In regions of several
   components all pairs of different ones are then looked at inside the region's tasks, to which
   each document's set is brought once: two bounds rule most out (the sketch, and the exact count
   of shingles that a document shares with anyone at all, which no pair can exceed), the others
   are confirmed on full sets, and a link joins its components at once. Only these links, fewer
   than components, leave the task. In a large region neighbours are looked for among the
   documents of a part that share twice as many minima, and the region's first is tried with all;
   on components every two parts of a region meet.

Trees, depth and the sketch's bound follow from the limit: a pair at the limit shares no region in
any tree with probability (1 - 0.85^4)^16, 7 in a million, or less than 1 in 100,000 at other limits;
the sketch drops it as rarely. Moves: texts once (to the
documents that share a region), ids and 64-byte sketches otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, comb, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.components import connected_components
from shotweave.llm.shared import written
from shotweave.llm.textbatch import ASCII_LOWER, find_words, hash_ngrams, hash_words, mix64, seeds, slices, text_bytes

SHINGLE = 5
MINIMA = 64
REGION_ROWS = 20_000
#: Neighbours looked at on one side of a document in a tree's order.
NEIGHBOURS = 4
#: Shingles that a task holds of one part of a region, while it looks for links between components: 32 MB.
REGION_SHINGLES = 4_000_000
#: Least share, in percent, of equal shingles of a link.
LINK_PERCENT = 85
#: Greatest probability that a pair at the limit shares no region, and that its sketches rule it out.
MISS = 1e-5


class Forest(NamedTuple):
    """Trees, minima of a region's key, and least equal sketch bytes (of 64) of a pair worth confirming."""

    trees: int
    depth: int
    equal: int


def forest_of(percent: int) -> Forest:
    """The deepest forest, and the highest bound on sketches, that lose a pair at the limit with ``MISS`` at most."""
    share = min(percent, 99) / 100
    need = {d: ceil(log(MISS) / log(1 - share ** d)) for d in range(1, MINIMA + 1) if share ** d > 1e-9}
    deep = [d for d, trees in need.items() if trees * d <= MINIMA]
    if not deep:
        raise ValueError(f"{MINIMA} minima don't find links at {percent} %")
    byte = share + (1 - share) / 256
    below, equal = 0.0, 0
    while (below := below + comb(MINIMA, equal) * byte ** equal * (1 - byte) ** (MINIMA - equal)) <= MISS:
        equal += 1
    return Forest(need[max(deep)], max(deep), equal)


TREES, DEPTH, SKETCH_EQUAL = forest_of(LINK_PERCENT)

_A, _B = seeds(MINIMA, 21) | np.uint64(1), seeds(MINIMA, 22)


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after the other, end offsets with a leading 0)."""
    data, offsets = text_bytes(column)
    data = ASCII_LOWER[data]
    words = find_words(data, offsets)
    h, of = hash_ngrams(hash_words(data, words), words, SHINGLE, short=True)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(offsets) - 1))])


def _signatures(h: np.ndarray, ends: np.ndarray, forest: Forest) -> dict[str, np.ndarray]:
    """Fingerprints, region keys of two depths and byte sketches of the texts that have a shingle."""
    first = ends[:-1][np.diff(ends) > 0]
    least = np.empty((len(first), MINIMA), dtype=np.uint64)
    for k in range(MINIMA):
        least[:, k] = np.minimum.reduceat((h ^ _B[k]) * _A[k], first)
    least >>= np.uint64(24)
    key = {}
    for name, depth in (("regions", forest.depth), ("deep", 2 * forest.depth)):
        out = np.empty((len(first), forest.trees), dtype=np.uint64)
        for t in range(forest.trees):
            part = np.full(len(first), t + 1, dtype=np.uint64)
            for k in range(depth):
                part = mix64(part * np.uint64(31) + least[:, (t * forest.depth + k) % MINIMA])
            out[:, t] = part
        key[name] = out.view(np.int64)
    return {"f1": np.add.reduceat(mix64(h ^ np.uint64(1)), first).view(np.int64),
            "f2": np.add.reduceat(mix64(h + _A[0]), first).view(np.int64), **key, "sketch": mix64(least).astype(np.uint8)}


def _sign_batches(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h, ends = _sets(part.column("text"))
            size = np.diff(ends)
            at = np.where(size > 0, np.cumsum(size > 0) - 1, -1)
            empty = pa.array(at < 0)
            sig = _signatures(h, ends, forest) if len(h) else None

            def column(name: str, kind: pa.DataType) -> pa.Array:
                if sig is None:
                    return pa.nulls(len(at), kind)
                rows = sig[name]
                if name == "sketch":
                    values = pa.array([r.tobytes() for r in rows], kind)
                elif rows.ndim == 2:
                    values = pa.array(list(rows), kind)
                else:
                    values = pa.array(rows, kind)
                return values.take(pa.array(at, mask=at < 0))

            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size.astype(np.int64)), column("f1", pa.int64()), column("f2", pa.int64()),
                 column("regions", pa.list_(pa.int64())), column("deep", pa.list_(pa.int64())), column("sketch", pa.binary())],
                names=["doc_id", "n_shingles", "f1", "f2", "regions", "deep", "sketch"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h, ends = _sets(part.column("text"))
            arrays = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), arrays], names=["doc_id", "shingles"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole regions (rows of one key) from batches that are sorted by key, several small ones at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        key = rest.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1], side="left"))
        if last:
            yield rest.slice(0, last)
            rest = rest.slice(last)
    if rest is not None:
        yield rest


def _each_region(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, slice]]:
    """(documents, components, sketches, tree, rows of the table) of every region with at least two documents."""
    key, doc, tree = (table.column(c).to_numpy() for c in ("key", "doc", "tree"))
    comp = table.column("comp").to_numpy()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, MINIMA)
    cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a > 1:
            yield doc[a:b], comp[a:b], sketch[a:b], int(tree[a]), slice(a, b)


def _neighbour_batches(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """For each document of a region its best neighbour in the tree's order, and the region's first document."""
    for table in _regions(batches):
        out = []
        for doc, _, sketch, tree, _ in _each_region(table):
            turned = np.roll(sketch, -tree * forest.depth, axis=1)
            order = np.lexsort([doc, *turned.T[::-1]]) if len(doc) > 2 else np.arange(len(doc))
            d, s = doc[order], sketch[order]
            n = len(d)
            best, mate = np.full(n, -1), np.zeros(n, dtype=np.int64)
            for k in range(1, min(NEIGHBOURS, n - 1) + 1):
                equal = (s[k:] == s[:-k]).sum(axis=1)
                for mine, other in ((slice(k, None), slice(None, n - k)), (slice(None, n - k), slice(k, None))):
                    better = equal > best[mine]
                    best[mine] = np.where(better, equal, best[mine])
                    mate[mine] = np.where(better, d[other], mate[mine])
            out.append(np.stack([d, mate, best]))
        if out:
            a, b, est = np.concatenate(out, axis=1)
            ok = est >= forest.equal
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(est[ok])], names=["a", "b", "equal"])


def _near(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _joining_links(doc, comp, sketch, tree, keys, part, across, size, common, sets, percent: int, least: int) -> list[tuple[int, int]]:
    """Links that join the components of one region, each confirmed on full sets; at most one less than there are.

    All pairs in different components are looked at, each in the first tree in which the two share a region, and with
    ``across`` only those of different parts. A link that is found joins two components at once, so that none of their
    other pairs is compared."""
    label = np.unique(comp, return_inverse=True)[1]
    links = []
    for i in range(len(doc) - 1):
        later = slice(i + 1, None)
        shared = np.minimum(common[later], common[i])  # at most
        can = (label[later] != label[i]) & (100 * shared >= percent * (size[later] + size[i] - shared))
        if across:
            can &= part[later] != part[i]
        at = np.flatnonzero(can) + i + 1
        if tree and len(at):
            at = at[~(keys[at, :tree] == keys[i, :tree]).any(axis=1)]
        if not len(at):
            continue
        equal = (sketch[at] == sketch[i]).sum(axis=1)
        at, equal = at[equal >= least], equal[equal >= least]
        for j in at[np.argsort(-equal, kind="stable")].tolist():
            if label[j] != label[i] and _near(sets[i], sets[j], percent):
                links.append((int(doc[i]), int(doc[j])))
                label[label == label[j]] = label[i]
    return links


def _joining_batches(batches: Iterator[pa.RecordBatch], percent: int, least: int) -> Iterator[pa.RecordBatch]:
    for table in _regions(batches):
        column = {c: table.column(c).to_numpy() for c in ("size", "common", "part", "across")}
        shingles, keys = (table.column(c).combine_chunks() for c in ("shingles", "regions"))
        for doc, comp, sketch, tree, rows in _each_region(table):
            if (comp == comp[0]).all():
                continue
            sets = [shingles[k].values.to_numpy() for k in range(rows.start, rows.stop)]
            key = np.stack([keys[k].values.to_numpy() for k in range(rows.start, rows.stop)])
            own = {c: v[rows] for c, v in column.items()}
            found = _joining_links(doc, comp, sketch, tree, key, own["part"], bool(own["across"][0]), own["size"], own["common"], sets, percent, least)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _confirm_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            ok.append(_near(x.values.to_numpy(), y.values.to_numpy(), percent))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share ``percent`` of their union; sets: (doc_id, shingles)."""
    side = lambda c, v: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(v))
    sizes = F.size("x").alias("nx"), F.size("y").alias("ny")
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y", *sizes)
    near = both.filter("100 * least(nx, ny) >= %d * greatest(nx, ny)" % percent).select("a", "b", "x", "y")
    return near.mapInArrow(partial(_confirm_batches, percent=percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and kept (doc_id = component_id) of every row.

    * Words: A-Z lower-cased runs of all but space and 0x09-0x0D; a set has the distinct 5-word shingles, or the whole
      sequence of a text of 1 to 4 words. Links: 100 * intersection >= percent * union, on whole sets.
    * A text that is null, empty or without words has 0 shingles and links with nothing: its component is itself.
    * A row with a null doc_id links with nothing; its component_id and kept are null. Repeated rows of a doc_id are
      each returned, as the same document. Other columns are not read; an empty table gives an empty result.
    """
    forest = forest_of(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(texts.mapInArrow(partial(_sign_batches, forest=forest), "doc_id long, n_shingles long, f1 long, f2 long, regions array<long>, deep array<long>, sketch binary"), "signatures")
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "f1", "f2"]
    classes = known.groupBy(*same).agg(F.min("doc_id").alias("first"))
    firsts = known.join(classes.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rows = firsts.select(F.col("doc_id").alias("doc"), "deep", "sketch", F.posexplode("regions").alias("tree", "key"))
    # Regions of two documents or more, by keys alone; then the sketches of their documents.
    crowded = rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("doc").alias("lead"), F.max("doc").alias("last")).filter("lead < last")
    parts = F.ceil(F.col("rows") / REGION_ROWS)
    large = F.col("rows") > REGION_ROWS
    region = (rows.join(crowded, "key").withColumn("deep", F.when(large, F.col("deep")[F.col("tree")]))
              .select("key", "tree", "doc", "sketch", "rows", "lead", "deep", F.when(large, F.pmod(F.xxhash64("doc", "key"), parts)).alias("part")))
    region = written(region, "regions")
    members = region.select(F.col("doc").alias("doc_id")).distinct()
    # Shuffled at every size, as the members grow with the documents.
    sets = written(texts.join(members.hint("merge"), "doc_id", "left_semi").mapInArrow(_set_batches, "doc_id long, shingles array<long>"), "sets")

    pair = ["least(a, b) as a", "greatest(a, b) as b"]
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key")
    run = F.when(large, F.xxhash64("deep", "part")).otherwise(F.col("key")).alias("key")
    best = (by_key(region.select(run, "tree", "doc", F.col("doc").alias("comp"), "sketch")).mapInArrow(partial(_neighbour_batches, forest=forest), "a long, b long, equal long")
            .groupBy("a").agg(F.max_by("b", F.struct("equal", -F.col("b"))).alias("b")))
    leads = region.filter(large).filter("doc <> lead").select(F.col("doc").alias("a"), F.col("lead").alias("b"))
    links = written(confirmed(best.union(leads).selectExpr(*pair).distinct(), sets, percent), "links")

    component = written(connected_components(links), "components")

    # Regions of several components: all their pairs in different ones that the bounds admit, inside the region's tasks.
    of = region.join(component.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc"))
    mixed = of.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y")
    undecided = written(of.join(mixed, "key", "left_semi").select("key", "tree", "doc", "comp", "sketch"), "undecided")

    # Shingles that no other document of such a region has: they bound what a pair can share.
    open_sets = sets.withColumnRenamed("doc_id", "doc").join(undecided.select("doc").distinct(), "doc", "left_semi")
    alone = (open_sets.select("doc", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("doc").alias("doc"))
             .filter("n = 1").groupBy("doc").agg(F.count("*").alias("alone")))
    size = F.size("shingles").cast("long")
    held = open_sets.join(alone, "doc", "left").select("doc", "shingles", size.alias("size"), (size - F.coalesce("alone", F.lit(0))).alias("common"))
    held = held.filter(F.col("common") * 100 >= F.col("size") * percent)  # else most of its shingles are nobody else's
    held = written(held.join(firsts.select(F.col("doc_id").alias("doc"), "regions"), "doc"), "open")

    # A region whose sets are more than a task should hold is dealt out to parts, and every two parts meet.
    rows = undecided.join(held.select("doc", "size"), "doc")
    weight = rows.groupBy("key").agg(F.ceil(F.sum("size") / REGION_SHINGLES).alias("parts"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    rows = rows.drop("size").join(weight.filter("x < y").select("key", "parts"), "key").withColumn("part", F.pmod(F.xxhash64("doc", "key"), F.col("parts")))
    rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    two = F.xxhash64("key", F.least("part", "mate"), F.greatest("part", "mate"))
    # Under the key of two different parts all rows are ``across``, under that of one part none is.
    rows = rows.select(F.when(F.col("parts") == 1, F.col("key")).otherwise(two).alias("key"), "tree", "doc", "comp", "sketch", "part", (F.col("part") != F.col("mate")).alias("across"))
    met = by_key(rows.join(held, "doc"))
    more = written(met.mapInArrow(partial(_joining_batches, percent=percent, least=forest.equal), "a long, b long"), "links")
    if not more.isEmpty():
        # Components are joined by the new links between them; documents without a link so far are their own.
        old = component.union(more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                              .join(component, "node", "left_anti").select("node", F.col("node").alias("component")))
        named = lambda c: old.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
        merged = connected_components(more.join(named("a"), "a").join(named("b"), "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")))
        new = old.join(merged.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
        component = written(new.select("node", F.coalesce("now", "component").alias("component")), "components")
    of_class = classes.join(component.withColumnRenamed("node", "first"), "first", "left").select(*same, F.coalesce("component", "first").alias("component"))
    joined = signed.select("doc_id", *same).join(of_class, same, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
