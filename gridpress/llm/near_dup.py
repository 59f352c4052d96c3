"""MinHash near-duplicates by an LSH forest, links confirmed on full shingle sets.

Method. A document's words become a set of shingle hashes; equal sets are one
class. Each class has ``trees`` signature orders of ``depth`` minhash values.
Within an order, classes whose signatures share a prefix form a region: the
region is as shallow as ``min_depth`` where few classes meet, and as deep as
``depth`` where many do. Regions are read in signature order, so neighbours
with the longest common prefix meet first; a region yields a spanning forest
of the classes whose whole signatures agree enough, never all its pairs. The
forests' components are candidate groups; inside each, links are decided on
the full sets, through one inverted list per group.

Crowds. A region above ``REGION_ROWS`` goes to full depth, and beyond that is
dealt out in parts that all hold the region's first class. That may part a
pair, so all classes of such regions are joined a second time, without loss: a
class's rarest shingles, a few more than the share in which two linked sets
may differ, must hold one that both have. Classes that share one of them, and
are not in one candidate group already, are compared by whole signatures as
in a region. How rare a shingle is comes from a table of ``COUNTERS`` sums;
any order would do, as long as it is the same for all.

Skew. Exact copies meet in one class before anything is compared. Lists of
classes above ``REGION_ROWS`` are cut into chunks of which every pair is one
unit of work. A candidate group above
``GROUP_SHINGLES`` is cut into chunks and every pair of chunks is one unit of
work, so no link is lost and no task holds a whole large group.

Recall. Two classes of Jaccard similarity s miss each other with probability
(1 - s**min_depth)**trees, crowded or not: 8e-6 at s = 0.85, 2e-4 at 0.8.
Signatures too far apart by chance (``SLACK``) add some 3e-6. Shingles and classes are told apart by 64-bit hashes.

Edge cases. Null or blank text: empty set, linked with nothing. Very long
texts: their whole sets, a text at a time. Repeated rows
and equal ids: every row is answered; equal sets share a component. Null ids:
the row stays, and the smallest non-null id names the component. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.llm import words
from gridpress.llm.filters import FILTER_BITS, filter_of
from gridpress.llm.graph import components
from gridpress.session import stage
from workloads.base import Registry, Tables

R = Registry()

REGION_ROWS = 2048
GROUP_SHINGLES = 2_000_000
#: A pair of signatures this far (in standard errors) below the threshold is no candidate.
SLACK = 4.5
#: A group this large is cut into up to ``GROUP_PARTS``, so that one task does not hold it all.
PART_SHINGLES, GROUP_PARTS = 1 << 16, 4
#: Sums by which shingles of crowded classes are ordered.
COUNTERS = 1 << 20


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    a = rng.integers(1 << 62, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingles, starts): sorted distinct shingle hashes of runs of rows."""
    for row, end, data, offsets in words.slices(column):
        cut = words.split(data, offsets)
        grams, at = words.gram_hashes(cut.hashes(), cut.first, width)
        order = np.lexsort((grams, at))
        grams, at = grams[order], at[order]
        keep = np.ones(len(grams), bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (at[1:] != at[:-1])
        grams, at = grams[keep], at[keep]
        yield row, grams, np.searchsorted(at, np.arange(end - row + 1))


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


@words.giving_back
def _sketch(batches: Iterator[pa.RecordBatch], width: int, values: int) -> Iterator[pa.RecordBatch]:
    a, b = _coefficients(values)
    for batch in batches:
        for row, grams, starts in _sets(batch["text"], width):
            sizes = np.diff(starts)
            full = np.flatnonzero(sizes)
            signature = np.empty((len(full), values), np.uint32)
            if len(full):
                for k in range(values):
                    least = np.minimum.reduceat(grams * a[k] + b[k], starts[:-1][full])
                    signature[:, k] = least >> np.uint64(32)
            nodes: list[int | None] = [None] * len(sizes)
            rows: list[bytes | None] = [None] * len(sizes)
            for k, i in enumerate(full):
                nodes[i] = _node(grams[starts[i] : starts[i + 1]])
                rows[i] = signature[k].byteswap().tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(row, len(sizes)),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(rows, pa.binary()),
                ],
                ["doc_id", "n_shingles", "node", "signature"],
            )


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.left = n

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        self.left -= 1
        return True


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables holding whole groups of a stream sorted by ``keys``; a group cut by a batch is carried over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch[k][batch.num_rows - 1].as_py() for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, value in zip(keys, last, strict=True):
            same &= batch[k].to_numpy(zero_copy_only=False) == value
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and [held[-1][k][0].as_py() for k in keys] != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(table.num_rows, bool)
    changed[0] = True
    for k in keys:
        column = table[k].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(changed), table.num_rows)


def _fixed(column: pa.ChunkedArray, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(rows, width)


@words.giving_back
def _neighbours(batches: Iterator[pa.RecordBatch], values: int, floor: float, ratio: float) -> Iterator[pa.RecordBatch]:
    """Spanning forest of each region's similar classes, nearest in signature order first."""
    for table in _runs(batches, ["region", "part"]):
        n = table.num_rows
        sig = _fixed(table["signature"], n, values)
        node, size = table["node"].to_numpy(), table["n_shingles"].to_numpy()
        need = floor * values

        def alike(i, others, sig=sig, size=size, need=need):
            small, large = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
            return ((sig[i] == sig[others]).sum(-1) >= need) & (small >= ratio * large)

        bounds = _bounds(table, ["region", "part"])
        inner = np.ones(n, bool)
        inner[bounds[:-1]] = False
        second = np.flatnonzero(inner)
        # What is known to be one group needs no link.
        same = np.zeros(n, bool)
        if "label" in table.column_names:
            label = table["label"].to_numpy()
            same[1:] = inner[1:] & (label[1:] == label[:-1])
        hit = np.concatenate([alike(c - 1, c) for c in np.array_split(second, len(second) // 4096 + 1)]) if len(second) else np.zeros(0, bool)
        near = second[hit & ~same[second]]
        edges = [np.stack([node[near - 1], node[near]], 1)]
        joined = same.copy()
        joined[near] = True
        missing = np.add.reduceat((inner & ~joined).astype(np.int64), bounds[:-1])
        for g in np.flatnonzero((missing > 0) & (np.diff(bounds) > 2)):
            lo, hi = bounds[g], bounds[g + 1]
            runs = np.cumsum(~joined[lo:hi] | (np.arange(hi - lo) == 0)) - 1
            forest, more = _Forest(int(runs[-1]) + 1), []
            members = np.arange(lo, hi)
            for i in range(hi - lo - 1):
                if forest.left == 1:
                    break
                later = members[i + 1 :][runs[i + 1 :] != runs[i]]
                for j in later[alike(lo + i, later)]:
                    if forest.join(int(runs[i]), int(runs[j - lo])):
                        more.append((node[lo + i], node[j]))
            if more:
                edges.append(np.array(more, np.int64))
        pairs = np.concatenate(edges)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


@words.giving_back
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's occurrences per counter, in 64 parts."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for one in batch["shingles"]:
            total += np.bincount(_slot(np.frombuffer(one.as_buffer(), np.uint64)), minlength=COUNTERS)
    parts = np.split(total, 64)
    yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"])
    return pa.table({"part": table["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


@words.giving_back
def _rarest(batches: Iterator[pa.RecordBatch], counts, percent: int) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each set: one more than may be missing from a set that is linked with it."""
    of = np.frombuffer(counts.value, np.int64)
    for batch in batches:
        parts = []
        for one in batch["shingles"]:
            grams = np.frombuffer(one.as_buffer(), np.uint64)
            keep = len(grams) - -(-percent * len(grams) // 100) + 1
            parts.append(grams[np.lexsort((grams, of[_slot(grams)]))[:keep]])
        at = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
        flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat), batch["node"].take(at), batch["label"].take(at)], ["shingle", "node", "label"])


@words.giving_back
def _wanted_sets(batches: Iterator[pa.RecordBatch], width: int, wanted) -> Iterator[pa.RecordBatch]:
    bits = np.frombuffer(wanted.value, np.uint8)
    seen: set[int] = set()
    for batch in batches:
        slot = batch["slot"].to_numpy()
        batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7)) & 1 == 1))
        for _, grams, starts in _sets(batch["text"], width):
            nodes, sets = [], []
            for i in range(len(starts) - 1):
                one = grams[starts[i] : starts[i + 1]]
                if len(one) and (node := _node(one)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(one.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])


@words.giving_back
def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning forest of each candidate group's confirmed links."""
    for table in _runs(batches, ["label", "one", "two"]):
        bounds = _bounds(table, ["label", "one", "two"])
        node = table["node"].to_numpy()
        chunk, one, two = (table[k].to_numpy() for k in ("chunk", "one", "two"))
        column, links = table["shingles"].combine_chunks(), []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            sets = [np.frombuffer(column[i].as_buffer(), np.uint64) for i in range(lo, hi)]
            links += [(node[lo + i], node[lo + j]) for i, j in confirmed(sets, percent, chunk[lo:hi] if one[lo] != two[lo] else None)]
        pairs = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def confirmed(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of pairs with 100 * |a & b| >= percent * |a | b|; with ``side``, of pairs across sides."""
    n = len(sets)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets])
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(inverse, kind="stable")
    lists = owner[order]
    start = np.searchsorted(inverse[order], np.arange(inverse.max() + 2))
    edge = np.concatenate([[0], np.cumsum(size)])
    forest, links = _Forest(n), []
    for i in range(n - 1):
        if forest.left == 1:
            break
        grams = inverse[edge[i] : edge[i + 1]]
        lo, count = start[grams], start[grams + 1] - start[grams]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        both = np.bincount(lists[at], minlength=n)
        linked = 100 * both >= percent * (size[i] + size - both)
        linked[: i + 1] = False
        if side is not None:
            linked &= side != side[i]
        links += [(i, int(j)) for j in np.flatnonzero(linked) if forest.join(i, int(j))]
    return links


def _sets_of(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the classes of ``members`` (first_id) and of some others."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(members.select(F.xxhash64("first_id").alias("key"))))  # of fixed size
    slotted = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("slot"))
    return slotted.mapInArrow(partial(_wanted_sets, width=width, wanted=bits), "node bigint, shingles binary")


def _crowd_placed(docs: DataFrame, crowd: DataFrame, width: int, percent: int) -> DataFrame:
    """(region, part, node, label): classes of ``crowd`` that share one of their rarest shingles, across labels."""
    sets = _sets_of(docs, crowd, width).join(crowd.select("node", "label"), "node").dropDuplicates(["node"])
    sets = stage(sets, "crowd-sets")
    counted = sets.select("shingles").mapInArrow(_counted, "part int, counts binary")
    parts = counted.groupBy("part").applyInArrow(lambda rows: _added(rows), "part int, counts binary").collect()  # 8 * COUNTERS bytes
    counts = docs.sparkSession.sparkContext.broadcast(b"".join(bytes(p.counts) for p in sorted(parts, key=lambda p: p.part)))
    rare = stage(sets.mapInArrow(partial(_rarest, counts=counts, percent=percent), "shingle bigint, node bigint, label bigint"), "rarest")
    lists = rare.groupBy("shingle").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), (F.min("label") != F.max("label")).alias("mixed"))
    # Shingles that the same classes share count once.
    lists = lists.filter("mixed").groupBy("n", "members").agg(F.min("shingle").alias("shingle"))
    placed = rare.join(lists.select("shingle", "n"), "shingle")
    chunks = F.when(F.col("n") <= REGION_ROWS, F.lit(1)).otherwise(F.ceil(2 * F.col("n") / REGION_ROWS)).cast("int")
    placed = placed.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node", "shingle"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    part = F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")
    return placed.select(F.xxhash64("shingle", F.lit("crowd")).alias("region"), part.alias("part"), "node", "label").distinct()


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, trees: int = 16, depth: int = 8, min_depth: int = 4
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, class_id.

    Rows are linked when 100 * |a & b| >= percent * |a | b| over their sets of
    ``width``-word shingles; ``component_id`` is the smallest doc_id reachable,
    ``kept`` marks the row that carries it.
    """
    values = trees * depth
    share = percent / 100
    floor = share - SLACK * (share * (1 - share) / values) ** 0.5
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = stage(
        docs.mapInArrow(
            partial(_sketch, width=width, values=values),
            f"doc_id {kind}, n_shingles bigint, node bigint, signature binary",
        ),
        "sketch",
    )
    classes = sketch.filter("node is not null").groupBy("node", "n_shingles").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"))
    classes = stage(classes, "classes")

    prefix = lambda d: F.xxhash64("tree", F.substring("signature", F.col("tree") * depth * 4 + 1, F.lit(d * 4)))
    rows = classes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = rows.select("node", "tree", prefix(min_depth).alias("shallow"), prefix(depth).alias("deep"))
    met = rows.groupBy("shallow").agg(F.count("*").alias("n")).filter("n > 1")
    regions = stage(rows.join(met, "shallow"), "regions")
    dense = regions.filter(F.col("n") > REGION_ROWS).groupBy("deep").agg(F.count("*").alias("m"), F.min("node").alias("anchor")).filter("m > 1")
    plain = regions.filter(F.col("n") <= REGION_ROWS).select("node", "tree", F.col("shallow").alias("region"), F.lit(0).alias("part"))
    parts = F.ceil(F.col("m") / REGION_ROWS).cast("int")
    crowded = regions.filter(F.col("n") > REGION_ROWS).join(dense, "deep")
    dealt = crowded.select("node", "tree", F.col("deep").alias("region"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    anchors = crowded.filter("node = anchor").select("node", "tree", F.col("deep").alias("region"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    placed = plain.union(dealt.union(anchors).distinct())

    # The signature turns so that its own tree's values come first: regions are then read in forest order.
    turned = F.concat(F.expr(f"substring(signature, tree * {depth * 4} + 1)"), F.expr(f"substring(signature, 1, tree * {depth * 4})"))
    placed = placed.join(classes, "node").select("region", "part", "node", "n_shingles", turned.alias("signature"))
    placed = placed.repartition("region", "part").sortWithinPartitions("region", "part", "signature", "node")
    candidates = placed.mapInArrow(partial(_neighbours, values=values, floor=floor, ratio=share), "a bigint, b bigint")
    groups = components(candidates)

    crowd = regions.filter(F.col("n") > REGION_ROWS).select("node").distinct().join(classes.select("node", "first_id"), "node")
    crowd = stage(crowd.join(groups, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label")), "crowd")
    if not crowd.isEmpty():
        placed = _crowd_placed(docs, crowd, width, percent).join(classes.select("node", "n_shingles", "signature"), "node")
        placed = placed.repartition("region", "part").sortWithinPartitions("region", "part", "label", "signature", "node")
        more = placed.mapInArrow(partial(_neighbours, values=values, floor=floor, ratio=share), "a bigint, b bigint")
        groups = components(groups.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))

    members = stage(groups.join(classes.select("node", "n_shingles", "first_id"), "node"), "members")
    sets = _sets_of(docs, members, width)

    few = F.least(F.lit(GROUP_PARTS), F.ceil(F.col("total") / PART_SHINGLES))
    chunks = F.greatest(few, F.ceil(F.col("total") / GROUP_SHINGLES))
    sizes = members.groupBy("label").agg(F.sum("n_shingles").alias("total")).withColumn("chunks", chunks.cast("int"))
    placed = members.join(sizes, "label").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("node", "label", "chunk", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"))
    placed = placed.join(sets, "node").dropDuplicates(["node", "one", "two"])
    placed = placed.repartition("label", "one", "two").sortWithinPartitions("label", "one", "two", "node")
    joined = components(placed.mapInArrow(partial(_links, percent=percent), "a bigint, b bigint"))

    known = sketch.select("doc_id", "n_shingles", "node").join(joined, "node", "left")
    known = known.withColumn("class_id", F.coalesce("label", "node"))
    least = stage(known.filter("node is not null").groupBy("class_id").agg(F.min("doc_id").alias("least")), "least")
    known = known.join(least, "class_id", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return known.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "class_id")


@R.add()
def op3_near_duplicates(t: Tables) -> DataFrame:
    """Three-word shingles, similarity 0.85, over all documents."""
    return near_duplicates(t.documents, width=3, percent=85)
