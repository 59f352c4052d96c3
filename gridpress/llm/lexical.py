"""Ranked lexical search of many items at once, sharing what they have in common.

Method. Spark mines the items' shared term sets: terms held by exactly the same
items form one set. Further sharing is mined pair by pair: the two sets (or
earlier unions) that most items hold together become one node, until no pair
is shared. The result is a DAG whose leaves are term sets and whose nodes are
unions of two, used by all items above them. For each slice of documents a
task makes the leaves' accumulators (scores per document) once, adds them up
along the DAG, each node once, and reads every item's scores off its last
nodes. Tasks keep the best ``k`` documents per item; Spark merges them.

Scores. With N documents that have terms, L terms in all, n terms in the
document and df documents that hold a term, a term weighs
w = floor(1000 ln((2N+2)/(2df+1))) and adds
w * ((10^9 tf) div (1000 tf + 20 m)), m = 50 + (50 n N) div L.

Passes. Documents are read once per block of items: occurrences of the items'
terms are written as short rows, counted for df, N and L, and scored. Items are
taken in blocks of ``ITEM_BYTES`` of text, so vocabulary, weights and DAG have
a bound; a task holds one slice of rows and k rows per item of the block. The
merge goes in two steps, so no task reads all tasks' rows of an item at once.
Terms are told apart by 64-bit hashes.

Edge cases. Null or termless texts match nothing and do not count in N; null or
termless items have no rows. Repeated documents are ranked each; equal scores
by ascending id, null ids last. Repeated items are answered each. Very long
texts are counted whole. Empty tables give an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridpress.llm import words
from gridpress.session import stage
from workloads.base import Registry, Tables

R = Registry()

ITEM_BYTES = 1 << 20
SLICE_ROWS = 1024
#: Groups in which an item's candidates of different tasks are first merged.
MERGE_PARTS = 64


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct term hashes of each item."""
    for batch in batches:
        for row, end, data, offsets in words.slices(batch["text"]):
            cut = words.split(data, offsets, words.NOT_ALNUM)
            terms, of = cut.hashes().view(np.int64), cut.text_of()
            keys = batch["item"].slice(row, end - row).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([keys, pa.array(terms)], ["item", "term"])


def shared_sets(terms: DataFrame) -> DataFrame:
    """(items, terms): the terms (item, term) that exactly the same items hold."""
    held = terms.distinct().groupBy("term").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return held.groupBy("items").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def sharing_dag(holders: list[list[int]], items: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(unions, last nodes of each item) over leaves whose holding items are given.

    Node ``len(holders) + i`` is the union of the two nodes of ``unions[i]``.
    """
    nodes: list[set[int]] = [set() for _ in range(items)]
    for leaf, held in enumerate(holders):
        for item in held:
            nodes[item].add(leaf)
    unions: list[tuple[int, int]] = []
    while True:
        pairs = np.array([p for held in nodes for p in combinations(sorted(held), 2)], np.int64).reshape(-1, 2)
        distinct, n = np.unique(pairs, axis=0, return_counts=True)
        best = np.argsort(-n, kind="stable")
        used: set[int] = set()
        made: dict[int, list[tuple[int, int]]] = {}
        # One round takes pairs that do not touch each other and are shared about as much as the best.
        for i in best[n[best] >= max(2, int(n.max(initial=0)) // 2)]:
            u, v = (int(x) for x in distinct[i])
            if u not in used and v not in used:
                used |= {u, v}
                made.setdefault(u, []).append((v, len(holders) + len(unions)))
                unions.append((u, v))
        if not made:
            return unions, [sorted(held) for held in nodes]
        for held in nodes:
            for u in sorted(held & made.keys()):
                for v, new in made[u]:
                    if u in held and v in held:
                        held -= {u, v}
                        held.add(new)


def _occurrences(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Short rows of the documents that hold a wanted term; at the end, what the task has counted."""
    wanted = vocabulary.value
    docs = total = 0
    held = np.zeros(len(wanted), np.int64)
    names = ["doc_id", "n", "terms", "counts", "docs", "total"]
    for batch in batches:
        for row, end, data, offsets in words.slices(batch["text"]):
            cut = words.split(data, offsets, words.NOT_ALNUM)
            n = np.diff(cut.first)
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            hashes = cut.hashes()
            at = np.minimum(np.searchsorted(wanted, hashes), max(len(wanted) - 1, 0))
            met = np.flatnonzero(wanted[at] == hashes) if len(wanted) else np.zeros(0, np.int64)
            code, counts = np.unique(cut.text_of()[met] * max(len(wanted), 1) + at[met], return_counts=True)
            doc, term = np.divmod(code, max(len(wanted), 1))
            held += np.bincount(term, minlength=len(wanted))
            some, first = np.unique(doc, return_index=True)
            bounds = pa.array(np.append(first, len(doc)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (term, counts)]
            ids = batch["doc_id"].slice(row, end - row).take(pa.array(some))
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n[some], pa.int64()), *lists, none, none], names)
    # The task's own sums: documents per wanted term, documents and terms in all.
    term = np.flatnonzero(held)
    sums = [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([term], pa.list_(pa.int32())), pa.array([held[term]], pa.list_(pa.int32()))]
    yield pa.RecordBatch.from_arrays([*sums, pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names)


class _Best:
    """The k best documents of one item so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.doc, self.void = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, score: np.ndarray, doc: np.ndarray, void: np.ndarray) -> None:
        least = max(1, int(self.score[-1])) if len(self.score) == self.k else 1
        at = np.flatnonzero(score >= least)
        if not len(at):
            return
        both = [np.concatenate(p) for p in ((self.score, score[at]), (self.doc, doc[at]), (self.void, void[at]))]
        order = np.lexsort((both[1], both[2], -both[0]))[: self.k]
        self.score, self.doc, self.void = (x[order] for x in both)


def _scored(batches: Iterator[pa.RecordBatch], plan, k: int) -> Iterator[pa.RecordBatch]:
    leaf_of, weight, leaves, unions, items, last, docs, total = plan.value
    best = [_Best(k) for _ in last]
    for batch in batches:
        for row in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(row, SLICE_ROWS)
            size = part.num_rows
            lists = part["terms"]
            of = np.repeat(np.arange(size), np.diff(lists.offsets.to_numpy()))
            term, tf = lists.flatten().to_numpy(), part["counts"].flatten().to_numpy().astype(np.int64)
            m = 50 + (50 * part["n"].to_numpy() * docs) // total
            each = weight[term] * ((10**9 * tf) // (1000 * tf + 20 * m[of]))
            # Leaves' accumulators, made once; a node whose one side has no document is the other side.
            order = np.argsort(leaf_of[term], kind="stable")
            leaf, of, each = leaf_of[term][order], of[order], each[order]
            held: list[np.ndarray | None] = [None] * (leaves + len(unions))
            bound = np.searchsorted(leaf, np.arange(leaves + 1))
            for i in np.flatnonzero(np.diff(bound)):
                held[i] = np.zeros(size, np.int64)
                np.add.at(held[i], of[bound[i] : bound[i + 1]], each[bound[i] : bound[i + 1]])
            for i, (u, v) in enumerate(unions, leaves):
                held[i] = held[v] if held[u] is None else held[u] if held[v] is None else held[u] + held[v]
            ids = part["doc_id"]
            void = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for item, nodes in enumerate(last):
                parts = [held[x] for x in nodes if held[x] is not None]
                if parts:
                    best[item].offer(parts[0] if len(parts) == 1 else np.sum(parts, 0), ids, void)
    size = [len(b.score) for b in best]
    if sum(size):
        columns = [np.concatenate([getattr(b, c) for b in best]) for c in ("doc", "void", "score")]
        item = np.repeat(np.array(items, np.int64), size)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(columns[0], mask=columns[1]), pa.array(columns[2])], ["item", "doc_id", "score"])


def _block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame | None:
    """(item, doc_id, score): candidates of a block's items, at most k per item and task."""
    spark = docs.sparkSession
    sets = shared_sets(terms).collect()  # ITEM_BYTES of items at most
    if not sets:
        return None
    items = sorted({i for s in sets for i in s["items"]})
    number = {item: i for i, item in enumerate(items)}
    unions, last = sharing_dag([[number[i] for i in s["items"]] for s in sets], len(items))
    pairs = sorted((np.int64(t).view(np.uint64), leaf) for leaf, s in enumerate(sets) for t in s["terms"])
    vocabulary = np.array([t for t, _ in pairs], np.uint64)
    leaf_of = np.array([leaf for _, leaf in pairs], np.int64)

    schema = "doc_id bigint, n bigint, terms array<int>, counts array<int>, docs bigint, total bigint"
    rows = stage(docs.mapInArrow(partial(_occurrences, vocabulary=spark.sparkContext.broadcast(vocabulary)), schema), "occurrences")
    told = rows.filter("docs is not null")
    n_docs, total = (x or 0 for x in told.agg(F.sum("docs"), F.sum("total")).first())
    df = np.zeros(len(vocabulary))
    each = told.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts"))
    for term, count in each.collect():  # a row per wanted term
        df[term] = count
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * x + 1))) for x in df], np.int64)
    plan = spark.sparkContext.broadcast((leaf_of, weight, len(sets), unions, items, last, n_docs, max(total, 1)))
    return rows.filter("docs is null").mapInArrow(partial(_scored, plan=plan, k=k), "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 50, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``k`` best rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Columns: item_id, rank (from 1), doc_id, score; only scores above 0.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select("item_id", "text").withColumn("item", F.xxhash64("item_id", "text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    terms = stage(items.select("item", "text").mapInArrow(_terms, "item bigint, term bigint").distinct(), "item-terms")
    each = [_block(docs, terms.filter(F.pmod("item", F.lit(blocks)) == b), k) for b in range(blocks)]
    found = spark.createDataFrame([], "item bigint, doc_id bigint, score bigint")
    for part in each:
        found = found if part is None else found.union(part)
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))
    found = found.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("item", "part").orderBy(*best))).filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= k)
    return items.select("item_id", "item").join(found, "item").select("item_id", "rank", "doc_id", "score")


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL = f"""
with d as (select row_number() over () r, doc_id, {_TERMS} w from documents),
q as (select row_number() over () i, item_id, {_TERMS} w from benchmark),
c as (select count(*) filter (len(w) > 0) big, sum(len(w))::bigint total from d),
t as (select distinct i, unnest(w) term from q),
v as (select distinct term from t),
u as (select r, doc_id, len(w) n, unnest(w) term from d),
f as (select r, any_value(doc_id) doc_id, any_value(n) n, term, count(*) tf from u where term in (select term from v) group by r, term),
k as (select term, floor(1000 * ln((2 * big + 2)::double / (2 * count(*) + 1)))::bigint weight from f, c group by term, big),
s as (select i, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big) // total))))::bigint score
      from t join f using (term) join k using (term), c group by i, r, doc_id),
o as (select *, row_number() over (partition by i order by score desc, doc_id) place from s where score > 0)
select item_id, place::int as rank, doc_id, score from o join q using (i) where place <= 50
"""


@R.add(SQL)
def op13_lexical_search(t: Tables) -> DataFrame:
    """The fifty best documents for every benchmark item."""
    return search(t.documents, t.benchmark)
