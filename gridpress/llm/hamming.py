"""Exact top-k search of binary codes by incremental multi-index hashing.

Method. A vector's code is the signs of its elements, cut into segments of
``SEGMENT`` bits; the index holds each distinct code under each of its segment
values. Round a probes every segment with all masks of exactly a bits, so that
after it each code within distance m * (a + 1) - 1 of the query (m segments)
has been met: farther codes differ by more than a bits in every segment.
Candidates are verified on whole codes inside the tasks that meet them, and a
task sends on no more than k per query, none beyond the k-th distance known from
earlier rounds; a query stops once its k-th verified
distance is covered, and goes on otherwise. The answer is exact.

Skew. Equal codes are one index entry that carries at most their k smallest
ids, since no more can be among a query's k nearest; they are cut down before
the shuffle. A common segment value has its codes in several lists. Only unfinished queries are probed again. The driver learns only
whether any is left.

Edge cases. Ties go to the smaller id. A null vector has no code: it neither
asks nor is found; null elements and missing trailing ones are zero bits. A
query is found by itself like any other row. Rows with equal ids are all
found; equal query ids ask once for each distinct code. Fewer rows than k give
fewer answers; an empty table none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpress.session import stage
from workloads.base import Registry, Tables

R = Registry()

SEGMENT = 16
#: Codes in one list of the index.
LIST_ROWS = 1024


def codes(vectors: DataFrame, bits: int) -> DataFrame:
    """(id, code): the signs of ``embedding`` as an array of segment values."""
    def segment(j: int) -> Column:
        one = lambda i: F.when(F.get("embedding", F.lit(i)) > 0, 1 << (i % SEGMENT)).otherwise(0)
        return sum((one(i) for i in range(j * SEGMENT + 1, min(bits, (j + 1) * SEGMENT))), one(j * SEGMENT))

    segments = [segment(j) for j in range(-(-bits // SEGMENT))]
    return vectors.filter("embedding is not null").select(F.col("vec_id").alias("id"), F.array(*segments).alias("code"))


def _index(classes: DataFrame) -> DataFrame:
    """(segment, value, held): the codes with a segment value, in lists of about ``LIST_ROWS``."""
    entry = F.struct("cid", "least", "code").alias("entry")
    rows = classes.select(entry, F.posexplode("code").alias("segment", "value"))
    long = rows.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") > LIST_ROWS)
    rows = rows.join(long, ["segment", "value"], "left")
    part = F.pmod(F.xxhash64("entry.cid"), F.coalesce(F.ceil(F.col("n") / LIST_ROWS), F.lit(1)))
    return rows.groupBy("segment", "value", part.alias("part")).agg(F.collect_list("entry").alias("held")).drop("part")


def _probes(batches: Iterator[pa.RecordBatch], a: int) -> Iterator[pa.RecordBatch]:
    """(ask, asked, bound, segment, value): each query's segment values under all masks of a bits."""
    masks = np.arange(1 << SEGMENT)
    masks = masks[np.bitwise_count(masks) == a]
    for batch in batches:
        for ask, asked, bound in zip(*[batch[k].to_pylist() for k in ("ask", "asked", "bound")], strict=True):
            for segment, own in enumerate(asked):
                n = len(masks)
                code = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(asked), pa.int32()), pa.array(np.tile(np.array(asked, np.int32), n)))
                columns = [pa.array(np.full(n, ask)), code, pa.array(np.full(n, bound)), pa.array(np.full(n, segment, np.int32)), pa.array((masks ^ own).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["ask", "asked", "bound", "segment", "value"])


def _verified(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    """Whole-code distances of the codes met; of each query, a batch's k nearest within its bound go on."""
    for batch in batches:
        held = batch["held"]
        size = np.diff(held.offsets.to_numpy())
        inner = held.flatten()
        cid, least, code = inner.field("cid").to_numpy(), inner.field("least"), inner.field("code").flatten().to_numpy().reshape(-1, m)
        ask = np.repeat(batch["ask"].to_numpy(), size)
        asked = np.repeat(batch["asked"].flatten().to_numpy().reshape(-1, m), size, axis=0)
        distance = np.bitwise_count(code ^ asked).sum(1, dtype=np.int64)
        # Ids are ordered nulls first, as Spark orders them.
        rank = pc.rank(least, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        near = np.flatnonzero(distance <= np.repeat(batch["bound"].to_numpy(), size))
        order = near[np.lexsort((cid[near], rank[near], distance[near], ask[near]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (ask[order][1:] != ask[order][:-1]) | (cid[order][1:] != cid[order][:-1])
        order = order[fresh]
        head = np.ones(len(order), bool)
        head[1:] = ask[order][1:] != ask[order][:-1]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        order = order[place < k]
        yield pa.RecordBatch.from_arrays([pa.array(ask[order]), pa.array(cid[order]), least.take(pa.array(order)), pa.array(distance[order])], ["ask", "cid", "least", "distance"])


def _first(rows: DataFrame, k: int, by: str) -> DataFrame:
    order = Window.partitionBy("ask").orderBy("distance", by)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, id, distance): the k rows of ``vectors`` nearest to each of ``queries`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    bits = max(vectors.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)
    m = -(-bits // SEGMENT)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    order = Window.partitionBy("code").orderBy("id")
    kept = codes(vectors, bits).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    classes = kept.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("id"))).alias("ids"))
    classes = stage(classes.select("code", "ids", F.col("ids")[0]["id"].alias("least"), F.monotonically_increasing_id().alias("cid")), "codes")
    index = stage(_index(classes), "index")
    asked = codes(queries, bits).select(F.col("id").alias("query"), F.col("code").alias("asked")).distinct()
    asked = stage(asked.withColumn("ask", F.monotonically_increasing_id()), "queries")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    active, best, answers = asked.select("ask", "asked", F.lit(bits).cast("bigint").alias("bound")), None, []
    for a in range(SEGMENT + 1):
        probes = active.repartition(parts, "ask").mapInArrow(partial(_probes, a=a), "ask bigint, asked array<int>, bound bigint, segment int, value int")
        # Probes outnumber what their size estimate says, so neither side may be broadcast.
        met = probes.join(index.hint("merge"), ["segment", "value"]).select("ask", "asked", "bound", "held")
        found = met.mapInArrow(partial(_verified, k=k, m=m), f"ask bigint, cid bigint, least {kind}, distance bigint")
        if best is not None:
            found = found.unionByName(best)
        found = stage(_first(found.dropDuplicates(["ask", "cid"]), k, "least").drop("rank"), "nearest")
        rows = found.join(classes.select("cid", F.explode("ids.id").alias("id")), "cid")
        ranked = stage(_first(rows, k, "id").select("ask", "rank", "id", "distance"), "ranked")
        covered = m * (a + 1) - 1
        if covered >= bits:
            answers.append(ranked)
            break
        full = ranked.groupBy("ask").agg(F.max("distance").alias("worst"), F.count("*").alias("n")).filter(F.col("n") == k)
        closed = full.filter(F.col("worst") <= covered).select("ask")
        answers.append(ranked.join(closed, "ask", "left_semi"))
        active = active.join(closed, "ask", "left_anti").join(full, "ask", "left")
        active = stage(active.select("ask", "asked", F.coalesce("worst", "bound").alias("bound")), "active")
        if active.isEmpty():
            break
        best = found.join(active, "ask", "left_semi")
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    out = out.join(asked.select("ask", "query"), "ask")
    return out.select("query", F.col("rank").cast("long").alias("rank"), "id", "distance")


SQL = """
with e as (select vec_id, [case when x > 0 then 1 else 0 end for x in embedding] b from embeddings where embedding is not null),
d as (select q.vec_id query, e.vec_id id, list_sum([abs(q.b[i] - e.b[i]) for i in range(1, len(q.b) + 1)])::bigint distance
      from e q join e on true where q.vec_id % 100 = 0)
select query, rank, id, distance from (select *, row_number() over (partition by query order by distance, id) rank from d) where rank <= 10
"""


@R.add(SQL)
def op8_top_k(t: Tables) -> DataFrame:
    """Ten nearest rows of every row whose id is divisible by 100."""
    vectors = t.embeddings.select("vec_id", "embedding")
    return top_k(vectors.filter("vec_id % 100 = 0"), vectors)
