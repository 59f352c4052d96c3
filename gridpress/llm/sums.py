"""Per-document sums of values that lie in a sharded table of keys.

A text's total under a linear model is a sum over its keys (words, pairs,
grams) of occurrences times the key's value. Blocks of documents pack their
keys, each with its documents and occurrences, into one posting row per shard
of the key's hash; a shard looks its keys' values up and sends back one partial
sum for each document of the block. So a frequent key costs a block at most one
entry per document, texts are never shuffled, and neither the keys nor their
values pass the driver.

Blocks are dealt into parts of ``PART_BLOCKS``; each part of a shard is a unit
of work that holds a copy of the shard's values, so no unit grows with the
number of documents. The number of shards follows that of the keys where the
caller says so (``shard_bits``); parts then hold as many more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.llm.words import give_back, mix

SHARD_BITS = 6
#: Keys of a shard, beyond which there are more of them.
SHARD_KEYS = 1 << 22
PART_BLOCKS = 512
#: Documents that a block may have: their places are 16-bit numbers.
BLOCK_ROWS = 1 << 16
#: Keys whose shards are found at a time.
PIECE = 1 << 18
#: Posting rows, beside any columns of the documents themselves.
POSTINGS = "block bigint, shard int, posting binary"


def shard_bits(keys: int) -> int:
    """Bits of the shards' numbers for a table of so many keys."""
    return max(SHARD_BITS, (max(keys - 1, 0) // SHARD_KEYS).bit_length())


def shard_of(keys: np.ndarray, bits: int = SHARD_BITS) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - bits)).astype(np.int64)


def postings(keys: np.ndarray, docs: np.ndarray, size: int, bits: int = SHARD_BITS) -> list[tuple[int, bytes]]:
    """(shard, posting) of a block of ``size`` documents from its occurrences.

    Shards are packed one after the other: beside the occurrences only their
    order by shard is held whole.
    """
    shard = np.empty(len(keys), np.min_scalar_type((1 << bits) - 1))
    for at in range(0, len(keys), PIECE):
        shard[at : at + PIECE] = shard_of(keys[at : at + PIECE], bits)
    order = np.argsort(shard, kind="stable")
    bound = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=1 << bits))])
    zip_ = zstandard.ZstdCompressor(level=1).compress
    out = []
    for s in np.flatnonzero(np.diff(bound)):
        mine = order[bound[s] : bound[s + 1]]
        distinct, at = np.unique(keys[mine], return_inverse=True)
        # Occurrences by key and document; equal ones become one entry.
        code = np.sort(at * size + docs[mine])
        head = np.ones(len(code), bool)
        head[1:] = code[1:] != code[:-1]
        first = np.flatnonzero(head)
        n = np.diff(np.append(first, len(code))).astype(np.uint32)
        key, doc = np.divmod(code[first], size)
        per_key = np.bincount(key, minlength=len(distinct)).astype(np.uint32)
        head_ = np.array([size, len(distinct), len(first)], np.uint64)
        raw = b"".join(x.tobytes() for x in (head_, distinct, per_key, n, doc.astype(np.uint16)))
        out.append((int(s), zip_(raw)))
    return out


def opened(posting: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents of the block, keys, entries per key, document and occurrences of each entry)."""
    raw = zstandard.ZstdDecompressor().decompress(posting)
    size, k, e = (int(x) for x in np.frombuffer(raw, np.uint64, 3))
    keys = np.frombuffer(raw, np.uint64, k, 24)
    small = np.frombuffer(raw, np.uint32, k + e, 24 + 8 * k)
    return size, keys, small[:k], np.frombuffer(raw, np.uint16, e, 24 + 12 * k + 4 * e), small[k:]


def _sharded(batches: Iterator[pa.RecordBatch], bits: int = SHARD_BITS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard = shard_of(batch["key"].to_numpy().view(np.uint64), bits)
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], ["shard", *batch.schema.names])


def _answer(table: pa.Table, kinds: list[np.dtype], names: list[str]) -> pa.Table:
    """Partial sums of a shard's postings, a row per block."""
    valued = pa.compute.is_valid(table["key"])
    held, asked = table.filter(valued), table.filter(pa.compute.invert(valued))
    keys = held["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    values = [held[n].to_numpy()[order] for n in names]
    out = []
    for posting in asked["posting"]:
        size, wanted, per_key, doc, n = opened(posting.as_py())
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        met = np.flatnonzero(keys[at] == wanted) if len(keys) else np.zeros(0, np.int64)
        sums = []
        for kind, value in zip(kinds, values, strict=True):
            each = np.zeros(len(wanted), kind)
            each[met] = value[at[met]]
            each = np.repeat(each, per_key) * n.astype(kind)
            if kind == np.float64:
                total = np.bincount(doc, each, size)
            else:
                # Weights are doubles, which whole numbers may not fit.
                total = np.zeros(size, kind)
                np.add.at(total, doc, each)
            sums.append(total.tobytes())
        out.append(zstandard.ZstdCompressor(level=1).compress(b"".join(sums)))
    return pa.table({"block": asked["block"], "sums": pa.array(out, pa.binary())})


def _finish(docs: pa.Table, sums: pa.Table, kinds: list[np.dtype], names: list[str]) -> pa.Table:
    """A block's documents with the totals of all its shards."""
    if not docs.num_rows or sums.num_rows != docs["asked"][0].as_py():
        raise RuntimeError("a block's postings and documents are not of one reading")
    place = docs["place"].to_numpy()
    raws = [zstandard.ZstdDecompressor().decompress(x.as_py()) for x in sums["sums"]]
    out = docs.drop_columns(["block", "place", "asked"])
    for i, (kind, name) in enumerate(zip(kinds, names, strict=True)):
        total = np.zeros(docs.num_rows, kind)
        for raw in raws:
            part = np.frombuffer(raw, kind, len(raw) // 8 // len(kinds), i * (len(raw) // len(kinds)))
            total += part[place]
        out = out.append_column(name, pa.array(total))
    return out


def summed(docs: DataFrame, asked: DataFrame, values: DataFrame) -> DataFrame:
    """Rows of ``docs`` with, for each value column, the sum over their keys.

    ``docs`` has block, place (position in the block) and asked (the block's
    number of posting rows) beside its own columns; ``asked`` has the columns
    of ``POSTINGS``; ``values`` has key (bigint) and 8-byte value columns. A
    key without a value adds nothing.
    """
    names = [c for c in values.columns if c != "key"]
    types = {f.name: f.dataType.simpleString() for f in values.schema}
    kinds = [np.dtype({"bigint": np.int64, "double": np.float64}[types[c]]) for c in names]
    blocks = asked.select("block").distinct().count()
    parts = max(1, -(-blocks // PART_BLOCKS))
    listed = ", ".join(f"{c} {types[c]}" for c in names)
    shards = values.mapInArrow(_sharded, f"shard int, key bigint, {listed}")
    none = lambda kind: F.lit(None).cast(kind)
    copies = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("shard", "part", none("bigint").alias("block"), none("binary").alias("posting"), "key", *names)
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")
    dealt = asked.select("shard", part, "block", "posting", none("bigint").alias("key"), *[none(types[c]).alias(c) for c in names])
    answers = dealt.union(copies).groupBy("shard", "part").applyInArrow(lambda rows: _answer(rows, kinds, names), "block bigint, sums binary")
    own = [f for f in docs.schema if f.name not in ("block", "place", "asked")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own], listed])
    both = docs.groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(lambda rows, sums: _finish(rows, sums, kinds, names), schema)


def _answer_or_pass(rows: pa.Table, kinds: list[np.dtype], names: list[str], own: list[str]) -> pa.Table:
    """``_answer`` of a shard; the documents of a block as they are."""
    if rows["shard"][0].as_py() < 0:
        return rows.select(["block", *own]).append_column("sums", pa.nulls(rows.num_rows, pa.binary()))
    sums = _answer(rows, kinds, names)
    give_back()
    nulls = [pa.nulls(sums.num_rows, rows.schema.field(c).type) for c in own]
    return pa.table([sums["block"], *nulls, sums["sums"]], ["block", *own, "sums"])


def _finish_block(rows: pa.Table, kinds: list[np.dtype], names: list[str]) -> pa.Table:
    doc = pa.compute.is_valid(rows["place"])
    return _finish(rows.filter(doc).drop_columns(["sums"]), rows.filter(pa.compute.invert(doc)), kinds, names)


def summed_at_once(blocks: DataFrame, values: DataFrame, parts: int, bits: int = SHARD_BITS) -> DataFrame:
    """As ``summed``, of ``blocks`` that hold both documents and postings and are made and shuffled once.

    ``blocks`` has block, shard (null for documents), posting, place and asked
    beside the documents' own columns, which are null for postings. A block's
    number must follow from its content: what a lost task makes anew must not
    pass for what others have read. ``parts`` is the number of units of work
    of each shard, for ``PART_BLOCKS`` blocks each where there are no more than
    ``SHARD_BITS`` bits of shards; ``bits`` is what the postings were packed by.
    """
    names = [c for c in values.columns if c != "key"]
    types = {f.name: f.dataType.simpleString() for f in [*values.schema, *blocks.schema]}
    kinds = [np.dtype({"bigint": np.int64, "double": np.float64}[types[c]]) for c in names]
    listed = ", ".join(f"{c} {types[c]}" for c in names)
    own = [c for c in blocks.columns if c not in ("block", "shard", "posting")]
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    shards = values.mapInArrow(partial(_sharded, bits=bits), f"shard int, key bigint, {listed}")
    part = F.expr(f"explode(sequence(0L, {parts - 1}L))").alias("part")
    copies = shards.select("shard", part, *[none(c) for c in ("block", "posting")], "key", *names, *[none(c) for c in own])
    # A block's documents are a unit of their own.
    part = F.when(F.col("shard").isNull(), F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(parts))).alias("part")
    dealt = blocks.select(F.coalesce("shard", F.lit(-1)).alias("shard"), part, "block", "posting", F.lit(None).cast("bigint").alias("key"), *[none(c) for c in names], *own)
    passed = ", ".join(["block bigint", *[f"`{c}` {types[c]}" for c in own], "sums binary"])
    answers = dealt.union(copies).groupBy("shard", "part").applyInArrow(lambda rows: _answer_or_pass(rows, kinds, names, own), passed)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in own if c not in ("place", "asked")], listed])
    return answers.groupBy("block").applyInArrow(lambda rows: _finish_block(rows, kinds, names), schema)
