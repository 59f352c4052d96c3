"""Language-model scores from sharded Elias-Fano n-gram tries.

Method. Texts are written in blocks of some ``BLOCK_BYTES``. A block sends each
distinct word, pair and triple of words once, with its count in training texts,
to the shard of its hash; triples are asked for on their own, when the shuffle
of the pairs is gone. A shard adds the
counts up, packs its grams into a trie (``trie.Trie``: the upper bits of keys,
pointers, the lower bits, codes) and answers every block's grams by successor
search; a code stands for a count, rounded down to one of 255 levels. The block
then has, for each token, the counts of word, context, pair and triple, and adds
up the logarithms of

    p(w | v) = (1 - g(c(v))) * c(v w) / c(v) + g(c(v)) * (c(w) + 1) / (N + V + 1),
    p(w | u v) = (1 - g(c(u v))) * c(u v w) / c(u v) + g(c(u v)) * p(w | v),
    g(c) = min(1, DISCOUNT * c ** (HEAPS - 1)), g(0) = 1,

interpolated models of two orders whose weight follows the number of distinct
successors that a context of that count has by Heaps' law. Rounding only lowers
probabilities (a pair's count is rounded up where it divides), so they add up to
at most 1. A text's first token has no two words before it: p(w | v) stands.

Scale. The numbers of blocks and shards follow the bytes of text. Hot words and grams are
one entry per block; shards are even, as grams, not contexts, are hashed, so
a context with a third of all tokens is spread over all shards. N and V come
from a first pass over words alone. Words and grams are told apart by 64-bit hashes.

Edge cases. A null or blank text is its end token alone; very long texts are
read whole, and equal texts score alike. A null id counts as
the empty string for the split and stays null. Repeated rows count each and
are answered each. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.llm import words
from gridpress.llm.trie import EliasFano, Trie
from gridpress.session import stage
from workloads.base import Registry, Tables

R = Registry()

BLOCK_BYTES = 12 << 20
SHARD_BYTES = 16 << 20
DISCOUNT, HEAPS = 0.75, 0.8

#: Hashes of the end token and of the context of a first word.
END, START = np.uint64(0xE2D1B7A35C9F4E01), np.uint64(0x57A1275A1275A127)
#: The lower level of the trie has so many bits of a gram's key.
_LOW = np.uint64(36)
_WORD = np.uint64((1 << 36) - 1)

#: Counts that codes 1 to 255 stand for: exact up to 40, then growing by a tenth.
LEVELS = np.concatenate([[0], np.arange(1, 41), np.floor(40 * 1.1 ** np.arange(1, 216))])
#: The largest counts that codes stand for.
TOPS = np.append(LEVELS[1:] - 1, LEVELS[-1])


def _codes(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(LEVELS, counts, "right") - 1).astype(np.uint8)


def _tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, contexts, first token of each text); every text closes with the end token."""
    tokens, sizes = [], []
    for _, end, data, offsets in words.slices(column):
        cut = words.split(data, offsets)
        n = np.diff(cut.first)
        out = np.full(len(cut.start) + len(n), END)
        out[np.arange(len(cut.start)) + cut.text_of()] = cut.hashes()
        tokens.append(out)
        sizes.append(n + 1)
    tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64) if sizes else np.zeros(1, np.int64)
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[first[:-1]] = START
    return tokens, contexts, first


def _pairs(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return words.combine(contexts, tokens)


def _triples(pairs: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the words with the two before them, their positions): of all tokens but the first of each text."""
    own = np.ones(len(tokens), bool)
    own[first[:-1]] = False
    at = np.flatnonzero(own)
    return words.combine(pairs[at - 1], tokens[at]), at


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts sorted keys shard by shard, and the bounds of the shards."""
    # Small numbers are sorted in one or two passes.
    shard = (words.mix(keys) % np.uint64(shards)).astype(np.min_scalar_type(shards))
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _distinct(values: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, their trained occurrences)."""
    keys, _ = np.unique(values, return_counts=True)  # by sorting; without counts it would hash
    known, n = np.unique(values[trained], return_counts=True)
    counts = np.zeros(len(keys), np.uint32)
    counts[np.searchsorted(keys, known)] = n
    return keys, counts


def _words_of(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Distinct trained words and counts of runs of rows, by shard."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate(held), return_inverse=True)
        counts = np.bincount(at).astype(np.uint32)
        order, bound = _dealt(keys, shards)
        keys, counts = keys[order], counts[order]
        full = np.flatnonzero(np.diff(bound))
        cut = [(EliasFano.pack(keys[bound[s] : bound[s + 1]]).tobytes(), counts[bound[s] : bound[s + 1]].tobytes()) for s in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *[pa.array([c[i] for c in cut], pa.binary()) for i in (0, 1)]], ["shard", "keys", "counts"])

    for batch in batches:
        batch = batch.filter(pa.array(~batch["held_out"].to_numpy(zero_copy_only=False)))
        for row, end, _, _ in words.slices(batch["text"]):
            held.append(_tokens(batch["text"].slice(row, end - row))[0])
            size += len(held[-1])
            if size > BLOCK_BYTES // 6:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for x in column:
        packed = EliasFano(np.frombuffer(x.as_buffer(), np.uint64), 0)
        out.append(packed.get(np.arange(packed.n)))
    return out


def _added(keys: list[np.ndarray], counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, total counts, position of each of the keys given)."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    given = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in counts])
    return distinct, np.bincount(at, weights=given, minlength=len(distinct)).astype(np.int64), at


def _totals(table: pa.Table) -> pa.Table:
    _, total, _ = _added(_unpacked(table["keys"]), table["counts"])
    return pa.table({"tokens": pa.array([int(total.sum())], pa.int64()), "distinct": pa.array([int((total > 0).sum())], pa.int64())})


@words.giving_back
def _packed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Blocks of some ``limit`` bytes of whole texts, each a compressed run of Arrow bytes."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

    for batch in batches:
        for row, end, data, _ in words.slices(batch["text"], min(limit, words.SLICE_BYTES)):
            held.append(batch.slice(row, end - row))
            size += len(data) + end - row
            if size >= limit:
                yield flush()
                number, held, size = number + 1, [], 0
    if held:
        yield flush()


def _opened(docs: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(docs.as_buffer()).read_all()


def _asked(batches: Iterator[pa.RecordBatch], shards: int, by_three: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, docs in zip(batch["block"], batch["docs"], strict=True):
            yield _ask(_opened(docs), block, shards, by_three)
            words.give_back()


def _ask(table: pa.Table, block: pa.Int64Scalar, shards: int, by_three: bool) -> pa.RecordBatch:
    """A block's distinct words and pairs with their trained counts, a row per shard that has any of them.

    ``by_three``: its triples in place of pairs, and no words.
    """
    tokens, contexts, first = _tokens(table["text"])
    trained = np.repeat(~table["held_out"].to_numpy(), np.diff(first))
    pairs = _pairs(contexts, tokens)
    del contexts
    if by_three:
        triples, at = _triples(pairs, tokens, first)
        asked = (tokens[:0], trained[:0]), (triples, trained[at])
    else:
        asked = _with_starts(tokens, first, trained), (pairs, trained)
    lists = []
    for values, use in asked:
        keys, counts = _distinct(values, use)
        order, bound = _dealt(keys, shards)
        keys, counts = keys[order], counts[order]
        lists.append([EliasFano.pack(keys[bound[s] : bound[s + 1]]).tobytes() for s in range(shards)])
        lists.append([counts[bound[s] : bound[s + 1]].tobytes() for s in range(shards)])
    full = [s for s in range(shards) if lists[1][s] or lists[3][s]]
    columns = [pa.array([x[s] for s in full], pa.binary()) for x in lists]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([block.as_py()] * len(full), pa.int64()), *columns], ["shard", "block", "words", "word_counts", "pairs", "pair_counts"])


def _with_starts(tokens: np.ndarray, first: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and one start per text, with whether each is trained."""
    texts = len(first) - 1
    return np.concatenate([tokens, np.full(texts, START)]), np.concatenate([trained, trained[first[:-1]]])


def _answer(table: pa.Table) -> pa.Table:
    """A shard's answers to each block: counts of its words, codes of its pairs, or of its triples."""
    keys = _unpacked(table["words"])
    _, total, at = _added(keys, table["word_counts"])
    ends = np.cumsum([len(k) for k in keys])
    counts = [x.astype(np.uint64).tobytes() for x in np.split(total[at], ends[:-1])]
    keys = _unpacked(table["pairs"])
    distinct, total, at = _added(keys, table["pair_counts"])
    held, total = distinct[total > 0], total[total > 0]
    trie = Trie(Trie.pack(held >> _LOW, held & _WORD, _codes(total)))
    # What many blocks ask for is looked for once.
    found = trie.find(distinct >> _LOW, distinct & _WORD)[at]
    codes = [x.tobytes() for x in np.split(found, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table([table["block"], table["shard"], pa.array(counts, pa.binary()), pa.array(codes, pa.binary())], names=["block", "shard", "counts", "codes"])


def _giving_back(step, *args) -> pa.Table:
    """What a group's step returns, without the free memory that it leaves."""
    out = step(*args)
    words.give_back()
    return out


def _left(counts: np.ndarray) -> np.ndarray:
    """What contexts of these counts leave to the lower order."""
    return np.where(counts > 0, np.minimum(1.0, DISCOUNT * np.maximum(counts, 1) ** (HEAPS - 1)), 1.0)


def _score(block: pa.Table, answers: pa.Table, shards: int, n: int, v: int) -> pa.Table:
    """Scores of a block's texts from the shards' answers."""
    docs = _opened(block["docs"][0])
    tokens, contexts, first = _tokens(docs["text"])
    answers = answers.sort_by("shard")
    low, high = answers.filter(pa.compute.invert(answers["by_three"])), answers.filter(answers["by_three"])
    texts = len(first) - 1

    def told(values: np.ndarray, column: pa.ChunkedArray, kind) -> np.ndarray:
        keys, at = np.unique(values, return_inverse=True)
        order, _ = _dealt(keys, shards)
        out = np.empty(len(keys), kind)
        out[order] = np.frombuffer(b"".join(column.to_pylist()), kind)
        return out[at]

    counts = told(np.concatenate([tokens, np.full(texts, START)]), low["counts"], np.uint64).astype(np.float64)
    c = counts[: len(tokens)]
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[first[:-1]] = counts[len(tokens) :]
    pairs = _pairs(contexts, tokens)
    both = told(pairs, low["codes"], np.uint8)
    triples, at = _triples(pairs, tokens, first)
    three, two = np.zeros(len(tokens), np.uint8), np.zeros(len(tokens), np.uint8)
    three[at], two[at] = told(triples, high["codes"], np.uint8), both[at - 1]
    del contexts, pairs, triples, at, counts
    plain = (c + 1) / (n + v + 1)
    g = _left(before)
    p = (1 - g) * LEVELS[both] / np.maximum(before, 1) + g * plain
    g = _left(LEVELS)[two]
    p3 = (1 - g) * LEVELS[three] / np.maximum(TOPS[two], 1) + g * p
    del three, two, g, before, both
    add = lambda x: np.add.reduceat(x, first[:-1]) if texts else x
    columns = {
        "doc_id": docs["doc_id"],
        "held_out": docs["held_out"],
        "n_tokens": pa.array(np.diff(first), pa.int64()),
        "n_known": pa.array(add((c > 0).astype(np.int64)), pa.int64()),
        "train_tokens": pa.array(np.full(texts, n), pa.int64()),
        "base_score": pa.array(add(np.log10(plain)), pa.float64()),
        "score": pa.array(add(np.log10(p)), pa.float64()),
        "trigram_score": pa.array(add(np.log10(p3)), pa.float64()),
    }
    return pa.table(columns)


def scores(docs: DataFrame, held_out) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) by a model of the rows that ``held_out`` (a column) leaves.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, and log10
    probabilities: base_score (add-one unigram), score (the model of pairs) and
    trigram_score (the whole model).
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 1
    blocks, shards = -(-size // BLOCK_BYTES), -(-size // SHARD_BYTES)
    seen = rows.mapInArrow(partial(_words_of, shards=shards), "shard bigint, keys binary, counts binary")
    # Staged, so that the shuffle of this pass is gone before the next.
    total = stage(seen.groupBy("shard").applyInArrow(_totals, "tokens bigint, distinct bigint"), "totals").agg(F.sum("tokens"), F.sum("distinct")).first()
    n, v = total[0] or 0, total[1] or 0

    texts = stage(rows.mapInArrow(partial(_packed, limit=BLOCK_BYTES), "block bigint, docs binary"), "texts")
    told = []
    for by_three in (False, True):
        asked = texts.mapInArrow(
            partial(_asked, shards=shards, by_three=by_three), "shard bigint, block bigint, words binary, word_counts binary, pairs binary, pair_counts binary"
        )
        # Staged, as what is asked is most of all that is shuffled: it is gone before the next.
        answers = stage(asked.groupBy("shard").applyInArrow(lambda rows: _giving_back(_answer, rows), "block bigint, shard bigint, counts binary, codes binary"), "answers")
        told.append(answers.withColumn("by_three", F.lit(by_three)))
    answers = told[0].unionByName(told[1]).repartition(blocks, "block")
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, trigram_score double"
    both = texts.repartition(blocks, "block").groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(lambda block, told: _giving_back(_score, block, told, shards, n, v), schema)


@R.add()
def op4_lm_scores(t: Tables) -> DataFrame:
    """All documents, learning from those whose crc32 of the id is not 2 modulo 7."""
    return scores(t.documents, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)
