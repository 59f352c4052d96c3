"""Alignment of two tokenizers' tokens over the same text, and how firm its links are.

Method. Each text, with a space before it, is encoded by a byte-level BPE (A)
and by a SentencePiece model (B). All tokens of both are sorted by start byte;
with the running maximum of their ends, a group breaks where a start reaches
that maximum. Within a group, every pair of tokens that overlap is one stretch
between neighbouring token ends; a pair whose two tokens end there together is
a link. Tasks align each distinct stretch of text once (``stretches``): both
tokenizers end a token where stretches meet, so groups never go over.

Corpus figures. How many links hold an (A id, B id) pair, and which A ids are
the best of each B id, are counted by Spark over all texts; ``sums`` brings
them back as one sum per text. Texts are read once and not shuffled.

Bounds. A task holds both vocabularies, what it knows of stretches (bounded)
and a block of some ``BLOCK_CHARS``, or one text. A hot pair is one entry per
text; the pairs of a B id are at most the ids of A.

Edge cases. Texts that are null, empty, or not given back by both token
sequences (such as those that hold U+2581) have no tokens: zeros, and '' for
the digest. Special tokens' strings are plain text. Repeated rows count each
and are answered each; a null id stays null. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridpress.llm import bpe
from gridpress.llm.pieces import MARK, MODEL
from gridpress.llm.stretches import RUN_CHARS, Known, Lists, irregular, joined, row_runs, runs
from gridpress.llm.sums import BLOCK_ROWS, opened, postings, summed
from gridpress.session import stage
from workloads.base import Registry, Tables

R = Registry()

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK_CHARS = 6 << 20
#: Bits of a pair's key that hold the B id.
B_BITS = 20


def groups_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each A and each B token, from the end bytes of two tilings of one range."""
    start = np.concatenate([[0], a_end[:-1], [0], b_end[:-1]]) if len(a_end) else np.zeros(0, np.int64)
    end = np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(end), np.int64)
    group[order] = np.cumsum(np.concatenate([[False], start[order][1:] >= reach[:-1]])) if len(end) else []
    return group[: len(a_end)], group[len(a_end) :]


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, whether they end together) of every overlapping pair, in order."""
    edge = np.union1d(a_end, b_end)
    a, b = np.searchsorted(a_end, edge), np.searchsorted(b_end, edge)
    return a, b, (a_end[a] == edge) & (b_end[b] == edge)


class Aligner:
    """Both vocabularies and the aligned stretches that a task knows."""

    def __init__(self, description: str, model: bytes) -> None:
        self.a = bpe.Vocabulary(description)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if re.search(f"[^{MARK}]{MARK}", piece):
                raise ValueError(f"piece {i} goes over a space")
            pieces.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.b_sizes = np.array([len(p) for p in pieces], np.int64)
        self.b_start = np.concatenate([[0], np.cumsum(self.b_sizes)])
        self.b_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.space = self.b.piece_to_id(MARK)
        self.names = [str(i) for i in range(max(len(self.a.sizes), len(pieces)))]
        self.links = Lists(np.int64)
        self.shown: list[str | None] = []
        self.sizes, self.learned = np.zeros((1 << 10, 3), np.int64), 0
        self.known = Known(self._learn, self._forget)

    def _forget(self) -> None:
        self.links.clear()
        self.learned = 0
        self.shown = []

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids joined, how many are each text's) of A and of B, for stretches that begin with a space."""
        lengths = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts])
        alone = irregular(texts) | np.array([MARK in t for t in texts], bool)
        found = self.b.encode([t[1:] for t in joined(texts, alone)], num_threads=1)
        b = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        ends, edges = np.cumsum(self.b_sizes[b]), np.cumsum(lengths)
        cut = np.searchsorted(ends, edges, "right")
        if len(ends) and cut[-1] == len(b) and (cut > 0).all() and (ends[cut - 1] == edges).all():
            return [self.a.encode_each(texts), (b, np.diff(cut, prepend=0))]
        # Some text is not given back, or is the empty one that the model adds no space to: one by one.
        each = self.b.encode([t[1:] for t in texts], num_threads=1)
        each = [x if len(t) > 1 else [self.space] for t, x in zip(texts, each, strict=True)]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return [self.a.encode_each(texts), (np.fromiter(chain.from_iterable(each), np.int64, int(counts.sum())), counts)]

    @staticmethod
    def _given_back(flat: np.ndarray, counts: np.ndarray, sizes, start, raw, lengths: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Which texts the bytes of their tokens give back."""
        bound = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(sizes[flat])])
        fits = ends[bound[1:]] - ends[bound[:-1]] == lengths
        size = sizes[flat]
        got = raw[np.repeat(start[flat] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        begin, own = ends[bound[:-1]], np.concatenate([[0], np.cumsum(lengths)])
        if fits.all():
            wrong = np.concatenate([[0], np.cumsum(got != joined)])
            return wrong[own[1:]] == wrong[own[:-1]]
        for i in np.flatnonzero(fits):
            fits[i] = np.array_equal(got[begin[i] : begin[i] + lengths[i]], joined[own[i] : own[i + 1]])
        return fits

    def _learn(self, new: list[str]) -> None:
        (a, n_a), (b, n_b) = self.encoded(new)
        raw = [s.encode() for s in new]
        lengths, joined = np.array([len(r) for r in raw]), np.frombuffer(b"".join(raw), np.uint8)
        flat, counts = [a.astype(np.int64), b], [n_a, n_b]
        same = self._given_back(flat[0], counts[0], self.a.sizes, self.a.start, self.a.bytes, lengths, joined)
        same &= self._given_back(flat[1], counts[1], self.b_sizes, self.b_start, self.b_bytes, lengths, joined)
        # Tokens of the stretches that hold, on one line of bytes.
        flat = [f[np.repeat(same, c)] for f, c in zip(flat, counts, strict=True)]
        ends = [np.cumsum(sizes[f]) for f, sizes in zip(flat, (self.a.sizes, self.b_sizes), strict=True)]
        group = groups_of(*ends)
        bound = [np.concatenate([np.flatnonzero(np.diff(g, prepend=-1)), [len(g)]]).tolist() for g in group]
        name = self.names.__getitem__
        left, right = (list(map(name, f.tolist())) for f in flat)
        shown = [
            f"{left[a]}|{right[c]}" if b - a == 1 == d - c else f"{','.join(left[a:b])}|{','.join(right[c:d])}"
            for a, b, c, d in zip(bound[0], bound[0][1:], bound[1], bound[1][1:], strict=False)
        ]
        x, y, together = overlaps(*ends)
        code = (flat[0][x[together]] << B_BITS) | flat[1][y[together]]
        # Where each stretch's groups and links end.
        edge = np.cumsum(lengths[same])
        last = np.searchsorted(ends[0], edge)
        upto = (group[0][last] + 1).tolist()
        linked = np.searchsorted(ends[0][x[together]], edge, "right")
        at, k = 0, 0
        for holds in same.tolist():
            self.shown.append(";".join(shown[at : upto[k]]) if holds else None)
            if holds:
                at, k = upto[k], k + 1
        three = np.zeros((len(new), 3), np.int64)
        three[same] = np.stack([counts[0][same], counts[1][same], np.diff(upto, prepend=0)], 1)
        if self.learned + len(new) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes[: self.learned], np.zeros((2 * (self.learned + len(new)), 3), np.int64)])
        self.sizes[self.learned : self.learned + len(new)] = three
        self.learned += len(new)
        each = np.zeros(len(new), np.int64)
        each[same] = np.diff(linked, prepend=0)
        self.links.add(code, each)

    def align_each(self, texts: list[str]) -> list[tuple[np.ndarray, str, np.ndarray] | None]:
        """((n_a, n_b, n_groups), digest, link codes) of each text; None where its tokens do not give it back."""
        self.known.trim()
        numbers = [self.known.numbers(" " + t) if 0 < len(t) <= RUN_CHARS else None for t in texts]
        self.known.settle()
        out = [None if at is None else self._result([at]) for at in numbers]
        for i, text in enumerate(texts):
            if len(text) > RUN_CHARS:
                out[i] = self._result(self._run_numbers(text))
        return out

    def _run_numbers(self, text: str) -> Iterator[np.ndarray]:
        for run in runs(" " + text):
            self.known.trim()
            at = self.known.numbers(run)
            self.known.settle()
            yield at

    def _result(self, numbers: Iterable[np.ndarray]) -> tuple[np.ndarray, str, np.ndarray] | None:
        total, digest, codes, joint = np.zeros(3, np.int64), hashlib.sha256(), [], b""
        for at in numbers:
            parts = list(map(self.shown.__getitem__, at.tolist()))
            if None in parts:
                return None
            digest.update(joint + ";".join(parts).encode())
            joint = b";"
            total += self.sizes[at].sum(0)
            codes.append(self.links.take(at))
        return total, digest.hexdigest(), np.concatenate(codes)


_loaded: dict[int, Aligner] = {}


def _aligner(given) -> Aligner:
    key = hash(given)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(*given)
    return _loaded[key]


def described(path: str) -> str:
    """The tokenizer of a file; it must be a byte-level BPE that adds no space of its own."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    before = json.loads(text)["pre_tokenizer"]
    if before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        raise ValueError("A must split by the byte-level pattern and add no space")
    return text


def _given(spark, tokenizer: str, model: str):
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast((described(tokenizer), f.read()))  # two vocabularies


def _pairs(batches: Iterator[pa.RecordBatch], given) -> Iterator[pa.RecordBatch]:
    """Every overlapping pair of tokens of each text, with group and byte range of the overlap."""
    aligner = _aligner(given.value)
    kind = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("group", pa.int32()), ("end", pa.int64()), ("linked", pa.bool_())])
    for batch in batches:
        out = []
        for text in batch["text"].to_pylist():
            pairs: list = []
            base, first = 0, 0
            for run in runs(" " + text) if text else ():
                (a, _), (b, _) = aligner.encoded([run])
                ends = [np.cumsum(aligner.a.sizes[a]), np.cumsum(aligner.b_sizes[b])]
                if b"".join([aligner.b_bytes[aligner.b_start[i] : aligner.b_start[i + 1]].tobytes() for i in b]) != run.encode():
                    pairs = []
                    break
                group, _ = groups_of(*ends)
                x, y, together = overlaps(*ends)
                stop = np.minimum(ends[0][x], ends[1][y])
                pairs += [{"a": a[i], "b": b[j], "group": first + int(group[i]), "end": base + int(e), "linked": bool(t)} for i, j, e, t in zip(x, y, stop, together, strict=True)]
                base, first = base + int(ends[0][-1]), first + int(group[-1]) + 1
            out.append(pairs)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.list_(kind))], ["doc_id", "pairs"])


def align(docs: DataFrame, tokenizer: str = TOKENIZER, model: str = MODEL) -> DataFrame:
    """doc_id and pairs of each row of ``docs`` (doc_id, text): the overlapping tokens of a text in order.

    A pair has both ids, its group, the byte (of space and text) where the
    overlap ends, and whether both tokens end there.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, pairs array<struct<a: int, b: int, group: int, end: bigint, linked: boolean>>"
    return docs.select("doc_id", "text").mapInArrow(partial(_pairs, given=_given(docs.sparkSession, tokenizer, model)), schema)


_DOC = ["place", "asked", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _blocks(batches: Iterator[pa.RecordBatch], given) -> Iterator[pa.RecordBatch]:
    """Blocks of texts: a row per text, and a row per shard of the links' pairs."""
    aligner = _aligner(given.value)
    task, number = TaskContext.get().partitionId(), 0
    ids, rows, codes, chars = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        block = (task << 32) + number
        size = [len(c) for c in codes]
        told = postings(np.concatenate(codes).astype(np.uint64), np.repeat(np.arange(len(codes)), size), len(codes)) if sum(size) else []
        n, m = len(rows), len(told)
        own = pa.concat_arrays(ids)
        places = list(range(n))
        columns = [places, [m] * n, *zip(*rows, strict=True)]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), own, *arrays], ["block", "shard", "posting", "doc_id", *_DOC])
        if m:
            shard, posting = zip(*told, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * m, pa.int64()), pa.array(shard, pa.int32()), pa.array(posting, pa.binary()), pa.nulls(m, own.type), *[pa.nulls(m, k) for k in kinds]],
                ["block", "shard", "posting", "doc_id", *_DOC],
            )

    for batch in batches:
        for first, texts in row_runs(batch["text"]):
            for low in range(0, len(texts), BLOCK_ROWS):
                part = texts[low : low + BLOCK_ROWS]
                if rows and (chars >= BLOCK_CHARS or len(rows) + len(part) > BLOCK_ROWS):
                    yield from flush()
                    ids, rows, codes, chars, number = [], [], [], 0, number + 1
                ids.append(batch["doc_id"].slice(first + low, len(part)))
                for found in aligner.align_each(part):
                    total, digest, links = found or (np.zeros(3, np.int64), "", np.zeros(0, np.int64))
                    rows.append((*total.tolist(), len(links), digest))
                    codes.append(links)
                chars += sum(map(len, part))
    if rows:
        yield from flush()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for posting in batch["posting"]:
            _, keys, per_key, _, n = opened(posting.as_py())
            total = np.add.reduceat(n.astype(np.int64), np.concatenate([[0], np.cumsum(per_key[:-1], dtype=np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], ["key", "n"])


def link_counts(asked: DataFrame) -> DataFrame:
    """Links of each (A id, B id) pair by key, and whether no other A id has more with its B id."""
    counts = asked.select("posting").mapInArrow(_counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("count_sum"))
    b = W.partitionBy(F.col("key").bitwiseAND(F.lit((1 << B_BITS) - 1)))
    return counts.select("key", "count_sum", (F.col("count_sum") == F.max("count_sum").over(b)).cast("long").alias("n_best"))


def alignment_scores(docs: DataFrame, tokenizer: str = TOKENIZER, model: str = MODEL) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): sizes and digest of its alignment, and its links' corpus figures.

    Columns: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, count_sum
    (links of the corpus that hold the same pair, over the row's links) and
    n_best (links whose pair has the most of its B id).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block bigint, shard int, posting binary, doc_id {kind}, place int, asked int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    blocks = docs.select("doc_id", "text").mapInArrow(partial(_blocks, given=_given(docs.sparkSession, tokenizer, model)), schema)
    blocks = stage(blocks, "aligned")
    asked = blocks.filter("shard is not null").select("block", "shard", "posting")
    rows = blocks.filter("shard is null").drop("shard", "posting")
    return summed(rows, asked, stage(link_counts(asked), "links"))


@R.add()
def op11_alignment(t: Tables) -> DataFrame:
    """Byte-level BPE against SentencePiece tokens of all documents."""
    return alignment_scores(t.documents)
