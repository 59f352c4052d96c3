"""Byte-level BPE encoding and decoding with the tokenizers library.

Method. The driver turns a rank file into a tokenizer of the library: ids are
ranks, and a token's merge is the pair that is left when its own bytes are
merged by rank until two parts remain. No other pair can ever become that
token inside a text, as merges within its bytes come in the same order there;
so merging by these pairs equals merging by rank. Tasks take the distinct
stretches of their Arrow batches (``stretches``), split each by the pattern,
map its bytes to the library's characters and let the library merge them.
Byte lengths of tokens give byte offsets, and a count of first bytes maps them
to code points of the original; a token that holds part of a character has
that character in its span. Decoding maps token characters back to bytes by
the reversed byte table and joins them before any character is read, so
characters split over tokens come back whole.

Bounds. A task holds the vocabulary, what it knows of stretches (bounded) and
one run of rows, or one text. Long runs of spaces, letters or line feeds are
single matches of the pattern and are merged whole.

Edge cases. A null or empty text has no tokens and decodes to nothing. Text
that looks like a special token is plain text. Ids that are null or not of the
vocabulary decode to nothing; bytes that are no character decode to U+FFFD in
text. Repeated rows and null ids are answered row by row; an empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import models

from gridpress.llm.stretches import Known, Lists, irregular, joined, row_runs, runs
from workloads.base import Registry, Tables

R = Registry()

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last two parts of a token whose bytes are merged by rank; None if merging stops before."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not options:
            return None
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=4)
def tokenizer_of(ranks_path: str) -> str:
    """The library's description of a tokenizer with the ranks of a file as ids."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}
    shown = byte_characters()
    name = lambda piece: "".join([shown[b] for b in piece])
    pairs = [merge_of(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    # A match that is a token as it stands is that token, whatever its merges.
    model = models.BPE(vocab={name(t): i for t, i in ranks.items()}, merges=[(name(a), name(b)) for a, b in filter(None, pairs)], ignore_merges=True)
    return tokenizers.Tokenizer(model).to_str()


class Vocabulary:
    """A tokenizer, the bytes of its tokens, and the stretches that a task knows."""

    def __init__(self, description: str, pattern: str = PATTERN) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_str(description)
        self.split = regex.compile(pattern).findall
        self.shown = dict(enumerate(byte_characters()))
        self.mark = self.shown[0xFF]
        byte = {c: b for b, c in self.shown.items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        pieces = [b""] * (max(vocab.values(), default=-1) + 1)
        for text, i in vocab.items():
            pieces[i] = bytes([byte[c] for c in text])
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.ids = Lists()
        self.known = Known(self._learn, self.ids.clear)

    def encode_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of some stretches joined, how many are each one's)."""
        parts = [m for t in joined(texts, irregular(texts)) for m in self.split(t)]
        # One pass maps the bytes of all matches; 0xFF is in no UTF-8 text, so it can mark where they meet.
        shown = b"\xff".join([m.encode() for m in parts]).decode("latin-1").translate(self.shown).split(self.mark)
        tokenize = self.tokenizer.model.tokenize
        flat = np.array([x.id for m in shown if m for x in tokenize(m)], np.int32)
        lengths = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts])
        return flat, np.diff(np.searchsorted(np.cumsum(self.sizes[flat]), np.cumsum(lengths), "right"), prepend=0)

    def _learn(self, new: list[str]) -> None:
        self.ids.add(*self.encode_each(new))

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for run in runs(text):
            self.known.trim()
            at = self.known.numbers(run)
            self.known.settle()
            parts.append(self.ids.take(at))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        size = self.sizes[ids]
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)].tobytes()


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(given: tuple[str, str]) -> Vocabulary:
    """A task's vocabulary of a description and a pattern, built once for each worker."""
    if given not in _loaded:
        _loaded.clear()
        _loaded[given] = Vocabulary(*given)
    return _loaded[given]


def shared(spark: SparkSession, ranks: str, pattern: str):
    """What ``vocabulary`` takes, for all tasks: one vocabulary file's size."""
    return spark.sparkContext.broadcast((tokenizer_of(ranks), pattern))


def spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point (start, end) of each token."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.cumsum(sizes[ids])
    start = end - sizes[ids]
    if text.isascii():
        return start, end
    # The code point that holds each byte, counted by first bytes.
    point = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
    return point[start], point[end - 1] + 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))


def _encode(batches: Iterator[pa.RecordBatch], given) -> Iterator[pa.RecordBatch]:
    v = vocabulary(given.value)
    for batch in batches:
        for row, texts in row_runs(batch["text"]):
            columns: tuple[list, ...] = ([], [], [])
            split = []
            for text in texts:
                ids = v.encode(text)
                start, end = spans(text, ids, v.sizes)
                for column, part in zip(columns, (ids, start, end), strict=True):
                    column.append(part)
                split.append(int((start[1:] < end[:-1]).sum()))
            arrays = [batch["doc_id"].slice(row, len(texts)), *map(_lists, columns), pa.array(split, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "starts", "ends", "n_split"])


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids, code point spans (starts, ends) and n_split for each row of ``docs`` (doc_id, text).

    ``n_split`` counts the tokens that begin inside a character.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>, n_split bigint"
    return docs.select("doc_id", "text").mapInArrow(partial(_encode, given=shared(docs.sparkSession, ranks, pattern)), schema)


def _decode(batches: Iterator[pa.RecordBatch], given) -> Iterator[pa.RecordBatch]:
    v = vocabulary(given.value)
    for batch in batches:
        lists = batch["ids"]
        flat, bounds = lists.values.fill_null(-1).to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        raw = [v.decode(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if lists.null_count:
            raw = [b"" if null else r for r, null in zip(raw, lists.is_null().to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``encoded`` (ids and any other columns) with ``decoded``, the bytes of its tokens."""
    schema = encoded.drop("decoded").schema.add("decoded", "binary")
    return encoded.drop("decoded").mapInArrow(partial(_decode, given=shared(encoded.sparkSession, ranks, pattern)), schema)


def text_of(raw: bytes) -> str:
    """Decoded bytes as text; what is no character becomes U+FFFD."""
    return raw.decode(errors="replace")


@R.add()
def op12_byte_bpe(t: Tables) -> DataFrame:
    """All documents encoded and decoded again."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    found = decode(encode(t.documents))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split"
    )
