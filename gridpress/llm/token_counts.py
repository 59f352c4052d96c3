"""Token counts of sections, by offsets of whole-document tokens.

Method. A document is encoded once, whole, so no count depends on where
sections begin. Token byte lengths give token spans; they become code point
spans, and an interval join of sorted spans and sections hands each token to
the sections that hold its anchor: its first character (``start``), its last
(``last``) or the one in its middle (``middle``). A token over a boundary is
thus counted once per level of sections, by that rule alone.

Sections are code point intervals, end exclusive; they may nest, overlap or
leave gaps. Tokens whose anchor is in no section are counted as outside.

Edge cases. Very long texts, and runs of one kind of character of any length,
are encoded whole. Of tokens and sections with equal bounds each counts. An
empty table gives an empty result. A null or empty text has no tokens; its sections count 0. Null
sections are none; a null bound or an empty interval counts 0; bounds beyond
the text are cut. A token that is part of a character has that character as
its span. Repeated rows and null ids are answered row by row. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridpress.llm.bpe import PATTERN, RANKS, shared, spans, vocabulary
from workloads.base import Registry, Tables

R = Registry()

def anchors(start: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    return {"start": start, "last": end - 1, "middle": (start + end - 1) // 2}[rule]


def counts(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens anchored in each [low, high), and tokens in none. ``anchor`` is sorted."""
    high = np.maximum(low, high)
    first, last = np.searchsorted(anchor, low), np.searchsorted(anchor, high)
    change = np.zeros(len(anchor) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    return last - first, int((np.cumsum(change[:-1]) == 0).sum())


def _bounds(sections: list[dict]) -> np.ndarray:
    pairs = [(s["start"], s["end"]) if s and s["start"] is not None and s["end"] is not None else (0, 0) for s in sections]
    return np.array(pairs, np.int64).reshape(-1, 2).T


def _count(batches: Iterator[pa.RecordBatch], given, rule: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(given.value)
    for batch in batches:
        rows = []
        given = batch["sections"] if "sections" in batch.schema.names else [None] * batch.num_rows
        for text, sections in zip(batch["text"], given, strict=True):
            text = text.as_py() or ""
            ids = v.encode(text)
            start, end = spans(text, ids, v.sizes)
            low, high = paragraphs(text) if sections is None else _bounds(sections.as_py() or [])
            held, outside = counts(anchors(start, end, rule), low, high)
            edges = np.unique(np.concatenate([low[high > low], high[high > low]]))
            crossing = int((np.searchsorted(edges, start, "right") < np.searchsorted(edges, end)).sum())
            rows.append((len(ids), crossing, outside, held))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["n_tokens", "n_crossing", "n_outside", "section_tokens"]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names])


def token_counts(docs: DataFrame, rule: str = "start", by_paragraph: bool = False, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Counts per row of ``docs`` (doc_id, text, sections: array of structs with start and end).

    ``by_paragraph`` takes each text's paragraphs as its sections instead.
    Columns: doc_id, n_tokens, n_crossing (tokens over a section's bound),
    n_outside and section_tokens, in the order of the sections.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, n_crossing bigint, n_outside bigint, section_tokens array<bigint>"
    rows = docs.select("doc_id", "text", *([] if by_paragraph else ["sections"]))
    return rows.mapInArrow(partial(_count, given=shared(docs.sparkSession, ranks, pattern), rule=rule), schema)


def paragraphs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the paragraphs of a text, each with the line feed that ends it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    feeds = np.flatnonzero(raw == 0x0A)
    end = np.append(np.cumsum((raw & 0xC0) != 0x80)[feeds] if not text.isascii() else feeds + 1, len(text))
    return np.concatenate([[0], end[:-1]]), end


@R.add()
def op10_token_counts(t: Tables) -> DataFrame:
    """Tokens of every paragraph of all documents; a token belongs where it starts."""
    return token_counts(t.documents, by_paragraph=True)
