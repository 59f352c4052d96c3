"""Benchmark decontamination with one Aho-Corasick automaton.

Method. Test items are cut into windows of ``width`` normalised words; all
windows form one automaton. Each document's normalised words are scanned once;
a hit is mapped to word positions and to code point offsets of the original
text. Documents are never shuffled.

Size. Items are the stated query set. Their windows are measured first; an
automaton takes at most ``BLOCK_BYTES`` of them, and a larger set is dealt by
window hash to several automata that scan in turn, their hits united.

Edge cases. Null or wordless texts have no words and no hits; a null or
wordless item has no window. An item shorter than a window is one window. A
null item id counts as an item whose id is written as nothing; repeated ids
count once. Very long texts are scanned whole. Without documents the result is
empty, without items nothing is hit. Repeated rows are answered one by one.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.llm import words
from workloads.base import Registry, Tables

R = Registry()

BLOCK_BYTES = 16 << 20

#: Lower case for A-Z, a space for every separator.
_NORMAL = np.where(words.NOT_ALNUM[words.LOWER], 0x20, words.LOWER).astype(np.uint8)
_NORMAL_BYTES = _NORMAL.tobytes()


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, grams = [], []
        for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            found = (text or "").encode().translate(_NORMAL_BYTES).split()
            for i in range(max(len(found) - width, 0) + 1 if found else 0):
                ids.append(item)
                grams.append(b" ".join(found[i : i + width]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch["item_id"].type), pa.array(grams, pa.string())], ["item_id", "gram"])


def _automaton(grams: list[str]) -> tuple[ahocorasick.Automaton | None, list[int]]:
    made = ahocorasick.Automaton()
    for k, gram in enumerate(grams):
        made.add_word(f" {gram.encode().decode('latin-1')} ", k)
    if grams:
        made.make_automaton()
    return made if grams else None, [g.count(" ") + 1 for g in grams]


def _original(data: np.ndarray, mask: np.ndarray) -> list[dict]:
    """Code point spans of the runs of hit words in one original text."""
    cut = words.split(data, np.array([0, len(data)]), words.NOT_ALNUM)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(points[cut.start[a]]), "end": int(points[cut.end[b - 1]])} for a, b in edges.reshape(-1, 2)]


def _scan(batches: Iterator[pa.RecordBatch], block, last: bool) -> Iterator[pa.RecordBatch]:
    grams, owners = block.value
    automaton, sizes = _automaton(grams)
    for batch in batches:
        for row, end, data, offsets in words.slices(batch["text"]):
            out: dict[str, list] = {k: [] for k in ("n_words", "mask", "items", "spans")}
            normal = _NORMAL[data].tobytes()
            before_mask, before_items = batch["mask"].slice(row, end - row), batch["items"].slice(row, end - row)
            for i in range(end - row):
                found = normal[offsets[i] : offsets[i + 1]].split()
                mask, items = None, set(before_items[i].as_py() or ())
                if before_mask[i].is_valid:
                    mask = np.unpackbits(np.frombuffer(before_mask[i].as_py(), np.uint8), count=len(found)).astype(bool)
                if automaton is not None and found:
                    text = f" {b' '.join(found).decode('latin-1')} "
                    spaces = None
                    for stop, k in automaton.iter(text):
                        if spaces is None:
                            spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 0x20)
                            mask = np.zeros(len(found), bool) if mask is None else mask
                        after = int(np.searchsorted(spaces, stop))
                        mask[after - sizes[k] : after] = True
                        items.update(owners[k])
                out["n_words"].append(len(found))
                out["mask"].append(mask)
                out["items"].append(items)
                out["spans"].append(_original(data[offsets[i] : offsets[i + 1]], mask) if last and mask is not None else [])
            yield _answer(batch.slice(row, end - row), out) if last else _carried(batch.slice(row, end - row), out)


def _carried(rows: pa.RecordBatch, out: dict[str, list]) -> pa.RecordBatch:
    masks = [None if m is None else np.packbits(m).tobytes() for m in out["mask"]]
    return pa.RecordBatch.from_arrays(
        [rows["doc_id"], rows["text"], pa.array(masks, pa.binary()), pa.array([sorted(x) for x in out["items"]], pa.list_(pa.string()))],
        ["doc_id", "text", "mask", "items"],
    )


def _answer(rows: pa.RecordBatch, out: dict[str, list]) -> pa.RecordBatch:
    hit = [0 if m is None else int(m.sum()) for m in out["mask"]]
    ids = [sorted(x) for x in out["items"]]
    columns = {
        "doc_id": rows["doc_id"],
        "n_words": pa.array(out["n_words"], pa.int64()),
        "n_hit": pa.array(hit, pa.int64()),
        "n_items": pa.array([len(x) for x in ids], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]),
        "contaminated": pa.array([h > 0 for h in hit]),
        "items": pa.array(ids, pa.list_(pa.string())),
        "spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    }
    return pa.RecordBatch.from_pydict(columns)


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and
    the item ids and the hit spans (code points of the text, end exclusive).
    """
    spark = docs.sparkSession
    item_kind, doc_kind = (f.schema[c].dataType.simpleString() for f, c in ((items, "item_id"), (docs, "doc_id")))
    grams = items.select("item_id", "text").mapInArrow(partial(_windows, width=width), f"item_id {item_kind}, gram string")
    owner = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    grams = grams.groupBy("gram").agg(F.collect_set(owner).alias("owners")).cache()
    total = grams.agg(F.sum(F.octet_length("gram") + F.length(F.array_join("owners", ",")))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("mask"), F.lit(None).cast("array<string>").alias("items"))
    carried = f"doc_id {doc_kind}, text string, mask binary, items array<string>"
    answer = f"doc_id {doc_kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start: bigint, end: bigint>>"
    for k in range(blocks):
        rows = grams.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == k).collect()  # about block_bytes
        block = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        last = k == blocks - 1
        found = found.mapInArrow(partial(_scan, block=block, last=last), answer if last else carried)
    grams.unpersist()
    return found


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
with d as (select doc_id, {_WORDS} w from documents),
b as (select item_id, {_WORDS} w from benchmark),
g as (select distinct item_id, least(len(w), 10) k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') gram
      from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
p as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') gram
      from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from g) where len(w) >= k)),
h as (select p.doc_id, p.i, p.k, g.item_id from p join g on p.gram = g.gram and p.k = g.k),
n as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(range(i, i + k)) pos from h) group by 1),
m as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) ids, list(s order by s) items from (select distinct doc_id, item_id::varchar s from h) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, n_hit is not null contaminated
from d left join n using (doc_id) left join m using (doc_id)
"""


@R.add(SQL)
def op6_decontaminate(t: Tables) -> DataFrame:
    """All documents against all benchmark items, windows of ten words."""
    return contamination(t.documents, t.benchmark).drop("items", "spans")
