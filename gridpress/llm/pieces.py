"""SentencePiece encoding and decoding with the n best segmentations.

Method. A normalised text is a lattice of vocabulary pieces. Forward Viterbi
gives the best score of each prefix; those scores are exact heuristics for an
A* search from the end backwards, which yields whole segmentations best first.
The lattice falls apart where no piece can cross: before a space mark, and
before an ASCII sign or digit that follows a Latin letter. Best and second-best scores are kept
per distinct stretch, and the n best of a text differ from its best one only in the n - 1
stretches whose second-best path costs least. The A* search runs on those.
A vocabulary with pieces across such points is cut less, or not at all.

Scores are the model's own piece scores, added up; a character without a piece
becomes its byte pieces, at ten below the lowest ordinary score. For a BPE vocabulary
these are merge ranks, so the best segmentation is the one with the least sum
of ranks, which may differ from that of greedy merging.

Memory. A worker keeps at most some ``CACHE`` stretches in flat arrays. The
vocabulary travels as the model file's bytes, read on the driver.

Edge cases. A null or empty text has no ids, score 0 and no alternatives.
Decoding gives back the normalised text: a space mark in a text reads as a
space. Ties go to the path found first, from the left. Very long texts are
encoded whole, an unbroken stretch at a time. An empty table gives an empty
result. Repeated rows and null
ids are answered row by row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from workloads.base import Registry, Tables

R = Registry()

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 400_000
SLICE_CHARS = 4 << 20
MARK = "▁"
LOW = float("-inf")
#: Scores this low mark pieces that merging never makes, such as runs of spaces; they are no measure of rarity.
NEVER = -1e8


def _stretches(pieces: list[str]) -> str:
    """A pattern for the longest stretches that no piece can leave."""
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        return r"[\s\S]+"
    sign, letter = r"\x00-@\[-`{-\x7f", "[A-Za-zÀ-ÖØ-öø-ɏ]"
    if any(re.search(f"{letter}[{sign}]", p) for p in pieces):
        return f"{MARK}+[^{MARK}]*|[^{MARK}]+"
    other = f"[^{sign}{MARK}]"
    return f"(?=[\\s\\S]){MARK}*[{sign}]*{other}*(?:(?<!{letter})[{sign}]+{other}*)*"


class Vocabulary:
    """Pieces of a model, and segmentations of stretches of normalised text."""

    def __init__(self, model: bytes) -> None:
        self.model = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Pieces as nested maps: character -> (next map, id or -1, score).
        self.root: dict[str, tuple[dict, int, float]] = {}
        self.byte_ids, self.bytes = {}, []
        usable = []
        for i in range(len(sp)):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                usable.append((piece, i, sp.get_score(i)))
                self.bytes.append(piece.replace(MARK, " ").encode())
        for piece, i, score in usable:
            node = self.root
            for k, c in enumerate(piece):
                below, own, value = node.get(c, ({}, -1, 0.0))
                node[c] = (below, i, score) if k == len(piece) - 1 else (below, own, value)
                node = below
        self.unknown = min((s for *_, s in usable if s > NEVER), default=0.0) - 10
        self.stretch = re.compile(_stretches([p for p, *_ in usable]))
        self.prefixed = sp.normalize("a") != "a"
        sizes = np.array([len(b) for b in self.bytes])
        self.byte_size, self.byte_start = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.byte_run = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.score, self.lead = array("i"), array("q", [0, 0]), array("d", [0.0]), array("d", [np.inf])

    def arcs(self, s: str, i: int) -> Iterator[tuple[int, int, float]]:
        """(end, id, score) of the pieces that start at i; id -1 stands for the bytes of a character."""
        node, single = self.root, False
        for j in range(i, len(s)):
            hit = node.get(s[j])
            if hit is None:
                break
            node, k, score = hit
            if k >= 0:
                single |= j == i
                yield j + 1, k, score
        if not single:
            yield i + 1, -1, self.unknown

    def ids(self, s: str, path: list[tuple[int, int]]) -> list[int]:
        out = []
        for i, k in path:
            out += [k] if k >= 0 else [self.byte_ids[b] for b in s[i].encode()]
        return out

    def add(self, s: str) -> int:
        """Best path of a stretch and the lead of its best score over the second best."""
        n, root, unknown = len(s), self.root, self.unknown
        one, two, back, own = [LOW] * (n + 1), [LOW] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        one[0] = 0.0
        for i in range(n):
            a, b, node, single = one[i], two[i], root, False
            for j in range(i + 1, n + 1):
                hit = node.get(s[j - 1])
                if hit is None:
                    break
                node, k, score = hit
                if k < 0:
                    continue
                if j == i + 1:
                    single = True
                c, top = a + score, one[j]
                if c > top:
                    two[j] = top if top > b + score else b + score
                    one[j], back[j], own[j] = c, i, k
                elif c > two[j]:
                    two[j] = c
            if not single:
                j, c = i + 1, a + unknown
                if c > one[j]:
                    two[j] = max(one[j], b + unknown)
                    one[j], back[j], own[j] = c, i, -1
                elif c > two[j]:
                    two[j] = c
        path, j = [], n
        while j:
            path.append((back[j], own[j]))
            j = back[j]
        self.flat.extend(self.ids(s, path[::-1]))
        self.start.append(len(self.flat))
        self.score.append(one[n])
        self.lead.append(one[n] - two[n])
        self.known[s] = index = len(self.score) - 1
        return index

    def n_best(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a stretch, best first."""
        size = len(s)
        best = [0.0] + [LOW] * size
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            for j, k, score in self.arcs(s, i):
                into[j].append((i, k, score))
                if best[i] + score > best[j]:
                    best[j] = best[i] + score
        # Among equal totals the one nearest to the start comes first, or ties would all be opened.
        agenda, count, found = [(-best[size], size, 0, 0.0, None)], 0, []
        while agenda and len(found) < n:
            total, at, _, after, tail = heapq.heappop(agenda)
            if at == 0:
                path = []
                while tail is not None:
                    path.append(tail[:2])
                    tail = tail[2]
                found.append((-total, self.ids(s, path)))
                continue
            for i, k, score in into[at]:
                count += 1
                heapq.heappush(agenda, (-(best[i] + score + after), i, count, after + score, (i, k, tail)))
        return found

    def text_n_best(self, stretches: list[str], index: np.ndarray, n: int) -> list[tuple[float, list[tuple[int, list[int]]]]]:
        """The n best of a text as (score, stretches that differ from the best)."""
        base = float(np.frombuffer(self.score)[index].sum())
        lead = np.frombuffer(self.lead)[index]
        near = np.argsort(lead, kind="stable")[: n - 1] if len(lead) < 4 * n else _smallest(lead, n - 1)
        choices = [(int(w), self.n_best(stretches[w], n)) for w in sorted(near) if lead[w] < np.inf]
        at = (0,) * len(choices)
        agenda, seen, found = [(-base, at)], {at}, []
        while agenda and len(found) < n:
            total, at = heapq.heappop(agenda)
            found.append((-total, [(w, c[k][1]) for k, (w, c) in zip(at, choices, strict=True) if k]))
            for d, (_, c) in enumerate(choices):
                if at[d] + 1 < len(c):
                    step = (*at[:d], at[d] + 1, *at[d + 1 :])
                    if step not in seen:
                        seen.add(step)
                        heapq.heappush(agenda, (total + c[at[d]][0] - c[at[d] + 1][0], step))
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ids stand for, without the added first space."""
        size = self.byte_size[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(ids) else 0
        at = np.repeat(self.byte_start[ids] - (end - size), size) + np.arange(total)
        out = self.byte_run[at].tobytes()
        return out[1:] if self.prefixed and out[:1] == b" " else out


def _smallest(values: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n smallest, the earlier first among equals."""
    if n <= 0:
        return np.zeros(0, int)
    bound = np.partition(values, n - 1)[n - 1]
    below = np.flatnonzero(values < bound)
    return np.concatenate([below, np.flatnonzero(values == bound)[: n - len(below)]])


_loaded: dict[bytes, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    key = hashlib.sha1(model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(model)
    return _loaded[key]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


_EDITS = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("stretch", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def _encode(batches: Iterator[pa.RecordBatch], model, n: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    v = _vocabulary(model.value)
    for batch in batches:
        for first, texts in _chunks(batch["text"]):
            if len(v.known) > CACHE:
                v.reset()
            get, add, rows = v.known.get, v.add, []
            for text in texts:
                normal = v.model.normalize(text) if text else ""
                stretches = v.stretch.findall(normal)
                index = np.fromiter((get(s) or add(s) for s in stretches), np.int64, len(stretches))
                start, score = np.frombuffer(v.start, np.int64), np.frombuffer(v.score)
                lo, size = start[index], start[index + 1] - start[index]
                end = np.cumsum(size)
                total = int(end[-1]) if len(end) else 0
                ids = np.frombuffer(v.flat, np.int32)[np.repeat(lo - (end - size), size) + np.arange(total)] if total else np.zeros(0, np.int32)
                best = v.text_n_best(stretches, index, n) if total else []
                plain = normal[1:] if v.prefixed and normal[:1] == MARK else normal
                same = v.decode(ids) == plain.replace(MARK, " ").encode()
                rows.append((total, float(score[index].sum()), [s for s, _ in best], hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), same, ids, best[1:]))
                del start, score
            counts, scores, nbest, digests, sames, ids, others = zip(*rows, strict=True)
            columns = {
                "doc_id": batch["doc_id"].slice(first, len(rows)),
                "n_tokens": pa.array(counts, pa.int64()),
                "score": pa.array(scores, pa.float64()),
                "nbest_scores": pa.array(nbest, pa.list_(pa.float64())),
                "ids_sha256": pa.array(digests, pa.string()),
                "round_trip": pa.array(sames, pa.bool_()),
            }
            if with_ids:
                bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                columns["ids"] = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(ids), pa.int32()))
                columns["others"] = pa.array([[{"score": s, "edits": [{"stretch": w, "ids": i} for w, i in e]} for s, e in o] for o in others], _EDITS)
            yield pa.RecordBatch.from_pydict(columns)


def _model(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, n: int = 3, model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """Each row's best ids, its n best scores, and how the other segmentations differ from the best.

    Columns: doc_id, n_tokens, score, nbest_scores, ids_sha256 (of 32-bit
    little-endian ids), round_trip (whether decoding gives the normalised text)
    and, ``with_ids``, ids and others.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, score double, nbest_scores array<double>, ids_sha256 string, round_trip boolean"
    if with_ids:
        schema += ", ids array<int>, others array<struct<score: double, edits: array<struct<stretch: int, ids: array<int>>>>>"
    return docs.select("doc_id", "text").mapInArrow(partial(_encode, model=_model(docs.sparkSession, model), n=n, with_ids=with_ids), schema)


def _decode(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    v = _vocabulary(model.value)
    for batch in batches:
        texts = [v.decode(np.asarray(x.as_py() or [], np.int64)).decode(errors="replace") for x in batch["ids"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of ids."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, model=_model(encoded.sparkSession, model)), f"doc_id {kind}, text string")


@R.add()
def op7_sentencepiece(t: Tables) -> DataFrame:
    """Three best segmentations of all documents, with their ids."""
    return encode(t.documents)
