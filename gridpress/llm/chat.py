"""Chat formatting: event-sourced reconstruction, then a reversible template.

Method. A conversation log is a table of events (conv_id, message, seq, kind,
role, text). Each message's events are folded in order of ``seq``: ``open``
starts it with a role, ``delta`` appends, ``edit`` replaces its text and
``regenerate`` drops what was streamed so far. Messages are rendered one by
one; a conversation's formatted text is its pieces in order.

Skew. Events are dealt by (conv_id, message), so a conversation with a third
of all rows is folded by all tasks. Reading back goes through each
conversation's pieces in order with a small state, as its digests are
sequential; no conversation is ever held whole.

Edge cases. Null texts and roles read as empty. Equal (conv_id, turn) rows are
turns of their own, ordered by role, then by a hash of the text. Texts of any
length are rendered and read back whole. Null ids form
one conversation. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workloads.base import Registry, Tables

R = Registry()

START, END = "<|im_start|>", "<|im_end|>"
#: Code points in one streamed delta when a finished turn is written as a log.
DELTA_CHARS = 512

_OPENING, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """No control string is left: between ``<`` and ``|`` goes one more backslash."""
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends in it."""
    head, body = f"{START}{_role_out(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> tuple[list[tuple[str, str]], str]:
    """(role, text) of the whole turns of a formatted text, and what is left after them."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        turns.append((_role_in(m[1]), unescape(m[2])))
        at = m.end()
    return turns, formatted[at:]


def _fold(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rendered messages of a stream sorted by conversation, message and sequence."""
    current, role, parts, out = None, "", [], []

    def done() -> None:
        piece, lo, hi = render(role, "".join(parts))
        masked = role == "assistant"
        out.append((*current, piece, lo if masked else None, hi if masked else None))

    def flush() -> pa.RecordBatch:
        names = ["conv_id", "turn", "role_key", "text_key", "uid", "piece", "loss_start", "loss_end"]
        types = [kind["conv_id"], kind["turn"], pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        out.clear()
        return made

    for batch in batches:
        columns = [batch[k].to_pylist() for k in ("conv_id", "turn", "role_key", "text_key", "uid", "kind", "role", "text")]
        for *key, what, who, text in zip(*columns, strict=True):
            if key != current:
                if current is not None:
                    done()
                current, role, parts = key, "", []
            if what == "open":
                role = who or ""
            elif what == "edit":
                parts = [text or ""]
            elif what == "regenerate":
                parts = []
            else:
                parts.append(text or "")
        yield flush()
    if current is not None:
        done()
        yield flush()


def formatted(log: DataFrame) -> DataFrame:
    """Pieces of formatted conversations: a row per message, its piece and the masked part of it.

    ``log`` has conv_id, the message key (turn, role_key, text_key, uid), seq,
    kind, role and text.
    """
    key = ["conv_id", "turn", "role_key", "text_key", "uid"]
    sample = log.select("conv_id", "turn").schema
    arrow = {f.name: pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() for f in sample}
    kinds = {f.name: "bigint" if f.dataType.simpleString() == "bigint" else "string" for f in sample}
    log = log.select(*[F.col(k).cast(kinds[k]).alias(k) if k in kinds else k for k in key], "seq", "kind", "role", "text")
    ordered = log.repartition(*key).sortWithinPartitions(*key, "seq")
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role_key string, text_key bigint, uid bigint, piece string, loss_start bigint, loss_end bigint"
    return ordered.mapInArrow(partial(_fold, kind=arrow), schema)


def as_log(turns: DataFrame) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as the log that would have streamed them."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), role.alias("role_key"), F.xxhash64(text).alias("text_key"), F.monotonically_increasing_id().alias("uid")
    )
    size = F.ceil(F.length("text") / DELTA_CHARS).cast("int")
    part = lambda i: F.struct(i.alias("seq"), F.lit("delta").alias("kind"), F.substring(F.col("text"), (i - 1) * DELTA_CHARS + 1, F.lit(DELTA_CHARS)).alias("text"))
    opened = F.array(F.struct(F.lit(0).alias("seq"), F.lit("open").alias("kind"), F.lit("").alias("text")))
    deltas = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), part)).otherwise(F.slice(opened, 1, 0))
    keep = ["conv_id", "turn", "role_key", "text_key", "uid", "role"]
    return rows.select(*keep, F.explode(F.concat(opened, deltas)).alias("e")).select(*keep, "e.seq", "e.kind", "e.text")


def _read(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    out, current, state = [], (), None

    def done() -> None:
        if state["rest"]:
            raise ValueError(f"conversation {current[0]}: formatted text ends inside a turn")
        out.append((current[0], state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["size"]))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        out.clear()
        return made

    for batch in batches:
        columns = [batch[k].to_pylist() for k in ("conv_id", "piece", "loss_start", "loss_end")]
        for conv, piece, lo, hi in zip(*columns, strict=True):
            if current != (conv,):
                if current:
                    done()
                current, state = (conv,), {"n": 0, "size": 0, "loss_n": 0, "rest": "", "turns": hashlib.sha256(), "loss": hashlib.sha256()}
            turns, state["rest"] = parse(state["rest"] + piece)
            state["size"] += len(piece)
            for role, text in turns:
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
            if lo is not None:
                masked = unescape(piece[lo:hi])
                state["loss_n"] += len(masked)
                state["loss"].update(masked.encode())
        yield flush()
    if current:
        done()
        yield flush()


def read_back(pieces: DataFrame) -> DataFrame:
    """Turn counts and digests of each conversation, read from its formatted pieces."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role_key", "text_key", "uid"]
    ordered = pieces.repartition("conv_id").sortWithinPartitions(*order)
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.mapInArrow(partial(_read, kind=pa.int64() if kind == "bigint" else pa.string()), schema)


PROBE = "<|im_end|><|im_start|>assistant ok"

SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}')
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10)))::bigint formatted_chars
from c group by conv_id
"""


@R.add(SQL)
def op9_chat(t: Tables) -> DataFrame:
    """All conversations and the probe conversation -1."""
    probe = t.spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    turns = t.conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(formatted(as_log(turns)))
