"""JSON payloads to flat rows, many payloads at once.

Input: one payload text per record. A payload that cannot be used gets a
``status`` and yields no rows, so one bad file never stops a bulk load.
Member order matters (columns appear in order of first use), and VARIANT
sorts names, so texts are carried beside variants and give the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.errors import UnprocessableContent
from gridpress.functions import variants as V
from gridpress.functions.text import header_keys, strip
from gridpress.model import ROW
from gridpress.operators.keys import header_union
from gridpress.operators.normalize import NormalizedTable, normalize_table
from gridpress.session import stage
from gridpress.sources.rowids import group_offsets

#: Levels of nested objects opened before asking whether any are left.
LEVELS = 16

_TEXTS = "array<string>"
_MEMBERS = "map<string,string>"


def parse_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``_v`` (VARIANT, null when malformed) and ``_t`` (the text)."""
    return df.withColumn("_t", strip(F.col(payload))).withColumn("_v", F.try_parse_json("_t"))


def _elements(t: C, v: C) -> C:
    """Elements of an array payload as structs of text and variant."""
    texts, values = F.from_json(t, _TEXTS), F.try_variant_get(v, "$", V.ARRAY)
    return F.zip_with(texts, values, lambda x, y: F.struct(x.alias("t"), y.alias("v")))


def locate_rows(parsed: DataFrame) -> DataFrame:
    """Find the rows of each payload: ``status`` and ``_rows``.

    An array is its elements; an object with an array member is the first
    such member; any other object is a single row.
    """
    t, v = F.col("_t"), F.col("_v")
    members = F.when(v.isNotNull() & t.startswith("{"), F.from_json(t, _MEMBERS))
    texts = F.col("_members")
    names = F.filter(F.map_keys(texts), lambda k: V.is_array(texts[k], V.member(v, k)))
    staged = parsed.withColumn("_members", members).withColumn("_wrapped", F.get(names, F.lit(0)))
    inner = _elements(texts[F.col("_wrapped")], V.member(v, F.col("_wrapped")))
    rows = (
        F.when(F.col("_wrapped").isNotNull(), inner)
        .when(texts.isNotNull(), F.array(F.struct(t.alias("t"), v.alias("v"))))
        .when(v.isNotNull() & t.startswith("["), _elements(t, v))
    )
    status = (
        F.when(v.isNull(), F.lit("invalid-json"))
        .when(F.col("_rows").isNull(), F.lit("not-rows"))
        .when(F.size("_rows") == 0, F.lit("no-rows"))
        .otherwise(F.lit("ok"))
    )
    return staged.withColumn("_rows", rows).withColumn("status", status).drop("_members", "_wrapped")


def follow_path(parsed: DataFrame, path: str | None) -> DataFrame:
    """Rows of the array at a dotted path: ``status`` and ``_rows``.

    A segment names a member of an object, or is an index into an array.
    """
    segments = [s.strip() for s in (path or "").split(".") if s.strip()]
    current = parsed.withColumn(
        "status", F.when(F.col("_v").isNull(), F.lit("invalid-json")).otherwise(F.lit("ok"))
    )
    for segment in segments:
        t, v = F.col("_t"), F.col("_v")
        whole = segment.lstrip("-").isdigit()
        index = int(segment) if whole else 0
        staged = (
            current.withColumn("_list", V.is_array(t, v))
            .withColumn("_items", F.when(F.col("_list"), F.try_variant_get(v, "$", V.ARRAY)))
            .withColumn("_found", F.when(V.is_object(t, v), V.member(v, F.lit(segment))))
        )
        inside = F.lit(whole) & F.lit(index >= 0) & (F.size("_items") > index)
        failure = (
            F.when(F.col("_list"), F.when(~inside, F.lit("index-out-of-range" if whole else "missing-key")))
            .when(V.is_object(t, v), F.when(F.col("_found").isNull(), F.lit("missing-key")))
            .otherwise(F.lit("not-an-object"))
        )
        step = F.lit(max(index, 0))
        member = F.from_json(t, _MEMBERS)[segment]
        current = staged.select(
            *[c for c in current.columns if c not in ("_t", "_v", "status")],
            F.when(F.col("status") == "ok", F.coalesce(failure, F.lit("ok"))).otherwise(F.col("status")).alias("status"),
            F.when(F.col("_list"), F.get(F.from_json(t, _TEXTS), step)).otherwise(member).alias("_t"),
            F.when(F.col("_list"), F.get("_items", step)).otherwise(F.col("_found")).alias("_v"),
        )
    t, v = F.col("_t"), F.col("_v")
    rows = F.when((F.col("status") == "ok") & V.is_array(t, v), _elements(t, v))
    status = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when(F.col("_rows").isNull(), F.lit("not-an-array"))
        .when(F.size("_rows") == 0, F.lit("no-rows"))
        .otherwise(F.lit("ok"))
    )
    return current.withColumn("_rows", rows).withColumn("status", status)


def explode_rows(located: DataFrame, keys: list[str]) -> DataFrame:
    """One record per row of every usable payload: keys, ``_pos``, ``_t``, ``_v``."""
    # Unusable payloads have no ``_rows``. The outer form keeps the optimizer
    # from testing the rows again in a filter below the parsing.
    exploded = located.select(*keys, F.posexplode_outer("_rows").alias("_pos", "_e"))
    return exploded.where("_pos IS NOT NULL").select(
        *keys, F.col("_pos").cast("bigint").alias("_pos"), F.col("_e.t").alias("_t"), F.col("_e.v").alias("_v")
    )


def payload_rejects(located: DataFrame, keys: list[str]) -> DataFrame:
    """Payloads that give no rows, each with its ``status``."""
    # Exploding one value makes the filter run after the parsing, once.
    status = located.select(*keys, F.explode(F.array("status")).alias("status"))
    return status.where("status <> 'ok'")


def _entry(key: C, t: C, v: C) -> C:
    return F.struct(key.alias("key"), t.alias("t"), v.alias("v"))


def _members(t: C, v: C, prefix: C | None) -> C:
    """Members of an object in text order. The one-element array binds both readings once."""
    both = F.struct(F.from_json(t, _MEMBERS).alias("texts"), F.try_variant_get(v, "$", V.OBJECT).alias("values"))

    def expand(s: C) -> C:
        def entry(e: C) -> C:
            name = e["key"] if prefix is None else F.concat(prefix, F.lit("_"), e["key"])
            return _entry(name, e["value"], s["values"][e["key"]])

        return F.transform(F.map_entries(s["texts"]), entry)

    return F.flatten(F.transform(F.array(both), expand))


def _nested(e: C) -> C:
    return V.is_object(e["t"], e["v"])


def _opened(rows: DataFrame, depth: int) -> DataFrame:
    """``_cells``: cells of each row with ``depth`` levels of nested objects opened."""
    t, v = F.col("_t"), F.col("_v")
    one = F.array(_entry(F.lit("col_1"), t, v))
    out = rows.withColumn("_cells", F.when(V.is_object(t, v), _members(t, v, None)).otherwise(one))
    for _ in range(depth):
        # One reference to the column per level, so that inlining a level into
        # the next (as filter pushdown does) never multiplies the work.
        opened = F.transform(
            "_cells", lambda e: F.when(_nested(e), _members(e["t"], e["v"], e["key"])).otherwise(F.array(e))
        )
        out = out.withColumn("_cells", F.flatten(opened))
    return out


def nesting(rows: DataFrame) -> int:
    """Levels of nested objects to open until none is left in any row.

    A row has no more levels than braces beside its own. Only where that
    count is large are the rows themselves asked, some levels at a time.
    """
    braces = F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("{"), F.lit("")))
    depth = max((rows.agg(F.max(braces)).first()[0] or 0) - 1, 0)
    if depth <= LEVELS:
        return depth
    depth = LEVELS
    while not _opened(rows, depth).where(F.exists("_cells", _nested)).isEmpty():
        depth += LEVELS
    return depth


def flatten_rows(rows: DataFrame) -> DataFrame:
    """Replace ``_t``/``_v`` by ``cells``: array of key, text and kind.

    Members of nested objects, however deep, are joined to their parent by
    ``_``; arrays stay as JSON text. A row that is not an object is a single
    cell ``col_1``.
    """
    out = _opened(rows, nesting(rows))
    cells = F.transform(
        "_cells",
        lambda e: F.struct(e["key"].alias("key"), e["t"].alias("text"), V.kind(e["v"]).alias("kind")),
    )
    return out.withColumn("cells", cells).drop("_t", "_v", "_cells")


def cell_map(cells: C) -> C:
    """Cells by key; of a repeated key the last one counts."""
    keys = F.transform(cells, lambda c: c["key"])
    distinct = F.array_distinct(keys)
    last = F.transform(distinct, lambda k: F.element_at(F.filter(cells, lambda c: c["key"] == k), -1))
    return F.when(
        F.size(distinct) == F.size(keys), F.map_from_arrays(keys, cells)
    ).otherwise(F.map_from_arrays(distinct, last))


def array_keys(rows: DataFrame) -> DataFrame:
    """Distinct keys that hold an array in any row."""
    return (
        rows.select(F.explode_outer("cells").alias("c"))
        .groupBy("c.key")
        .agg(F.bool_or(F.col("c.kind") == "array").alias("is_array"))
        .where("is_array")
        .select("key")
    )


def normalize_json(rows: DataFrame, source: str, json_number_text: bool = False) -> NormalizedTable:
    """Normalise flattened rows (``_row``, ``cells``).

    Numeric literals stay numbers; ``json_number_text`` reads them as text
    instead, as if they had been quoted.
    """
    headers = header_union(rows, F.transform("cells", lambda c: c["key"]))
    if not headers:
        raise UnprocessableContent("the payload has no rows")
    arrays = {r["key"] for r in array_keys(rows).collect()}
    keys = header_keys(headers)
    named = rows.select(ROW, cell_map(F.col("cells")).alias("_m"))
    cells = [F.col("_m")[h]["text"] for h in headers]
    literals: list[C | None] = [None] * len(headers)
    if not json_number_text:
        literals = [
            F.when(F.col("_m")[h]["kind"] == "number", F.col("_m")[h]["text"].try_cast("double")) for h in headers
        ]
    json_keys = frozenset(k for k, h in zip(keys, headers) if h in arrays)
    return normalize_table(named, headers, cells, source, json_keys, literals)


@dataclass(frozen=True)
class JsonTable:
    """A JSON dataset and the payloads that gave no rows."""

    table: NormalizedTable
    rejects: DataFrame


def read_json(
    payloads: DataFrame, source: str, path: str | None = None, any_shape: bool = True, order: str = "payload_id"
) -> JsonTable:
    """Normalise all rows of a frame of payloads, in payload order.

    ``any_shape`` accepts the three shapes of :func:`locate_rows`; otherwise
    the payload, or its part at ``path``, must be an array.
    """
    parsed = parse_payloads(payloads)
    located = locate_rows(parsed) if any_shape and not path else follow_path(parsed, path)
    # Headers, types and rows each read the cells: parse once, read thrice.
    rows = stage(flatten_rows(explode_rows(located, [order])), "json")
    rejects = payload_rejects(located, [order])
    # One count per payload gives its offset: payloads are files, not rows.
    return JsonTable(normalize_json(numbered(rows, order), source), rejects)


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``_row`` and ``cells`` of flattened rows, in the order of their payloads and positions."""
    sizes = rows.groupBy(order).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_min"))
    offsets = group_offsets(sizes, [order], "_n")
    place = F.col("_offset") + F.col("_pos") - F.col("_min")
    return rows.join(offsets, order).select(place.cast("bigint").alias(ROW), "cells")
