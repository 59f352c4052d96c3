"""Source configurations checked in bulk, before anything is ingested.

``sources``: source_id, type, config (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.functions import variants as V
from gridpress.functions.text import is_blank
from gridpress.functions.urls import is_http_url


def _get(name: str) -> C:
    return F.try_variant_get("_v", f"$.{name}", "variant")


def _is(name: str, wanted: str) -> C:
    return F.coalesce(V.kind(_get(name)) == wanted, F.lit(False))


def _absent_or(name: str, condition: C) -> C:
    return _get(name).isNull() | F.coalesce(condition, F.lit(False))


def _whole(v: C) -> C:
    number = F.try_variant_get(v, "$", "double")
    return (V.kind(v) == "number") & (number == F.floor(number))


def _items(name: str) -> C:
    return F.try_variant_get("_v", f"$.{name}", V.ARRAY)


def config_checks(sources: DataFrame) -> DataFrame:
    """``source_id`` and ``error``: null, or why the config does not fit its type."""
    text = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    has_url = _is("url", "string") & (text("url") != "")
    pages = F.forall(_items("pages"), lambda p: _whole(p) & (F.try_variant_get(p, "$", "double") > 0))
    hints = F.forall(_items("headerHints"), lambda h: V.kind(h) == "string")
    kind = F.col("type")
    shape = (
        F.when(kind == "manual", _is("format", "string") & text("format").isin("json", "csv") & _is("payload", "string"))
        .when(kind == "api", has_url & _is("method", "string") & text("method").isin("GET", "POST"))
        .when(kind == "url", has_url & _absent_or("contentTypeHint", V.kind(_get("contentTypeHint")) == "string"))
        .when(
            kind == "pdf",
            has_url
            & _absent_or("tableIndex", _whole(_get("tableIndex")))
            & _absent_or("pages", pages)
            & _absent_or("headerHints", hints),
        )
        .otherwise(F.lit(False))
    )
    address = text("url")
    error = (
        F.when(~F.coalesce((V.kind(F.col("_v")) == "object") & shape, F.lit(False)), F.lit("CONFIG_SHAPE"))
        .when((kind == "manual") & is_blank(text("payload")), F.lit("PAYLOAD_EMPTY"))
        .when((kind != "manual") & ~is_http_url(address), F.lit("URL_INVALID"))
    )
    return sources.withColumn("_v", F.try_parse_json("config")).select("source_id", error.alias("error"))
