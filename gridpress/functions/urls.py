"""URL and media-type expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridpress.functions.text import EDGE_SPACE

# Media types and file extensions each reader accepts.
MEDIA_TYPES = {
    "application/pdf": "pdf",
    "application/x-pdf": "pdf",
    "application/acrobat": "pdf",
    "application/json": "json",
    "text/json": "json",
    "application/ld+json": "json",
    "text/csv": "csv",
    "application/csv": "csv",
    "text/plain": "csv",
    "text/markdown": "csv",
}
EXTENSIONS = {
    "pdf": "pdf",
    "json": "json",
    "geojson": "json",
    "csv": "csv",
    "tsv": "csv",
    "txt": "csv",
}


def url_extension(url: Column) -> Column:
    """Lower-case extension of the last path segment; empty when none."""
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    segment = F.substring_index(path, "/", -1)
    # A dot in first place names a hidden file, not an extension.
    return F.lower(F.regexp_extract(segment, r"^[^/]+\.([^.]*)$", 1))


def media_type(content_type: Column) -> Column:
    """Media type without parameters, trimmed and in lower case."""
    return F.lower(F.regexp_replace(F.substring_index(content_type, ";", 1), EDGE_SPACE, ""))


def is_http_url(url: Column) -> Column:
    """True for well-formed http and https addresses."""
    return F.coalesce(
        F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https")
        & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != ""),
        F.lit(False),
    )


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key]


def reader_for(content_type: Column, hint: Column, url: Column) -> Column:
    """Which reader takes a payload: declared type, else hint, else extension.

    Null when none is known.
    """
    return F.coalesce(
        _lookup(media_type(content_type), MEDIA_TYPES),
        _lookup(media_type(hint), MEDIA_TYPES),
        _lookup(url_extension(url), EXTENSIONS),
    )
