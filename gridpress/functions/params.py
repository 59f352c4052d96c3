"""Canonical request parameters and the fingerprint of a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_params(params: Column) -> Column:
    """``k=v1|v2&...`` with keys sorted; ``params`` is map<string, array<string>>."""
    pairs = F.transform(
        F.array_sort(F.map_keys(params)),
        lambda k: F.concat(k, F.lit("="), F.array_join(params[k], "|")),
    )
    return F.array_join(pairs, "&")


def fingerprint(dataset_id: Column, version: Column, canonical: Column) -> Column:
    """First 32 hex digits of SHA-256 over dataset, version and parameters."""
    material = F.concat_ws("|", dataset_id.cast("string"), version.cast("string"), canonical)
    return F.substring(F.sha2(material, 256), 1, 32)
