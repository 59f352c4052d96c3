"""Column headers taken from the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.errors import UnprocessableContent
from gridpress.model import ROW

def key_positions(df: DataFrame, keys: C, row: str = ROW) -> DataFrame:
    """Each distinct key with its first place ``(row, pos)``.

    ``keys`` is an ``array<string>``. Partial aggregation leaves one record
    per key and task before the shuffle, so common keys are never hot.
    """
    exploded = df.select(F.col(row).alias("_r"), F.posexplode_outer(keys).alias("_p", "key"))
    return exploded.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("_r", "_p")).alias("first"))


def header_union(df: DataFrame, keys: C, row: str = ROW, most: int | None = None) -> list[str]:
    """Distinct keys in order of first appearance (metadata on the driver).

    With ``most``, a payload of more distinct keys is refused as no table.
    """
    found = key_positions(df, keys, row).orderBy("first").select("key")
    names = [r["key"] for r in (found if most is None else found.limit(most + 1)).collect()]
    if most is not None and len(names) > most:
        raise UnprocessableContent(f"more than {most} distinct keys: not a table")
    return names


def widest_row(df: DataFrame, cells: C) -> int:
    """Greatest number of cells in any row."""
    return df.agg(F.max(F.size(cells))).first()[0] or 0
