"""Delimited text files to raw tables, ragged rows included."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpress.errors import UnprocessableContent
from gridpress.model import ROW
from gridpress.operators.normalize import PHASE_SHAPE, NormalizedTable, normalize_table
from gridpress.session import stage
from gridpress.sources.records import quoted_records
from gridpress.sources.rowids import group_offsets, with_row_position

_BAD = "_bad"


@dataclass(frozen=True)
class RawTable:
    """Text cells by position, with headers and ragged-row warnings."""

    rows: DataFrame
    headers: list[str]
    warnings: DataFrame

    @property
    def cells(self) -> list[C]:
        return [F.col(f"c{i}") for i in range(len(self.headers))]


def _schema(width: int) -> str:
    return ", ".join([*[f"c{i} string" for i in range(width)], f"{_BAD} string"])


def _reader(spark: SparkSession, width: int, delimiter: str, header: bool):
    return spark.read.schema(_schema(width)).options(**_options(delimiter)).option("header", header)


def _options(delimiter: str) -> dict[str, str]:
    return {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "maxCharsPerColumn": "-1"}


def cell_count(record: C, delimiter: str) -> C:
    """Number of cells in a raw record; delimiters inside quotes do not count."""
    bare = F.regexp_replace(record, '"(?:[^"]++|"")*+"', "")
    return F.size(F.split(bare, re.escape(delimiter)))


def _first_record(spark: SparkSession, path, delimiter: str) -> str | None:
    """Raw text of the first record of the first file, by path."""
    # Listing only: the content column is pruned.
    first = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]
    if first is None:
        return None
    head = (
        _reader(spark, 1, delimiter, header=False)
        .csv(first)
        .select(F.coalesce(_BAD, "c0").alias("record"), F.col("_metadata.file_block_start").alias("at"))
        .where("at = 0")
        .select("record")
        .limit(1)
        .collect()
    )
    return head[0]["record"] if head else None


def _one_header(spark: SparkSession, path, delimiter: str, header: str) -> None:
    """Refuse files whose first record differs: cells are read by position."""
    scan = _reader(spark, 1, delimiter, header=False).csv(path)
    heads = (
        scan.select(
            F.coalesce(_BAD, "c0").alias("record"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("at"),
        )
        .withColumn("id", F.monotonically_increasing_id())
        .where("at = 0")
        .groupBy("file")
        .agg(F.min_by("record", "id").alias("record"))
    )
    other = heads.where(F.ltrim(F.col("record"), F.lit("\ufeff")) != header.lstrip("\ufeff")).take(1)
    if other:
        raise UnprocessableContent(f"another header in {other[0]['file']}", file=other[0]["file"])


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = ",",
    has_header: bool = True,
    multi_line: bool = False,
) -> RawTable:
    """Read delimited files as one table, in path and file order.

    Every file starts with the same header when there is one; a file with
    another is refused. Short rows are
    padded with nulls and long rows cut to the header; both are reported.
    ``multi_line`` allows line breaks inside quotes; a file is then read by
    as many tasks as without (see ``records``).
    """
    delimiter = delimiter or ","
    if multi_line:
        return _read_records(spark, path, delimiter, has_header)
    record = _first_record(spark, path, delimiter)
    if record is None:
        raise UnprocessableContent("the file has no rows")
    if has_header:
        headers = next(csv.reader([record.lstrip("\ufeff")], delimiter=delimiter))
        _one_header(spark, path, delimiter, record)
    else:
        probe = _reader(spark, 1, delimiter, header=False).csv(path)
        cells = F.when(F.col(_BAD).isNull(), F.lit(1)).otherwise(cell_count(F.col(_BAD), delimiter))
        # A query of the malformed-record column alone is refused, hence c0.
        width = probe.select(cells.alias("n"), "c0").agg(F.max("n"), F.count("c0")).first()[0]
        headers = [f"col_{i + 1}" for i in range(width)]

    width = len(headers)
    scan = _reader(spark, width, delimiter, has_header).csv(path)
    rows = with_row_position(scan)
    if rows.isEmpty():
        raise UnprocessableContent("the file has only a header" if has_header else "the file has no rows")
    return _table(rows, headers, delimiter)


def _table(rows: DataFrame, headers: list[str], delimiter: str) -> RawTable:
    """``rows`` with cells by position and ``_bad``, the text of a ragged record, as a table."""
    width = len(headers)
    found = cell_count(F.col(_BAD), delimiter)
    warnings = rows.where(F.col(_BAD).isNotNull()).select(
        F.lit(PHASE_SHAPE).alias("phase"),
        ROW,
        F.lit(None).cast("int").alias("col_pos"),
        F.lit("cell-count").alias("kind"),
        F.format_string("row %d had %d cells, expected %d", F.col(ROW) + 1, found, F.lit(width)).alias("detail"),
    )
    return RawTable(rows.drop(_BAD), headers, warnings)


def _read_records(spark: SparkSession, path: str | list[str], delimiter: str, has_header: bool) -> RawTable:
    """The table of records that may go over several lines."""
    # The first record decides the columns; all records are read again with them.
    records = stage(quoted_records(spark, path, delimiter), "records")
    mark = F.lit("\ufeff")
    text = F.when(F.col("_in_file") == 0, F.ltrim("record", mark)).otherwise(F.col("record"))
    heads = records.where("_in_file = 0").select("_file", "_rec", text.alias("record"))
    first = heads.orderBy("_rec").first()
    if first is None:
        raise UnprocessableContent("the file has no rows")
    if has_header:
        other = heads.where(F.col("record") != first["record"]).take(1)
        if other:
            raise UnprocessableContent(f"another header in {other[0]['_file']}", file=other[0]["_file"])
        headers = next(csv.reader([first["record"]], delimiter=delimiter))
        # Of the records before one, those that are headers: one for each file up to its own.
        files = group_offsets(heads.select("_file", F.lit(1).alias("_one")), ["_file"], "_one")
        body = records.where("_in_file > 0").join(files.select("_file", "_offset"), "_file")
        place = F.col("_rec") - F.col("_offset") - 1
    else:
        width = records.agg(F.max(cell_count(text, delimiter))).first()[0]
        headers = [f"col_{i + 1}" for i in range(width)]
        body, place = records, F.col("_rec")
    cells = F.from_csv(text, _schema(len(headers)), _options(delimiter)).alias("_cells")
    rows = body.select(place.cast("long").alias(ROW), cells).select(ROW, "_cells.*")
    if rows.isEmpty():
        raise UnprocessableContent("the file has only a header" if has_header else "the file has no rows")
    return _table(rows, headers, delimiter)


def normalize_delimited(table: RawTable, source: str) -> NormalizedTable:
    return normalize_table(table.rows, table.headers, table.cells, source, shape_warnings=table.warnings)
