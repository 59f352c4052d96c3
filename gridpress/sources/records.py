"""Records of delimited text with line breaks inside quotes, read by many tasks.

A file is read as lines, split wherever the file system splits it. Whether a
line begins inside a quoted cell depends on all lines before it, but what it
does to that state does not: for each of the two states it begins in, it ends
in one. Running windows compose these two-valued functions along a split, and
a small table composes them over the splits of each file. Once every split's
first state is known, so is which lines begin a record; lines of a record that
has several are brought together, all others stay where they are.

A quote opens a cell only as its first character, a doubled quote stands for
one, and after a closing quote the rest of the cell up to the delimiter is
taken as it is. Lines end with a line feed, or one after a carriage return;
where the first line of a file ends so, such an end inside quotes reads as a
line feed, elsewhere it is kept. Blank lines outside quotes
are no records. A quote that is never closed takes the rest of its file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridpress.session import stage
from gridpress.sources.rowids import group_offsets


def ends_inside(line: C, delimiter: str) -> tuple[C, C]:
    """Whether a line ends inside quotes if it begins outside of them, and if it begins inside."""
    d = re.escape(delimiter)
    bare = f"[^{d}]" if len(delimiter) == 1 else f"(?s:(?!{d}).)"
    # Possessive loops: a cell is read in one way only, without going back.
    quoted = '[^"]*+(?:""[^"]*+)*+'
    cell = f'(?:"{quoted}"{bare}*+|(?:(?!"){bare}{bare}*+)?)'
    opened = f'(?:{cell}{d})*+"{quoted}$'
    closed = line.rlike(f'^{quoted}"')
    again = line.rlike(f'^{quoted}"{bare}*+{d}{opened}')
    return line.rlike(f"^{opened}"), ~closed | again


def _composed(rows: DataFrame, part: list[str], order: list[str], f0: C, f1: C) -> DataFrame:
    """Add ``_base`` and ``_flips``, the composition of a row's function and all before it in its part.

    The state after a row is ``_base``, or where that is null the part's
    first state, turned over ``_flips`` times; ``_base_before`` and
    ``_flips_before`` are those of the row before.
    """
    w = W.partitionBy(*part).orderBy(*order)
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"_f0": f0, "_f1": f1})
    flips = (F.col("_f0") & ~F.col("_f1")).cast("long")
    rows = rows.withColumns({"_flips": F.sum(flips).over(upto), "_flips_before": F.coalesce(F.sum(flips).over(before), F.lit(0))})
    # A function of one value forgets what was before; the value is kept as if no flip had been.
    fixed = F.when(F.col("_f0") == F.col("_f1"), _turned(F.col("_f0"), F.col("_flips")))
    return rows.withColumns({"_base": F.last(fixed, True).over(upto), "_base_before": F.last(fixed, True).over(before)}).drop("_f0", "_f1")


def _turned(state: C, flips: C) -> C:
    return state != (flips % 2 == 1)


def _after(first: C, base: C, flips: C) -> C:
    return _turned(F.coalesce(base, first), flips)


def quoted_records(spark: SparkSession, path: str | list[str], delimiter: str) -> DataFrame:
    """``_file``, ``_rec`` (0-based over all files, in path order), ``_in_file`` (0-based) and ``record``."""
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = scan.select(
        F.col("value").alias("_line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).withColumn("_id", F.monotonically_increasing_id())
    f0, f1 = ends_inside(F.col("_line"), delimiter)
    split = ["_file", "_block"]
    lines = _composed(lines, split, ["_id"], f0, f1)
    # Record starts counted under both first states, in the same order.
    upto = W.partitionBy(*split).orderBy("_id").rowsBetween(W.unboundedPreceding, 0)
    text = F.rtrim(F.col("_line"), F.lit("\r")) != ""
    starts = [(~_after(F.lit(s), F.col("_base_before"), F.col("_flips_before")) & text).cast("long") for s in (False, True)]
    lines = lines.withColumns({f"_n{s}": F.sum(starts[s]).over(upto) for s in (0, 1)})
    lines = stage(lines, "lines")

    splits = lines.groupBy(*split).agg(
        F.max("_n0").alias("_n0"), F.max("_n1").alias("_n1"),
        F.max_by(F.struct("_base", "_flips"), "_id").alias("_all"), F.min_by(F.endswith("_line", F.lit("\r")), "_id").alias("_cr"),
    )
    end = [_after(F.lit(s), F.col("_all._base"), F.col("_all._flips")) for s in (False, True)]
    splits = _composed(splits.drop("_base", "_flips"), ["_file"], ["_block"], *end)
    splits = splits.withColumn("_first", _after(F.lit(False), F.col("_base_before"), F.col("_flips_before")))
    splits = stage(splits.select(*split, "_first", "_cr", F.when(F.col("_first"), F.col("_n1")).otherwise(F.col("_n0")).alias("_n")), "splits")
    offsets = group_offsets(splits, split, "_n")
    files = offsets.groupBy("_file").agg(F.min("_offset").alias("_file_offset"), F.min_by("_cr", "_block").alias("_file_cr"))
    offsets = stage(offsets.join(files, "_file"), "offsets")

    rows = lines.join(offsets, split)
    before = _after(F.col("_first"), F.col("_base_before"), F.col("_flips_before"))
    after = _after(F.col("_first"), F.col("_base"), F.col("_flips"))
    number = F.col("_offset") + F.when(F.col("_first"), F.col("_n1")).otherwise(F.col("_n0")) - 1
    one = ["_file", "_file_offset", "_file_cr"]
    rows = rows.select(*one, "_block", "_id", "_line", number.alias("_rec"), before.alias("_before"), after.alias("_after"))
    whole = rows.where(~F.col("_before") & ~F.col("_after") & text).select(*one, "_rec", F.col("_line").alias("record"))
    parts = rows.where("_before or _after").groupBy(*one, "_rec").agg(F.array_sort(F.collect_list(F.struct("_block", "_id", "_line"))).alias("_lines"))
    joined = parts.select(*one, "_rec", F.array_join(F.col("_lines._line"), "\n").alias("record"))
    record = F.rtrim("record", F.lit("\r"))
    record = F.when(F.col("_file_cr"), F.replace(record, F.lit("\r\n"), F.lit("\n"))).otherwise(record)
    return whole.union(joined).select("_file", "_rec", (F.col("_rec") - F.col("_file_offset")).alias("_in_file"), record.alias("record"))
