"""Row positions in file order, without sorting or gathering the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridpress.model import ROW
from gridpress.session import stage


def group_offsets(sizes: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add ``_offset``: rows in all groups that come before.

    ``sizes`` has one record per file split or payload. Those are cut into
    ranges of the order; each range is summed by its own task, and only the
    totals of the ranges (one per shuffle partition) meet in one place.
    """
    ranged = sizes.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    # Written first: range numbers must be the same for totals and records.
    copy = stage(ranged, "sizes")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    totals = copy.groupBy("_range").agg(F.sum(size).alias("_total"))
    base = totals.select(
        "_range", F.coalesce(F.sum("_total").over(before(W.orderBy("_range"))), F.lit(0)).alias("_base")
    )
    inside = F.coalesce(F.sum(size).over(before(W.partitionBy("_range").orderBy(*order))), F.lit(0))
    local = copy.withColumn("_inside", inside)
    return local.join(base, "_range").select(
        *sizes.columns, (F.col("_base") + F.col("_inside")).alias("_offset")
    )


def with_row_position(scan: DataFrame) -> DataFrame:
    """Add the 0-based ``_row`` of a file scan, in path and file order.

    Ids grow along each file split, so a row's place in its split is its id
    less the smallest id there. The scan is written first: the ids must be
    the same for the rows and for the counts, whatever is recomputed.
    """
    copy = stage(
        scan.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        ).withColumn("_id", F.monotonically_increasing_id()),
        "scan",
    )
    splits = copy.groupBy("_file", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    offsets = group_offsets(splits, ["_file", "_block"], "_n")
    place = F.col("_offset") + F.col("_id") - F.col("_first")
    return copy.join(offsets, ["_file", "_block"]).select(place.alias(ROW), *scan.columns)
