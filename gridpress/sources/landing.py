"""Landed files: manifest, size guard, reader choice and raw archive."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpress.functions.urls import reader_for, url_extension
from gridpress.model import DEFAULT_MAX_BYTES

log = logging.getLogger(__name__)


def manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files under a path: ``path, modified, bytes``. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def size_guard(files: DataFrame, size: str = "bytes", max_bytes: int | None = DEFAULT_MAX_BYTES) -> DataFrame:
    """Add ``accepted``: the payload is no larger than the limit; None sets no limit."""
    return files.withColumn("accepted", F.lit(True) if max_bytes is None else F.col(size) <= max_bytes)


def dispatch(files: DataFrame, content_type: str, hint: str, url: str) -> DataFrame:
    """Add ``reader`` (pdf, json, csv or null for unsupported) and ``delimiter``."""
    reader = reader_for(F.col(content_type), F.col(hint), F.col(url))
    tab = F.when(F.col("reader") == "csv", F.when(url_extension(F.col(url)) == "tsv", F.lit("\t")).otherwise(F.lit(",")))
    return files.withColumn("reader", reader).withColumn("delimiter", tab)


def read_payloads(spark: SparkSession, path: str | list[str], max_bytes: int | None = DEFAULT_MAX_BYTES) -> DataFrame:
    """Whole text payloads, one per file: ``payload_id`` (path), ``payload``.

    The size filter reaches the file listing, so oversized files are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return files.select(F.col("path").alias("payload_id"), F.decode("content", "UTF-8").alias("payload"))


def archive(spark: SparkSession, path: str | list[str], target: str, source_id: str, at: str) -> bool:
    """Keep the raw payloads of an ingest; a failure is logged, not raised.

    Losing the archive is less bad than losing the ingest it documents.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        stamped = files.withColumn("source_id", F.lit(source_id)).withColumn("ingested_at", F.lit(at))
        stamped.write.partitionBy("source_id", "ingested_at").mode("append").parquet(target)
    except Exception:  # noqa: BLE001
        log.exception("raw payloads of source %s were not archived", source_id)
        return False
    return True
