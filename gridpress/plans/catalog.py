"""Questions asked of the catalog tables, for all sources at once.

``datasets``: dataset_id, source_id, version, status, row_count, created_at.
``sources``: source_id, name, type, status. ``definitions``: see
:mod:`gridpress.plans.definitions`.
"""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.model import SOURCE_STATUSES
from gridpress.operators.ordered import chunked_rank


def latest_published(datasets: DataFrame, keep: tuple[str, ...] = ("dataset_id", "version", "status", "row_count")) -> DataFrame:
    """Newest published version of each source; sources without one are absent."""
    newest = F.max_by(F.struct(*keep), F.col("version")).alias("d")
    return datasets.where(F.col("status") == "published").groupBy("source_id").agg(newest).select("source_id", "d.*")


def next_version(sources: DataFrame, datasets: DataFrame) -> DataFrame:
    """Version number the next ingest of every source gets."""
    newest = datasets.groupBy("source_id").agg(F.max("version").alias("_v"))
    return sources.select("source_id").join(newest, "source_id", "left").select(
        "source_id", (F.coalesce("_v", F.lit(0)) + 1).alias("next_version")
    )


def version_history(datasets: DataFrame) -> DataFrame:
    """Datasets with ``age``: 1 for the newest version of their source."""
    return chunked_rank(datasets, ["source_id"], "version", "age", descending=True)


def catalog_filter(df: DataFrame, **equals: object) -> DataFrame:
    """Equality filters on catalog columns; a filter given as None is absent."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def source_status_counts(sources: DataFrame) -> DataFrame:
    """One record per source status, zero included."""
    spark = sources.sparkSession
    every = spark.createDataFrame([(s,) for s in SOURCE_STATUSES], "status string")
    counts = sources.groupBy("status").agg(F.count(F.lit(1)).alias("_n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("_n", F.lit(0)).alias("n"))


def totals(sources: DataFrame, datasets: DataFrame, definitions: DataFrame) -> DataFrame:
    """Dashboard totals, as ``metric`` and ``n``."""

    def one(df: DataFrame, metric: str, condition: C) -> DataFrame:
        return df.agg(F.count_if(condition).alias("n")).select(F.lit(metric).alias("metric"), "n")

    return (
        one(sources, "sources", F.lit(True))
        .union(one(datasets, "published_datasets", F.col("status") == "published"))
        .union(one(definitions, "enabled_definitions", F.col("enabled")))
    )


def with_source_name(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``source_name``; an unknown source is named after its id."""
    named = sources.select("source_id", F.col("name").alias("_name"))
    fallback = F.concat(F.lit("source "), F.col("source_id").cast("string"))
    return df.join(named, "source_id", "left").select(*df.columns, F.coalesce("_name", fallback).alias("source_name"))


#: Listing order of each kind of record: its columns, "-" for descending. Ids break ties in the same direction.
LISTING = {"datasets": ("-version", "dataset_id"), "definitions": ("slug", "definition_id")}


def listing_order(kind: str, created: str = "created_at", key: str = "id") -> list[C]:
    """Sort keys of a listing: datasets by newest version, definitions by slug,
    any other kind newest first (by ``created``, then ``key``)."""
    order = LISTING.get(kind, (f"-{created}", f"-{key}"))
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in order]


def listing(df: DataFrame, kind: str, **names: str) -> DataFrame:
    """All records of a kind in the order they are listed."""
    return df.orderBy(*listing_order(kind, **names))


def recent_ingests(datasets: DataFrame, sources: DataFrame, n: int = 6) -> DataFrame:
    """The newest datasets, with the names of their sources and how many warnings they have.

    ``warnings_count`` is taken from the datasets, or counted from their
    ``warnings``; a dataset that has neither has none.
    """
    newest = listing(datasets, "ingests", key="dataset_id").limit(n)
    if "warnings_count" not in newest.columns:
        held = F.coalesce(F.size("warnings"), F.lit(0)) if "warnings" in newest.columns else F.lit(0)
        newest = newest.withColumn("warnings_count", F.greatest(held, F.lit(0)).cast("long"))
    return with_source_name(newest, sources)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def affected_definitions(definitions: DataFrame) -> DataFrame:
    """How many definitions, and how many enabled ones, each source feeds."""
    return definitions.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("definitions"), F.count_if("enabled").alias("enabled")
    )
