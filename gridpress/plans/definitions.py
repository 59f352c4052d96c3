"""View definitions checked against the datasets they would serve, in bulk.

``definitions``: definition_id, slug, source_id, dataset_id, follow_latest,
fields array<string>, filters array<struct<field,op,required>>,
sort array<struct<field,dir>>, default_limit, max_limit, enabled.
``columns``: dataset_id, pos, key, type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.functions.text import KEY_PATTERN, SLUG_MAX, SLUG_MIN, SLUG_PATTERN
from gridpress.model import FILTER_OPS, MAX_LIMIT, SORT_DIRECTIONS
from gridpress.plans.catalog import latest_published

# How many entries a definition may list.
MAX_FIELDS, MAX_FILTERS, MAX_SORTS = 200, 50, 20


def resolve(definitions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Definitions with the dataset each would serve now.

    A pinned dataset counts unless the definition follows the latest. Adds
    ``resolved`` (struct or null) and ``reason`` (null when resolved).
    """
    keep = ["dataset_id", "version", "status", "row_count", "source_id"]
    pinned = datasets.select(F.col("dataset_id").alias("_pin"), F.struct(*keep).alias("_pinned"))
    latest = latest_published(datasets, ("dataset_id", "version", "status", "row_count")).select(
        F.col("source_id").alias("_src"),
        F.struct("dataset_id", "version", "status", "row_count", "source_id").alias("_latest"),
    )
    follows = F.col("follow_latest") | F.col("dataset_id").isNull()
    # A definition that follows the latest has no use for the pinned row.
    pin = F.when(~follows, F.col("dataset_id"))
    joined = definitions.withColumn("_want", pin).join(pinned, F.col("_want") == F.col("_pin"), "left")
    joined = joined.join(latest, F.col("source_id") == F.col("_src"), "left")
    resolved = F.when(follows, F.col("_latest")).otherwise(F.col("_pinned"))
    missing = F.when(follows, F.lit("no-published")).otherwise(F.lit("dataset-not-found"))
    return joined.select(
        *definitions.columns,
        resolved.alias("resolved"),
        F.when(resolved.isNull(), missing).alias("reason"),
    )


def resolved_summary(resolved: DataFrame) -> DataFrame:
    return resolved.select(
        "definition_id",
        F.col("resolved.dataset_id").alias("dataset_id"),
        F.col("resolved.version").alias("version"),
        F.col("resolved.status").alias("status"),
        F.col("resolved.row_count").alias("row_count"),
        "reason",
    )


def declared_fields(resolved: DataFrame) -> DataFrame:
    """Every column a definition names, with where it names it."""
    fields = F.coalesce(F.col("fields"), F.expr("cast(array() as array<string>)"))
    places = F.concat(
        F.transform(fields, lambda x, i: F.struct(x.alias("field"), F.format_string("fields[%d]", i).alias("where"))),
        F.transform(
            "filters", lambda x, i: F.struct(x["field"].alias("field"), F.format_string("filters[%d].field", i).alias("where"))
        ),
        F.transform(
            "sort", lambda x, i: F.struct(x["field"].alias("field"), F.format_string("sort[%d].field", i).alias("where"))
        ),
    )
    return resolved.select(
        "definition_id", F.col("resolved.dataset_id").alias("dataset_id"), F.explode(places).alias("p")
    ).select("definition_id", "dataset_id", "p.field", "p.where")


def unknown_fields(resolved: DataFrame, columns: DataFrame) -> DataFrame:
    """Declared columns the resolved dataset lacks, with their location."""
    known = columns.select("dataset_id", F.col("key").alias("field"))
    named = declared_fields(resolved.where(F.col("resolved").isNotNull()))
    return named.join(known, ["dataset_id", "field"], "left_anti").select("definition_id", "dataset_id", "field", "where")


def offending_columns(unknown: DataFrame) -> DataFrame:
    """Distinct unknown columns of each definition, sorted."""
    return unknown.groupBy("definition_id").agg(F.sort_array(F.collect_set("field")).alias("columns"))


def unexposed_columns(resolved: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns of the resolved dataset a definition's projection leaves out."""
    served = resolved.where(F.col("resolved").isNotNull()).select(
        "definition_id", F.col("resolved.dataset_id").alias("dataset_id"), "fields"
    )
    return (
        served.join(columns.select("dataset_id", "key"), "dataset_id")
        .where(~F.array_contains(F.coalesce("fields", F.expr("cast(array() as array<string>)")), F.col("key")))
        .select("definition_id", "dataset_id", "key")
    )


def validation_report(resolved: DataFrame, columns: DataFrame) -> DataFrame:
    """One record per definition: valid, what it serves, and why not."""
    unknown = unknown_fields(resolved, columns).groupBy("definition_id").agg(
        F.sort_array(F.collect_list("where")).alias("unknown")
    )
    status = F.col("resolved.status")
    reason = F.coalesce(
        F.col("reason"), F.when(status != "published", F.concat(F.lit("dataset-"), status))
    )
    return resolved.join(unknown, "definition_id", "left").select(
        "definition_id",
        (F.col("unknown").isNull() & reason.isNull()).alias("valid"),
        F.col("resolved.dataset_id").alias("dataset_id"),
        F.col("resolved.version").alias("version"),
        status.alias("status"),
        F.coalesce("unknown", F.expr("cast(array() as array<string>)")).alias("unknown"),
        reason.alias("reason"),
    )


def serveability(resolved: DataFrame) -> DataFrame:
    """What a request to each slug would meet: served, or the reason not."""
    outcome = (
        F.when(~F.col("enabled"), F.lit("slug-not-found"))
        .when(F.col("resolved").isNull(), F.col("reason"))
        .when(F.col("resolved.status") != "published", F.concat(F.lit("dataset-"), F.col("resolved.status")))
        .otherwise(F.lit("served"))
    )
    return resolved.select("definition_id", "slug", outcome.alias("outcome"))


def find_by_slug(requests: DataFrame, definitions: DataFrame) -> DataFrame:
    """Requests with the enabled definition of their slug; missing and disabled alike are null."""
    enabled = definitions.where("enabled").select("slug", "definition_id")
    return requests.join(enabled, "slug", "left")


def reference_errors(definitions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Pinned datasets that belong to another source than the definition."""
    owner = datasets.select("dataset_id", F.col("source_id").alias("owner_id"))
    return (
        definitions.where(F.col("dataset_id").isNotNull())
        .join(owner, "dataset_id")
        .where(F.col("owner_id") != F.col("source_id"))
        .select("definition_id", "dataset_id", "source_id", "owner_id")
    )


def definition_checks(definitions: DataFrame, ceiling: int = MAX_LIMIT) -> DataFrame:
    """First failing check of each definition as ``error``; null when sound."""
    taken = definitions.groupBy("slug").agg(F.count(F.lit(1)).alias("_uses")).where("_uses > 1")
    size = lambda name: F.coalesce(F.size(name), F.lit(0))
    bad_field = F.exists("filters", lambda f: ~f["field"].rlike(KEY_PATTERN)) | F.exists(
        "sort", lambda s: ~s["field"].rlike(KEY_PATTERN)
    )
    bad_rule = F.exists("filters", lambda f: ~f["op"].isin(*FILTER_OPS)) | F.exists(
        "sort", lambda s: ~s["dir"].isin(*SORT_DIRECTIONS)
    )
    too_many = (size("fields") > MAX_FIELDS) | (size("filters") > MAX_FILTERS) | (size("sort") > MAX_SORTS)
    error = (
        F.when(~F.length("slug").between(SLUG_MIN, SLUG_MAX), F.lit("SLUG_LENGTH"))
        .when(~F.col("slug").rlike(SLUG_PATTERN), F.lit("SLUG_INVALID"))
        .when(too_many, F.lit("TOO_MANY_ENTRIES"))
        .when(bad_field, F.lit("FIELD_INVALID"))
        .when(bad_rule, F.lit("RULE_INVALID"))
        .when((F.col("default_limit") < 1) | (F.col("max_limit") < 1), F.lit("LIMIT_BELOW_ONE"))
        .when(
            (F.col("default_limit") > F.col("max_limit")) | (F.col("max_limit") > ceiling), F.lit("LIMITS_INVALID")
        )
        .when(~F.col("follow_latest") & F.col("dataset_id").isNull(), F.lit("DATASET_REQUIRED"))
        .when(F.col("_uses").isNotNull(), F.lit("SLUG_TAKEN"))
    )
    return definitions.join(taken, "slug", "left").select("definition_id", "slug", error.alias("error"))
