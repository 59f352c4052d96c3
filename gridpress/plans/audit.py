"""Allow-list checks applied to a table of logged requests.

``requests``: request_id, slug, params map<string, array<string>>. The
checks are expressions on the request row, so after the join to the
definitions nothing is exploded, grouped or shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.model import CONTROL_PARAMS, SORT_DIRECTIONS
from gridpress.operators.view import FALSE_VALUES, TRUE_VALUES

# Literal texts each column type accepts.
NUMBER_LITERAL = r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$"
DATE_LITERAL = r"(?s)^\d{4}-\d{2}-\d{2}([T ].*)?$"
WHOLE_NUMBER = "^-?[0-9]+$"


def served_definitions(resolved: DataFrame, columns: DataFrame) -> DataFrame:
    """Definitions with the column types of the dataset each serves.

    A dataset has few columns, so its types fit one map.
    """
    types = columns.groupBy(F.col("dataset_id").alias("_ds")).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "type"))).alias("types")
    )
    served = resolved.where("enabled").withColumn("_want", F.col("resolved.dataset_id"))
    return served.join(types, F.col("_want") == F.col("_ds"), "left").select(
        "slug",
        "definition_id",
        "fields",
        "filters",
        "sort",
        "max_limit",
        F.coalesce("types", F.expr("cast(map() as map<string,string>)")).alias("types"),
        F.coalesce(
            "reason",
            F.when(F.col("resolved.status") != "published", F.concat(F.lit("dataset-"), F.col("resolved.status"))),
        ).alias("unserved"),
    )


def _parts(text: C) -> C:
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


def _literal_ok(text: C, kind: C) -> C:
    value = F.trim(text)
    date = value.rlike(DATE_LITERAL) & F.try_to_timestamp(value).isNotNull()
    finite = F.abs(value.try_cast("double")) < F.lit(float("inf"))
    number = value.rlike(NUMBER_LITERAL) & F.coalesce(finite, F.lit(True))
    return (
        F.when(kind == "number", number)
        .when(kind == "boolean", F.lower(value).isin(*TRUE_VALUES, *FALSE_VALUES))
        .when(kind == "date", date)
        .otherwise(F.lit(True))
    )


def _value_ok(text: C, op: C, kind: C) -> C:
    parts = _parts(text)
    listed = F.forall(parts, lambda p: _literal_ok(p, kind))
    return (
        F.when(op == "between", (F.size(parts) == 2) & listed)
        .when(op == "in", (F.size(parts) > 0) & listed)
        .otherwise(_literal_ok(text, kind))
    )


def _whole(text: C) -> C:
    return F.when(F.trim(text).rlike(WHOLE_NUMBER), F.trim(text).try_cast("decimal(38,0)"))


def request_error() -> C:
    """Code of the first failing check, in the order requests are checked."""
    params, types = F.col("params"), F.col("types")
    value = lambda name: F.array_join(params[name], ",")
    absent = lambda field: ~F.map_contains_key(types, field)
    allowed = F.concat(
        F.array(*[F.lit(p) for p in CONTROL_PARAMS]), F.transform("filters", lambda f: f["field"])
    )
    unknown = F.exists(F.map_keys(params), lambda k: ~F.array_contains(allowed, k))

    has = lambda name: F.map_contains_key(params, F.lit(name))
    requested = _parts(value("fields"))
    permitted = F.coalesce(F.col("fields"), F.map_keys(types))
    escapes = has("fields") & F.exists(requested, lambda f: ~F.array_contains(permitted, f))
    missing_field = F.exists(F.coalesce("fields", F.expr("cast(array() as array<string>)")), absent)

    page, limit = _whole(value("page")), _whole(value("limit"))
    bad_page = has("page") & F.coalesce(page < 1, F.lit(True))
    bad_limit = has("limit") & F.coalesce((limit < 1) | (limit > F.col("max_limit")), F.lit(True))

    sortable = F.transform("sort", lambda s: s["field"])

    def bad_sort(entry: C) -> C:
        # The direction follows the last colon; without one it is ascending.
        split = entry.contains(":")
        field = F.when(split, F.regexp_extract(entry, "(?s)^(.*):[^:]*$", 1)).otherwise(entry)
        direction = F.when(split, F.substring_index(entry, ":", -1)).otherwise(F.lit("asc"))
        return ~F.array_contains(sortable, field) | ~direction.isin(*SORT_DIRECTIONS)

    sort_refused = has("sort") & F.exists(params["sort"], bad_sort)
    missing_sort = F.exists(sortable, absent)
    missing_filter = F.exists("filters", lambda f: absent(f["field"]))

    def filter_error(f: C) -> C:
        given = F.map_contains_key(params, f["field"])
        text = F.array_join(params[f["field"]], ",")
        return F.when(~given & F.coalesce(f["required"], F.lit(False)), F.lit("REQUIRED_FILTER_MISSING")).when(
            given & ~_value_ok(text, f["op"], types[f["field"]]), F.lit("VALUE_CAST_ERROR")
        )

    errors = F.array_compact(F.transform("filters", filter_error))
    return (
        F.when(F.col("definition_id").isNull(), F.lit("SLUG_NOT_FOUND"))
        .when(F.col("unserved").isNotNull(), F.lit("DATASET_NOT_SERVED"))
        .when(unknown, F.lit("FILTER_NOT_ALLOWED"))
        .when(missing_field, F.lit("SCHEMA_MISMATCH"))
        .when(escapes, F.lit("PROJECTION_NOT_ALLOWED"))
        .when(bad_page, F.lit("INVALID_PAGE"))
        .when(bad_limit, F.lit("INVALID_LIMIT"))
        .when(missing_sort, F.lit("SCHEMA_MISMATCH"))
        .when(sort_refused, F.lit("SORT_NOT_ALLOWED"))
        .when(missing_filter, F.lit("SCHEMA_MISMATCH"))
        .otherwise(F.get(errors, F.lit(0)))
    )


def request_audit(requests: DataFrame, resolved: DataFrame, columns: DataFrame) -> DataFrame:
    """``request_id``, ``slug`` and the ``error`` each request met, null when served."""
    return requests.join(served_definitions(resolved, columns), "slug", "left").select(
        "request_id", "slug", request_error().alias("error")
    )
