"""Dataset views: allow-listed filters, stable sort, projection, paging.

Every argument is checked before a plan is built. The plan itself is filter,
sort, offset/limit, select, so column pruning and predicate pushdown reach
the parquet scan.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpress.errors import (
    FilterNotAllowed,
    InvalidPagination,
    SchemaMismatch,
    SortNotAllowed,
    ValueCastError,
)
from gridpress.functions.numbers import number_text
from gridpress.model import (
    CONTROL_PARAMS,
    ROW,
    SORT_DIRECTIONS,
    Column,
    Definition,
    SortRule,
    columns_of,
)
from gridpress.session import stage

# Accepted literal texts.
TRUE_VALUES = ("true", "1")
FALSE_VALUES = ("false", "0")
DATE_VALUE = re.compile(r"\d{4}-\d{2}-\d{2}([T ].*)?", re.DOTALL)
NUMBER_VALUE = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
RADIX_VALUE = re.compile(r"0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)")



# --- literals -------------------------------------------------------------


def cast_literal(raw: str, column_type: str, param: str):
    """Typed Python value of a request text, by the type of its column."""
    value = raw.strip()
    if column_type == "number":
        if RADIX_VALUE.fullmatch(value):
            return float(int(value, 0))
        if not NUMBER_VALUE.fullmatch(value) or float(value) in (float("inf"), -float("inf")):
            raise ValueCastError(f"'{param}' needs a number, got '{raw}'", param=param)
        return float(value)
    if column_type == "boolean":
        if value.lower() in TRUE_VALUES:
            return True
        if value.lower() in FALSE_VALUES:
            return False
        raise ValueCastError(f"'{param}' needs true or false, got '{raw}'", param=param)
    if column_type == "date":
        try:
            if not DATE_VALUE.fullmatch(value):
                raise ValueError(value)
            instant = datetime.fromisoformat(value)
        except ValueError:
            raise ValueCastError(f"'{param}' needs an ISO date, got '{raw}'", param=param) from None
        if instant.tzinfo is None:
            instant = instant.replace(tzinfo=timezone.utc)
        return instant.astimezone(timezone.utc)
    return value


def split_list(raw: str, param: str) -> list[str]:
    parts = [p.strip() for p in raw.split(",")]
    parts = [p for p in parts if p]
    if not parts:
        raise ValueCastError(f"'{param}' needs at least one value", param=param)
    return parts


def _literal_text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"
    return str(value)


def _literal(value, spark_type: T.DataType) -> C:
    """A literal of the column's own Spark type, so the comparison pushes down."""
    if isinstance(value, datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
        return F.lit(text if not isinstance(spark_type, T.TimestampType) else text + "Z").cast(spark_type)
    if isinstance(value, float) and isinstance(spark_type, T.IntegralType) and value.is_integer():
        return F.lit(int(value))
    return F.lit(value)


# --- predicates -----------------------------------------------------------

#: A longer list of values is a frame that is joined, so the plan stays as small as for a short one.
INLINE_VALUES = 500


def listed_values(spark: SparkSession, values: list, spark_type: T.DataType, name: str) -> DataFrame:
    """The distinct values of a list as a frame of one column, of a type that compares with the field's."""
    if isinstance(values[0], datetime):
        zone = "Z" if isinstance(spark_type, T.TimestampType) else ""
        texts = {v.strftime("%Y-%m-%d %H:%M:%S.%f") + zone for v in values}
        return spark.createDataFrame([(t,) for t in sorted(texts)], f"{name} string").select(F.col(name).cast(spark_type))
    if isinstance(values[0], float):
        whole = isinstance(spark_type, T.IntegralType) and all(v.is_integer() and abs(v) < 2**63 for v in values)
        numbers = {int(v) for v in values} if whole else set(values)
        return spark.createDataFrame([(v,) for v in sorted(numbers)], f"{name} {'bigint' if whole else 'double'}")
    return spark.createDataFrame([(v,) for v in sorted(set(values))], f"{name} {'boolean' if isinstance(values[0], bool) else 'string'}")



def cell_text(c: C, column_type: str) -> C:
    """Text form of a cell, as compared by ``contains`` and ``starts_with``."""
    if column_type == "number":
        return number_text(c)
    if column_type == "date":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return c.cast("string")


def predicate(c: C, column_type: str, spark_type: T.DataType, op: str, value) -> C:
    """Filter condition for one rule; ``value`` is typed already."""
    if op in ("gt", "gte", "lt", "lte", "between") and column_type not in ("number", "date"):
        # Ranges are defined on numbers and instants only.
        return F.lit(False)
    if op == "in":
        return c.isin([_literal(v, spark_type) for v in value])
    if op == "between":
        low, high = (_literal(v, spark_type) for v in value)
        return c.between(low, high)
    if op == "contains":
        return F.contains(F.lower(cell_text(c, column_type)), F.lit(_literal_text(value).lower()))
    if op == "starts_with":
        return F.startswith(F.lower(cell_text(c, column_type)), F.lit(_literal_text(value).lower()))
    literal = _literal(value, spark_type)
    if op == "eq":
        return c == literal
    if op == "ne":
        return ~c.eqNullSafe(literal)
    return {"gt": c > literal, "gte": c >= literal, "lt": c < literal, "lte": c <= literal}[op]


# --- request parsing ------------------------------------------------------


@dataclass(frozen=True)
class Request:
    """A checked request: typed filters, sort, projection and page."""

    page: int
    limit: int
    sort: tuple[SortRule, ...]
    filters: tuple[tuple[str, str, object], ...]
    fields: tuple[str, ...] | None

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.limit


def _text(value) -> str:
    return ",".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)


def _whole_number(params: dict, name: str) -> int:
    raw = _text(params[name])
    if not re.fullmatch(r"-?[0-9]+", raw.strip()):
        raise InvalidPagination(f"'{name}' must be a whole number, got '{raw}'", param=name)
    number = int(raw)
    if number < 1:
        raise InvalidPagination(f"'{name}' must be at least 1, got '{raw}'", param=name)
    return number


def parse_request(params: dict, definition: Definition, columns: list[Column]) -> Request:
    """Check a whole request; the first failing check decides the error."""
    types = {c.key: c.type for c in columns}
    # A sort-only column is not a filter, so naming it as a parameter is refused.
    allowed = set(CONTROL_PARAMS) | {f.field for f in definition.filters}
    for name in params:
        if name not in allowed:
            raise FilterNotAllowed(f"parameter '{name}' is not allowed", param=name)

    def known(field: str, where: str) -> None:
        if field not in types:
            raise SchemaMismatch(f"column '{field}' ({where}) is not in the dataset", field=field, where=where)

    fields = definition.fields
    for i, name in enumerate(fields or ()):
        known(name, f"fields[{i}]")
    if "fields" in params:
        requested = tuple(p.strip() for p in _text(params["fields"]).split(",") if p.strip())
        permitted = fields if fields is not None else tuple(types)
        for name in requested:
            if name not in permitted:
                raise FilterNotAllowed(f"column '{name}' is outside the projection", param="fields")
        fields = requested

    page = _whole_number(params, "page") if "page" in params else 1
    limit = _whole_number(params, "limit") if "limit" in params else definition.default_limit
    if "limit" in params and limit > definition.max_limit:
        raise InvalidPagination(f"limit {limit} exceeds {definition.max_limit}", param="limit")

    sortable = [s.field for s in definition.sort]
    for i, name in enumerate(sortable):
        known(name, f"sort[{i}].field")
    sort = []
    if "sort" in params:
        raw = params["sort"]
        for entry in raw if isinstance(raw, (list, tuple)) else [raw]:
            field, colon, direction = str(entry).rpartition(":")
            if not colon:
                field, direction = str(entry), "asc"
            if field not in sortable or direction not in SORT_DIRECTIONS:
                raise SortNotAllowed(f"sort '{entry}' is not allowed", allowed=sortable)
            sort.append(SortRule(field, direction))

    for i, rule in enumerate(definition.filters):
        known(rule.field, f"filters[{i}].field")
    filters = []
    for rule in definition.filters:
        if rule.field not in params:
            if rule.required:
                raise FilterNotAllowed(f"filter '{rule.field}' is required", param=rule.field)
            continue
        raw, kind = _text(params[rule.field]), types[rule.field]
        if rule.op in ("in", "between"):
            parts = split_list(raw, rule.field)
            if rule.op == "between" and len(parts) != 2:
                raise ValueCastError(f"'{rule.field}' needs two bounds, got '{raw}'", param=rule.field)
            value: object = [cast_literal(p, kind, rule.field) for p in parts]
        else:
            value = cast_literal(raw, kind, rule.field)
        filters.append((rule.field, rule.op, value))

    return Request(page, limit, tuple(sort), tuple(filters), fields)


# --- plan -----------------------------------------------------------------


def order_columns(sort: tuple[SortRule, ...], tie_break: list[str]) -> list[C]:
    """Sort keys with nulls last in both directions, ties by row position."""
    keys = [
        F.col(s.field).asc_nulls_last() if s.dir == "asc" else F.col(s.field).desc_nulls_last()
        for s in sort
    ]
    return keys + [F.col(t).asc_nulls_last() for t in tie_break]


#: Spark's offsets and limits are 32-bit numbers.
MAX_OFFSET = 2**31 - 1


def deep_page(df: DataFrame, order: list[C], offset: int, limit: int) -> DataFrame:
    """Rows ``offset..offset+limit`` of a total order, at any depth.

    The rows are range-partitioned on the full order (ties included, so no
    key value is hot), written once, and counted per part. Only the parts
    that overlap the page are read again; their rows are numbered by a window
    that sorts and spills, so no part is held in memory.
    """
    part, at = "_part", "_at"
    ranged = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    copy = stage(ranged, "page")
    # One count per range partition: bounded by the number of shuffle partitions.
    counts = sorted((r[part], r["count"]) for r in copy.groupBy(part).count().collect())
    before, wanted = 0, {}
    for p, n in counts:
        if before + n > offset and before < offset + limit:
            wanted[p] = before
        before += n
    if not wanted:
        return df.where(F.lit(False))
    near = copy.where(F.col(part).isin(list(wanted)))
    start = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col(part)]
    numbered = near.withColumn(at, start + F.row_number().over(W.partitionBy(part).orderBy(*order)))
    inside = numbered.where(F.col(at).between(offset + 1, offset + limit))
    return inside.orderBy(at).drop(part, at)


@dataclass(frozen=True)
class View:
    """Frames of one view request; nothing runs until a frame is consumed."""

    request: Request
    filtered: DataFrame
    order: list[C]
    projection: list[str]

    @property
    def ordered(self) -> DataFrame:
        """Every matching row in view order (for export)."""
        return self.filtered.orderBy(*self.order).select(*self.projection)

    @property
    def page(self) -> DataFrame:
        """The page asked for, as a sort with an offset and a limit.

        Beyond the row numbers that an offset can name, counted parts find it.
        """
        r = self.request
        if r.offset + r.limit > MAX_OFFSET:
            return self.deep_page()
        return self.filtered.orderBy(*self.order).offset(r.offset).limit(r.limit).select(*self.projection)

    def deep_page(self) -> DataFrame:
        """The same page for depths where sorting everything before it is too much.

        Writes the matching rows to scratch and counts them at once.
        """
        r = self.request
        return deep_page(self.filtered, self.order, r.offset, r.limit).select(*self.projection)

    @property
    def stats(self) -> DataFrame:
        """One row: total, count, page, limit, pages."""
        return page_stats(self.filtered, self.request.page, self.request.limit)


def page_stats(filtered: DataFrame, page: int, limit: int) -> DataFrame:
    """Counts of a page, taken after filtering and before slicing."""
    offset = (page - 1) * limit
    return filtered.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset)).cast("bigint").alias("count"),
        F.lit(page).cast("bigint").alias("page"),
        F.lit(limit).cast("bigint").alias("limit"),
        F.ceil(F.col("total") / limit).cast("bigint").alias("pages"),
    )


def view(
    df: DataFrame,
    definition: Definition,
    params: dict | None = None,
    columns: list[Column] | None = None,
    tie_break: list[str] | None = None,
) -> View:
    """Apply a definition and a request to a dataset.

    ``tie_break`` defaults to the persisted row position; pass a unique key
    for tables without one.
    """
    columns = columns or columns_of(df)
    request = parse_request(params or {}, definition, columns)
    types = {c.key: c.type for c in columns}
    spark_types = {f.name: f.dataType for f in df.schema.fields}
    long = [f for f in request.filters if f[1] == "in" and len(f[2]) > INLINE_VALUES]
    conditions = [
        predicate(F.col(field), types[field], spark_types[field], op, value)
        for field, op, value in request.filters
        if (field, op, value) not in long
    ]
    filtered = df.where(functools.reduce(operator.and_, conditions)) if conditions else df
    for field, _, values in long:
        name = "_listed"
        while name in df.columns:
            name += "_"
        listed = listed_values(df.sparkSession, values, spark_types[field], name)
        filtered = filtered.join(listed, F.col(field) == F.col(name), "left_semi")
    order = order_columns(request.sort, tie_break or [ROW])
    projection = list(request.fields if request.fields is not None else [c.key for c in columns])
    return View(request, filtered, order, projection)


def project(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Every listed column in order; one a frame lacks becomes null."""
    have = set(df.columns)
    return df.select(
        [
            (F.col(c.key) if c.key in have else F.lit(None).cast(c.field().dataType)).alias(c.key)
            for c in columns
        ]
    )
