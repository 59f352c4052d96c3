"""Plain descriptions of columns and view definitions (metadata, never rows)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Enumerations and limits shared by every job.
COLUMN_TYPES = ("string", "number", "boolean", "date", "json")
FILTER_OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "contains", "starts_with", "between")
SORT_DIRECTIONS = ("asc", "desc")
SOURCE_TYPES = ("manual", "api", "url", "pdf")
SOURCE_STATUSES = ("pending", "processing", "ready", "error")
DATASET_STATUSES = ("draft", "published", "archived")
CONTROL_PARAMS = ("page", "limit", "sort", "fields")
DEFAULT_MAX_BYTES = 10_485_760
DEFAULT_MAX_ROWS = 50_000
DEFAULT_LIMIT = 50
MAX_LIMIT = 500
PREVIEW_ROWS = 20
ADMIN_MAX_LIMIT = 200

#: Name of the persisted 0-based row position.
ROW = "_row"


@dataclass(frozen=True)
class Column:
    """One column of a normalised dataset."""

    key: str
    type: str = "string"
    label: str | None = None
    nullable: bool = True
    decimal_scale: int | None = None
    source: str | None = None
    percent: bool = False

    def field(self) -> T.StructField:
        """The Spark field carrying these attributes as metadata."""
        meta: dict[str, object] = {"type": self.type, "label": self.label or self.key}
        if self.decimal_scale is not None:
            meta["decimal_scale"] = self.decimal_scale
        if self.source is not None:
            meta["source"] = self.source
        if self.percent:
            meta["percent"] = True
        return T.StructField(self.key, SPARK_TYPES[self.type], True, meta)


SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.TimestampType(),
    "json": T.StringType(),
}


def column_type(spark_type: T.DataType) -> str:
    """The column type a Spark type stands for."""
    if isinstance(spark_type, T.NumericType):
        return "number"
    if isinstance(spark_type, T.BooleanType):
        return "boolean"
    if isinstance(spark_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return "string"


def columns_of(df: DataFrame) -> list[Column]:
    """Columns of a frame, read from field metadata where present."""
    out = []
    for f in df.schema.fields:
        if f.name == ROW:
            continue
        meta = f.metadata or {}
        out.append(
            Column(
                key=f.name,
                type=meta.get("type") or column_type(f.dataType),
                label=meta.get("label", f.name),
                nullable=f.nullable,
                decimal_scale=meta.get("decimal_scale"),
                source=meta.get("source"),
                percent=bool(meta.get("percent", False)),
            )
        )
    return out


@dataclass(frozen=True)
class FilterRule:
    field: str
    op: str
    required: bool = False


@dataclass(frozen=True)
class SortRule:
    field: str
    dir: str = "asc"


@dataclass(frozen=True)
class Definition:
    """A named view: what may be projected, filtered and sorted, and how much."""

    slug: str
    fields: tuple[str, ...] | None = None
    filters: tuple[FilterRule, ...] = ()
    sort: tuple[SortRule, ...] = ()
    default_limit: int = DEFAULT_LIMIT
    max_limit: int = MAX_LIMIT
    source_id: str | None = None
    dataset_id: str | None = None
    follow_latest: bool = False
    enabled: bool = True
    metadata: dict[str, str] = field(default_factory=dict)
