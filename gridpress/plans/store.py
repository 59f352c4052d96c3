"""Versioned datasets and catalog tables on parquet.

Rows live under ``rows/source_id=/version=`` and are never rewritten. The
catalog tables are append-only; statuses are folded from events. The dataset
record is appended last, so a version is visible only once it is complete.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridpress.errors import (
    InvalidState,
    NotFound,
    RowsLimitExceeded,
    UnprocessableContent,
    VersionConflict,
)
from gridpress.model import DEFAULT_MAX_ROWS, PREVIEW_ROWS, ROW, Column
from gridpress.operators.normalize import NormalizedTable
from gridpress.plans import lifecycle as L
from gridpress.plans.definitions import definition_checks, reference_errors
from gridpress.session import discard

SCHEMAS = {
    "sources": "source_id string, name string, type string, description string, config string, created_at timestamp",
    "datasets": "dataset_id string, source_id string, version int, name string, row_count bigint, columns_count int,"
    " warnings_count bigint, created_at timestamp, attempt string",
    "columns": "dataset_id string, pos int, key string, label string, type string, nullable boolean,"
    " decimal_scale int, source string, percent boolean, attempt string",
    "ingest_runs": "dataset_id string, method string, page_count int, table_count int, raw_row_count bigint,"
    " source_url string, fetched_at timestamp, content_type string, bytes bigint, duration_ms bigint,"
    " attempt string",
    "definitions": "definition_id string, slug string, name string, source_id string, dataset_id string,"
    " follow_latest boolean, fields array<string>, filters array<struct<field:string,op:string,required:boolean>>,"
    " sort array<struct<field:string,dir:string>>, default_limit int, max_limit int, enabled boolean,"
    " seq bigint, removed boolean",
    "dataset_events": "entity_id string, seq bigint, event string, at timestamp",
    "source_events": "entity_id string, seq bigint, event string, detail string, at timestamp",
}


@dataclass(frozen=True)
class Version:
    dataset_id: str
    source_id: str
    version: int
    row_count: int
    columns_count: int


class Store:
    """A catalog rooted at one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # --- catalog tables -----------------------------------------------------

    def table(self, name: str) -> DataFrame:
        path = f"{self.root}/catalog/{name}"
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def append(self, name: str, *records: tuple) -> None:
        """Add a few catalog records (metadata, never rows); fields left off at the end are null."""
        width = len(self.spark.createDataFrame([], SCHEMAS[name]).columns)
        padded = [tuple(r) + (None,) * (width - len(r)) for r in records]
        frame = self.spark.createDataFrame(padded, SCHEMAS[name]).coalesce(1)
        frame.write.mode("append").parquet(f"{self.root}/catalog/{name}")

    def append_frame(self, name: str, frame: DataFrame) -> None:
        frame.write.mode("append").parquet(f"{self.root}/catalog/{name}")

    def event(self, name: str, entity_id: str, event: str, *detail: str | None) -> None:
        self.append(name, (entity_id, time.time_ns(), event, *detail, _now()))

    def datasets(self) -> DataFrame:
        """Dataset records with their folded status."""
        states = L.dataset_states(self.table("dataset_events")).select(
            F.col("entity_id").alias("dataset_id"), F.col("status").alias("_status")
        )
        listed = self.table("datasets")
        return listed.join(states, "dataset_id", "left").select(
            *listed.columns, F.coalesce("_status", F.lit("draft")).alias("status")
        )

    def sources(self) -> DataFrame:
        """Source records with their folded status."""
        states = L.source_states(self.table("source_events")).withColumnRenamed("entity_id", "source_id")
        listed = self.table("sources")
        return listed.join(states, "source_id", "left").select(
            *listed.columns,
            F.coalesce("status", F.lit("pending")).alias("status"),
            F.coalesce("removed", F.lit(False)).alias("removed"),
        )

    # --- versions -----------------------------------------------------------

    def rows_path(self, source_id: str, version: int, attempt: str) -> str:
        """Folder of one attempt at a version; only the one that the catalog names counts."""
        return f"{self.root}/rows/source_id={source_id}/version={version}/attempt={attempt}"

    def _versions(self, source_id: str, version: int) -> list:
        table = self.table("datasets")
        return table.where((F.col("source_id") == source_id) & (F.col("version") == version)).take(1)

    def next_version(self, source_id: str) -> int:
        """One above all versions listed or claimed: a writer killed after its claim leaves a gap."""
        newest = self.table("datasets").where(F.col("source_id") == source_id).agg(F.max("version")).first()[0]
        folder = self._path(self._claims(source_id))
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        claimed = [int(f.getPath().getName()) for f in files.listStatus(folder)] if files.exists(folder) else []
        return max([newest or 0, *claimed]) + 1

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _claims(self, source_id: str) -> str:
        return f"{self.root}/catalog/claims/source_id={source_id}"

    def _claim(self, source_id: str, version: int) -> None:
        """Take a version by creating a file that must not be there yet."""
        path = self._path(f"{self._claims(source_id)}/{version}")
        try:
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False).close()
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            raise VersionConflict(f"version {version} of {source_id} exists", source_id=source_id) from None

    def _release(self, source_id: str, version: int) -> None:
        """Give back a version that this writer claimed and could not list."""
        path = self._path(f"{self._claims(source_id)}/{version}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)

    def write_version(
        self,
        source_id: str,
        name: str,
        table: NormalizedTable,
        meta: dict | None = None,
        max_rows: int | None = DEFAULT_MAX_ROWS,
        version: int | None = None,
    ) -> Version:
        """Store a normalised table as the next, immutable version.

        Above ``max_rows`` nothing is stored; rows are never cut off. Rows go
        to a folder of this attempt and are counted as they are written, so
        the source is read once. The catalog record that names the folder is
        written last, so an attempt that broke off is never in the way; of
        two writers of one version, the one that claims it first has it.
        """
        started = time.time()
        version = version or self.next_version(source_id)
        self._free(source_id, version)
        attempt = uuid.uuid4().hex
        path = self.rows_path(source_id, version, attempt)
        row_count = _written(table.rows, path)
        if row_count == 0 or (max_rows is not None and row_count > max_rows):
            discard(self.spark.read.parquet(path))
            if row_count:
                raise RowsLimitExceeded(f"more than {max_rows} rows", limit=max_rows)
            raise UnprocessableContent("the source has no rows")

        dataset_id = f"{source_id}-v{version}"
        warnings_path = self._warnings_path(dataset_id, attempt)
        warnings_count = _written(table.warnings, warnings_path)
        self.append(
            "columns",
            *[
                (dataset_id, i, c.key, c.label, c.type, c.nullable, c.decimal_scale, c.source, c.percent, attempt)
                for i, c in enumerate(table.columns)
            ],
        )
        m = meta or {}
        self.append(
            "ingest_runs",
            (
                dataset_id,
                m.get("method"),
                m.get("page_count"),
                m.get("table_count"),
                m.get("raw_row_count", row_count),
                m.get("source_url"),
                m.get("fetched_at"),
                m.get("content_type"),
                m.get("bytes"),
                int(m.get("duration_ms", (time.time() - started) * 1000)),
                attempt,
            ),
        )
        self._free(source_id, version)
        self._claim(source_id, version)
        listed = False
        try:
            self.append("datasets", (dataset_id, source_id, version, name, row_count, len(table.columns), warnings_count, _now(), attempt))
            listed = True
        finally:
            if not listed:
                self._release(source_id, version)
        return Version(dataset_id, source_id, version, row_count, len(table.columns))

    def _free(self, source_id: str, version: int) -> None:
        if self._versions(source_id, version):
            raise VersionConflict(f"version {version} of {source_id} exists", source_id=source_id)

    def _warnings_path(self, dataset_id: str, attempt: str) -> str:
        return f"{self.root}/catalog/warnings/dataset_id={dataset_id}/attempt={attempt}"

    def _record(self, dataset_id: str):
        found = self.datasets().where(F.col("dataset_id") == dataset_id).take(1)
        if not found:
            raise NotFound(f"no dataset '{dataset_id}'", dataset_id=dataset_id)
        return found[0]

    def read_version(self, source_id: str, version: int) -> DataFrame:
        found = self._versions(source_id, version)
        if not found:
            raise NotFound(f"no version {version} of '{source_id}'", source_id=source_id)
        return self.spark.read.parquet(self.rows_path(source_id, version, found[0]["attempt"]))

    def preview(self, dataset_id: str, rows: int | None = PREVIEW_ROWS) -> tuple[DataFrame, bool]:
        """The first rows in order (all when None), and whether any were left out."""
        record = self._record(dataset_id)
        df = self.read_version(record["source_id"], record["version"])
        if rows is None:
            return df.orderBy(ROW), False
        # Positions are 0-based and dense, so this prunes row groups.
        return df.where(F.col(ROW) < rows).orderBy(ROW), record["row_count"] > rows

    def columns(self, dataset_id: str) -> list[Column]:
        """Column descriptions of one dataset, without touching its rows."""
        attempt = self._record(dataset_id)["attempt"]
        mine = (F.col("dataset_id") == dataset_id) & F.col("attempt").eqNullSafe(attempt)
        found = self.table("columns").where(mine).orderBy("pos").collect()
        return [
            Column(r["key"], r["type"], r["label"], r["nullable"], r["decimal_scale"], r["source"], r["percent"])
            for r in found
        ]

    def warnings(self, dataset_id: str) -> DataFrame:
        return self.spark.read.parquet(self._warnings_path(dataset_id, self._record(dataset_id)["attempt"]))

    # --- lifecycle ----------------------------------------------------------

    def publish(self, dataset_id: str) -> None:
        self._transition(dataset_id, L.PUBLISH, "draft")

    def archive(self, dataset_id: str) -> None:
        self._transition(dataset_id, L.ARCHIVE, "published")

    def _transition(self, dataset_id: str, event: str, wanted: str) -> None:
        status = self._record(dataset_id)["status"]
        if status != wanted:
            raise InvalidState(f"cannot {event} a dataset that is {status}", status=status)
        self.event("dataset_events", dataset_id, event)

    def remove_source(self, source_id: str) -> int:
        """Disable the definitions of a source, then mark it removed."""
        mine = self.definitions().where(F.col("source_id") == source_id)
        gone = self.spark.createDataFrame([(source_id,)], "source_id string")
        disabled = L.disable_events(mine, gone).count()
        self.event("source_events", source_id, L.REMOVE, None)
        return disabled

    def create_definition(self, definition_id: str, slug: str, **fields) -> None:
        """Add a definition; id and slug must be free."""
        taken = self.definitions().where((F.col("definition_id") == definition_id) | (F.col("slug") == slug)).take(1)
        if taken:
            raise InvalidState(f"'{slug}' or '{definition_id}' is taken", slug=slug)
        self._define({"enabled": True, "follow_latest": True, **fields, "definition_id": definition_id, "slug": slug})

    def update_definition(self, definition_id: str, **changes) -> None:
        """Change some fields of a definition; its id and slug stay."""
        fixed = {"definition_id", "slug"} & set(changes)
        if fixed:
            raise InvalidState(f"{', '.join(sorted(fixed))} cannot change", definition_id=definition_id)
        found = self.definitions().where(F.col("definition_id") == definition_id).take(1)
        if not found:
            raise NotFound(f"no definition '{definition_id}'", definition_id=definition_id)
        self._define({**found[0].asDict(recursive=True), **changes})

    def remove_definition(self, definition_id: str) -> None:
        self.update_definition(definition_id, removed=True)

    def _define(self, fields: dict) -> None:
        names = [f.name for f in self.table("definitions").schema]
        unknown = set(fields) - set(names)
        if unknown:
            raise InvalidState(f"a definition has no {', '.join(sorted(unknown))}", definition_id=fields["definition_id"])
        record = {**dict.fromkeys(names), **fields, "seq": time.time_ns()}
        if not record.get("removed"):
            self._check_definition(record, names)
        self.append("definitions", tuple(record[n] for n in names))

    def _check_definition(self, record: dict, names: list[str]) -> None:
        """Refuse a definition that fails a check, or pins a dataset that its source does not have."""
        one = self.spark.createDataFrame([tuple(record[n] for n in names)], self.table("definitions").schema)
        error = definition_checks(one).first()["error"]
        if error is None and record.get("dataset_id") is not None:
            pinned = self.table("datasets").where(F.col("dataset_id") == record["dataset_id"])
            if reference_errors(one, pinned).take(1):
                error = "DATASET_OF_OTHER_SOURCE"
            elif not pinned.take(1):
                error = "DATASET_NOT_FOUND"
        if error:
            raise UnprocessableContent(f"definition refused: {error}", error=error, definition_id=record["definition_id"])

    def definitions(self) -> DataFrame:
        """The last state of each definition; those of removed sources count as disabled."""
        removed = (
            self.table("source_events")
            .where(F.col("event") == L.REMOVE)
            .select(F.col("entity_id").alias("source_id"), F.lit(True).alias("_removed"))
            .distinct()
        )
        table = self.table("definitions")
        state = F.max_by(F.struct(*table.columns), F.coalesce("seq", F.lit(0))).alias("s")
        listed = table.groupBy("definition_id").agg(state).select("s.*").where("not coalesce(removed, false)")
        return listed.join(removed, "source_id", "left").select(
            *[F.col(c) for c in listed.columns if c not in ("enabled", "seq", "removed")],
            (F.col("enabled") & F.col("_removed").isNull()).alias("enabled"),
        )


def _written(frame: DataFrame, path: str) -> int:
    """Write a frame and return its number of rows, counted on the way."""
    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return seen.get["rows"]


def _now() -> datetime:
    return datetime.now(timezone.utc)
