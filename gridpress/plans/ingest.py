"""Ingest of a source: read landed files, normalise, store a new version.

Fetching is done elsewhere: ``landed`` in a configuration names the file or
folder a fetch left behind. Tables inside documents start from positioned
fragments, stored as parquet.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridpress.errors import (
    GridpressError,
    InvalidState,
    NotFound,
    PayloadTooLarge,
    SourceConfigInvalid,
    UnprocessableContent,
    UnsupportedMediaType,
)
from gridpress.functions.urls import reader_for, url_extension
from gridpress.model import DEFAULT_MAX_BYTES, DEFAULT_MAX_ROWS
from gridpress.operators.normalize import PHASE_SHAPE, NormalizedTable, normalize_table, positional_cells
from gridpress.operators.positional import extract_tables
from gridpress.plans import lifecycle as L
from gridpress.plans.source_config import config_checks
from gridpress.plans.store import Store, Version
from gridpress.session import scratch_root
from gridpress.sources.delimited import normalize_delimited, read_delimited
from gridpress.sources.jsonindex import read_json_files
from gridpress.sources.jsonrows import JsonTable, read_json
from gridpress.sources.landing import archive, manifest, read_payloads

Result = tuple[NormalizedTable, dict]


def _require(config: dict, key: str) -> str:
    if not config.get(key):
        raise SourceConfigInvalid(f"the configuration names no '{key}'", key=key)
    return config[key]


def _landed_json(spark: SparkSession, files: str, source: str, path: str | None, any_shape: bool, max_bytes: int | None) -> NormalizedTable:
    """Rows of landed JSON; where no limit bounds a file, its elements are read apart by many tasks."""
    if max_bytes is None and "," not in (path or ""):
        return _accepted(read_json_files(spark, files, source, path, any_shape))
    return _json(read_payloads(spark, files, None), source, path, any_shape)


def _json(payloads, source: str, path: str | None, any_shape: bool) -> NormalizedTable:
    return _accepted(read_json(payloads, source, path, any_shape))


def _accepted(found: JsonTable) -> NormalizedTable:
    refused = found.rejects.take(1)
    if refused:
        raise UnprocessableContent(f"payload refused: {refused[0]['status']}", status=refused[0]["status"])
    return found.table


def ingest_manual(spark: SparkSession, config: dict, max_bytes: int | None = DEFAULT_MAX_BYTES) -> Result:
    """A pasted payload: JSON of any shape, or delimited text."""
    payload = _require(config, "payload")
    if max_bytes is not None and len(payload.encode()) > max_bytes:
        raise PayloadTooLarge(f"payload exceeds {max_bytes} bytes", limit=max_bytes)
    if config["format"] == "json":
        frame = spark.createDataFrame([("payload", payload)], "payload_id string, payload string")
        return _json(frame, "manual", None, True), {"method": "manual-json"}
    path = f"{scratch_root(spark)}/gridpress/pasted-{uuid.uuid4().hex}"
    spark.createDataFrame([(payload,)], "value string").coalesce(1).write.text(path)
    table = read_delimited(
        spark, path, config.get("delimiter") or ",", config.get("hasHeaderRow", True), multi_line=True
    )
    return normalize_delimited(table, "manual"), {"method": "manual-csv"}


def _landed(spark: SparkSession, config: dict, max_bytes: int | None) -> tuple[str, int]:
    path = _require(config, "landed")
    size = manifest(spark, path).agg(F.max("bytes"), F.sum("bytes")).first()
    if max_bytes is not None and (size[0] or 0) > max_bytes:
        raise PayloadTooLarge(f"payload exceeds {max_bytes} bytes", limit=max_bytes)
    return path, size[1] or 0


def ingest_api(spark: SparkSession, config: dict, max_bytes: int | None = DEFAULT_MAX_BYTES) -> Result:
    """Landed JSON whose rows are the array at ``jsonPath``."""
    path, size = _landed(spark, config, max_bytes)
    table = _landed_json(spark, path, "api", config.get("jsonPath"), False, max_bytes)
    return table, {"method": "api-json", "bytes": size, "source_url": config["url"]}


def ingest_url(spark: SparkSession, config: dict, max_bytes: int | None = DEFAULT_MAX_BYTES) -> Result:
    """Landed file read by its declared type, else the hint, else the extension."""
    names = spark.createDataFrame(
        [(config.get("contentType"), config.get("contentTypeHint"), config["url"])], "t string, h string, u string"
    )
    chosen = names.select(
        reader_for(F.col("t"), F.col("h"), F.col("u")).alias("reader"), url_extension(F.col("u")).alias("ext")
    ).first()
    reader = chosen["reader"]
    if reader is None:
        raise UnsupportedMediaType(f"unsupported content type: {config.get('contentType') or 'unknown'}")
    meta = {"source_url": config["url"], "content_type": config.get("contentType"), "method": f"url-{reader}"}
    if reader == "pdf":
        table, extra = ingest_pdf(spark, config, max_bytes)
        return table, {**extra, **meta}
    path, size = _landed(spark, config, max_bytes)
    meta["bytes"] = size
    if reader == "json":
        return _landed_json(spark, path, "url", None, False, max_bytes), meta
    delimiter = "\t" if chosen["ext"] == "tsv" else ","
    return normalize_delimited(read_delimited(spark, path, delimiter, multi_line=config.get("multiLine", True)), "url"), meta


def ingest_pdf(spark: SparkSession, config: dict, max_bytes: int | None = DEFAULT_MAX_BYTES) -> Result:
    """One table of one document, from its landed fragments.

    Fragments are Spark's own tables, not payloads: ``max_bytes`` does not
    bound them.
    """
    fragments = spark.read.parquet(_require(config, "landed"))
    index = config.get("tableIndex") or 0
    found = extract_tables(fragments, config.get("pages"), config.get("headerHints"), index)
    refused = found.rejects.take(1)
    if refused:
        raise UnprocessableContent(f"no table: {refused[0]['reason']}", reason=refused[0]["reason"])
    tables = found.tables.take(2)
    if len(tables) > 1:
        raise UnprocessableContent("the landed fragments hold more than one document", reason="several-documents")
    table = tables[0]
    shape = found.warnings.select(
        F.lit(PHASE_SHAPE).alias("phase"),
        "_row",
        F.lit(None).cast("int").alias("col_pos"),
        "kind",
        "detail",
    )
    normalized = normalize_table(
        found.rows, table["headers"], positional_cells("cells", table["columns"]), "pdf", shape_warnings=shape
    )
    return normalized, {"method": "text-positions", "source_url": config["url"]}


#: One strategy per source type.
STRATEGIES: dict[str, Callable[[SparkSession, dict, int | None], Result]] = {
    "manual": ingest_manual,
    "api": ingest_api,
    "url": ingest_url,
    "pdf": ingest_pdf,
}


def register(store: Store, source_id: str, name: str, source_type: str, config: dict, at=None) -> None:
    """Add a source after checking its configuration."""
    text = json.dumps(config)
    candidate = store.spark.createDataFrame([(source_id, source_type, text)], "source_id string, type string, config string")
    error = config_checks(candidate).first()["error"]
    if error:
        raise SourceConfigInvalid(f"configuration refused: {error}", error=error)
    store.append("sources", (source_id, name, source_type, None, text, at))


def ingest(
    store: Store,
    source_id: str,
    max_rows: int | None = DEFAULT_MAX_ROWS,
    max_bytes: int | None = DEFAULT_MAX_BYTES,
) -> Version:
    """Run one ingest of a source, recording its start and its outcome.

    ``None`` lifts a limit.
    """
    found = store.sources().where(F.col("source_id") == source_id).take(1)
    if not found:
        raise NotFound(f"no source '{source_id}'", source_id=source_id)
    source = found[0]
    if source["removed"] or source["status"] == "processing":
        raise InvalidState(f"source '{source_id}' takes no ingest now", status=source["status"])
    config = json.loads(source["config"])
    store.event("source_events", source_id, L.START, None)
    try:
        if config.get("archive"):
            # Before anything is read: a payload that is refused is kept as well.
            archive(store.spark, config["archive"], f"{store.root}/archive", source_id, str(store.next_version(source_id)))
        table, meta = STRATEGIES[source["type"]](store.spark, config, max_bytes)
        version = store.write_version(source_id, source["name"], table, meta, max_rows)
    except SourceConfigInvalid as error:
        store.event("source_events", source_id, L.RESTORE, str(error))
        raise
    except GridpressError as error:
        store.event("source_events", source_id, L.FAIL, str(error))
        raise
    except Exception as error:
        store.event("source_events", source_id, L.FAIL, str(error)[:1000])
        raise
    store.event("source_events", source_id, L.SUCCEED, version.dataset_id)
    return version
