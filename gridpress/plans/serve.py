"""A request to a slug: resolve, check, and build the page."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.errors import DatasetNotPublished, DatasetUnresolved, NotFound
from gridpress.model import Definition, FilterRule, SortRule
from gridpress.operators.view import View, view
from gridpress.plans.definitions import resolve
from gridpress.plans.store import Store


@dataclass(frozen=True)
class Served:
    """A page, its totals, what served it, and the request fingerprint."""

    view: View
    dataset_id: str
    version: int
    etag: str

    @property
    def page(self) -> DataFrame:
        return self.view.page

    @property
    def stats(self) -> DataFrame:
        return self.view.stats


def to_definition(record) -> Definition:
    return Definition(
        slug=record["slug"],
        fields=None if record["fields"] is None else tuple(record["fields"]),
        filters=tuple(FilterRule(f["field"], f["op"], bool(f["required"])) for f in record["filters"] or ()),
        sort=tuple(SortRule(s["field"], s["dir"]) for s in record["sort"] or ()),
        default_limit=record["default_limit"],
        max_limit=record["max_limit"],
        source_id=record["source_id"],
        dataset_id=record["dataset_id"],
        follow_latest=record["follow_latest"],
        enabled=record["enabled"],
    )


def request_etag(dataset_id: str, version: int, params: dict) -> str:
    """Same fingerprint as the bulk expression, for one request."""
    parts = []
    for key in sorted(params):
        value = params[key]
        texts = [str(v) for v in value] if isinstance(value, (list, tuple)) else [str(value)]
        parts.append(f"{key}={'|'.join(texts)}")
    material = f"{dataset_id}|{version}|{'&'.join(parts)}"
    return hashlib.sha256(material.encode()).hexdigest()[:32]


def serve(store: Store, slug: str, params: dict | None = None) -> Served:
    """Answer a request; a missing slug and a disabled one look the same."""
    params = params or {}
    mine = store.definitions().where((F.col("slug") == slug) & F.col("enabled"))
    found = resolve(mine, store.datasets()).take(1)
    if not found:
        raise NotFound(f"no view '{slug}'", slug=slug)
    record, target = found[0], found[0]["resolved"]
    if target is None:
        raise DatasetUnresolved(f"'{slug}' resolves to nothing: {record['reason']}", reason=record["reason"])
    if target["status"] != "published":
        raise DatasetNotPublished(f"'{slug}' serves a dataset that is {target['status']}", status=target["status"])
    rows = store.read_version(target["source_id"], target["version"])
    built = view(rows, to_definition(record), params, store.columns(target["dataset_id"]))
    return Served(built, target["dataset_id"], target["version"], request_etag(target["dataset_id"], target["version"], params))
