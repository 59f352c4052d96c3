"""Catalog, lifecycle and definition checks over catalogs derived from the tables.

Orders stand for dataset versions (customer = source), customers for sources
and for view definitions, lineitem flags for dataset columns, and events for
source lifecycles and logged requests. The derivations are written once, in
expressions both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.functions.params import canonical_params, fingerprint
from gridpress.operators.ordered import total_rank
from gridpress.operators.view import page_stats
from gridpress.plans import audit as A
from gridpress.plans import catalog as K
from gridpress.plans import definitions as D
from gridpress.plans import lifecycle as L
from workloads.base import Registry, Tables

R = Registry()

DATASETS = [
    "o_orderkey AS dataset_id",
    "o_custkey AS source_id",
    "o_orderkey AS version",
    "CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'published' ELSE 'archived' END AS status",
    "CAST(floor(o_totalprice) AS BIGINT) AS row_count",
    "o_orderdate AS created_at",
]
SOURCES = [
    "c_custkey AS source_id",
    "c_name AS name",
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'api' WHEN 'BUILDING' THEN 'pdf' WHEN 'FURNITURE' THEN 'url' ELSE 'manual' END AS type",
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'pending' WHEN 'BUILDING' THEN 'ready' WHEN 'FURNITURE' THEN 'error' ELSE 'ready' END AS status",
]
SETTINGS = [
    "c_custkey AS definition_id",
    "CASE WHEN c_nationkey = 9 THEN c_name WHEN c_nationkey = 10 THEN 'shared-slug' ELSE lower(replace(c_name, '#', '-')) END AS slug",
    "c_custkey AS source_id",
    "CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN c_custkey + 1000000000000 ELSE c_custkey * 10 END AS dataset_id",
    "c_mktsegment = 'AUTOMOBILE' AS follow_latest",
    "CAST(50 + c_nationkey AS INT) AS default_limit",
    "CAST(CASE c_nationkey WHEN 5 THEN 40 WHEN 6 THEN 600 ELSE 500 END AS INT) AS max_limit",
    "c_nationkey <> 7 AS enabled",
    "c_nationkey AS nation",
    "lower(c_mktsegment) AS segment",
]
COLUMNS = [
    "l_orderkey AS dataset_id",
    "lower(l_returnflag) || '_' || lower(l_linestatus) AS key",
    "CASE WHEN l_returnflag = 'A' THEN 'string' WHEN l_linestatus = 'O' THEN 'number' ELSE 'date' END AS type",
]
DATASET_EVENTS = [
    "o_custkey AS entity_id",
    "o_orderkey AS seq",
    "CASE o_orderstatus WHEN 'P' THEN 'archive' ELSE 'publish' END AS event",
]
SOURCE_EVENTS = [
    "user_id AS entity_id",
    "event_id AS seq",
    "CASE WHEN value > 320 THEN 'remove' WHEN event_type IN ('view', 'signup') THEN 'start' WHEN event_type = 'purchase' THEN 'succeed' WHEN event_type = 'error' THEN 'fail' ELSE 'restore' END AS event",
]


def _cte(**frames: tuple[list[str], str]) -> str:
    def one(name: str, cols: list[str], table: str) -> str:
        distinct = "DISTINCT " if name == "columns" else ""
        return f"{name} AS (SELECT {distinct}{', '.join(cols)} FROM {table})"

    return ", ".join(one(name, cols, table) for name, (cols, table) in frames.items())


CTE = "WITH " + _cte(
    datasets=(DATASETS, "orders"),
    sources=(SOURCES, "customer"),
    settings=(SETTINGS, "customer"),
    columns=(COLUMNS, "lineitem"),
    ds_events=(DATASET_EVENTS, "orders"),
    src_events=(SOURCE_EVENTS, "events"),
)


def datasets(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*DATASETS)


def sources(t: Tables) -> DataFrame:
    return t.customer.selectExpr(*SOURCES)


def columns(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(*COLUMNS).distinct()


def definitions(t: Tables) -> DataFrame:
    rules = (
        t.customer.selectExpr(*SETTINGS)
        .withColumn("fields", F.expr("CASE WHEN nation = 11 THEN NULL WHEN nation <= 3 THEN array('a_f', segment) ELSE array('a_f') END"))
        .withColumn(
            "filters",
            F.expr(
                "array(named_struct('field', 'r_o', 'op', 'gte', 'required', nation = 3),"
                " named_struct('field', 'a_f', 'op', 'starts_with', 'required', false))"
            ),
        )
        .withColumn(
            "sort",
            F.expr("CASE WHEN nation = 4 THEN array(named_struct('field', 'N O', 'dir', 'asc'))"
                   " ELSE array(named_struct('field', 'r_o', 'dir', 'asc')) END"),
        )
    )
    return rules.drop("nation", "segment")


# --- catalog ----------------------------------------------------------------


@R.add(CTE + """ SELECT source_id, dataset_id, version, status, row_count FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY version DESC) AS rn FROM datasets WHERE status = 'published') WHERE rn = 1""")
def latest_published(t: Tables) -> DataFrame:
    return K.latest_published(datasets(t))


@R.add(CTE + """ SELECT source_id, coalesce(max(version), 0) + 1 AS next_version
FROM sources LEFT JOIN datasets USING (source_id) GROUP BY source_id""")
def next_version(t: Tables) -> DataFrame:
    return K.next_version(sources(t), datasets(t))


@R.add(CTE + """ SELECT source_id, dataset_id, version,
  CAST(row_number() OVER (PARTITION BY source_id ORDER BY version DESC) AS BIGINT) AS age FROM datasets""")
def version_history(t: Tables) -> DataFrame:
    return K.version_history(datasets(t)).select("source_id", "dataset_id", "version", "age")


@R.add(CTE + """ SELECT s.status, count(source_id) AS n
FROM (VALUES ('pending'), ('processing'), ('ready'), ('error')) AS s(status) LEFT JOIN sources USING (status) GROUP BY 1""")
def status_counts(t: Tables) -> DataFrame:
    return K.source_status_counts(sources(t))


@R.add(CTE + """ SELECT 'sources' AS metric, count(*) AS n FROM sources
UNION ALL SELECT 'published_datasets', count(*) FROM datasets WHERE status = 'published'
UNION ALL SELECT 'enabled_definitions', count(*) FROM settings WHERE enabled""")
def dashboard_totals(t: Tables) -> DataFrame:
    return K.totals(sources(t), datasets(t), definitions(t))


@R.add(CTE + """ SELECT source_id, name FROM sources WHERE type = 'url' AND status = 'error'""")
def catalog_filters(t: Tables) -> DataFrame:
    return K.catalog_filter(sources(t), type="url", status="error").select("source_id", "name")


@R.add(CTE + """ SELECT count(*) AS total, CAST(greatest(0, least(200, count(*) - 200)) AS BIGINT) AS count,
  CAST(2 AS BIGINT) AS page, CAST(200 AS BIGINT) AS "limit", CAST(ceil(count(*) / 200.0) AS BIGINT) AS pages
FROM datasets WHERE status = 'published'""")
def listing_totals(t: Tables) -> DataFrame:
    return page_stats(K.catalog_filter(datasets(t), source_id=None, status="published"), 2, 200)


@R.add(CTE + """ SELECT 'datasets' AS kind, dataset_id AS id, row_number() OVER (ORDER BY version DESC, dataset_id) AS place FROM datasets
UNION ALL SELECT 'definitions', definition_id, row_number() OVER (ORDER BY slug, definition_id) FROM settings
UNION ALL SELECT 'ingests', dataset_id, row_number() OVER (ORDER BY created_at DESC, dataset_id DESC) FROM datasets""")
def catalog_ordering(t: Tables) -> DataFrame:
    """Places of all records in the three listings."""
    every = []
    for kind, df, key in (("datasets", datasets(t), "dataset_id"), ("definitions", definitions(t), "definition_id"), ("ingests", datasets(t), "dataset_id")):
        placed = total_rank(df, K.listing_order(kind, key=key), "place")
        every.append(placed.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "place"))
    return every[0].union(every[1]).union(every[2])


@R.add(CTE + """, n AS (SELECT * FROM datasets ORDER BY created_at DESC, dataset_id DESC LIMIT 6)
SELECT dataset_id, version, row_count, row_count % 7 AS warnings_count, coalesce(name, 'source ' || CAST(source_id AS VARCHAR)) AS source_name FROM n LEFT JOIN sources USING (source_id)""")
def recent_ingests(t: Tables) -> DataFrame:
    counted = datasets(t).withColumn("warnings_count", F.col("row_count") % 7)
    return K.recent_ingests(counted, sources(t)).select("dataset_id", "version", "row_count", "warnings_count", "source_name")


@R.add("""SELECT s_suppkey, s_name, coalesce(n_name, 'source ' || CAST(s_nationkey + 20 * (s_suppkey % 2) AS VARCHAR)) AS source_name
FROM supplier LEFT JOIN nation ON s_nationkey + 20 * (s_suppkey % 2) = n_nationkey""")
def lookup_name(t: Tables) -> DataFrame:
    """Names of all nations; every second supplier mostly refers to one that is not there."""
    suppliers = t.supplier.withColumn("source_id", F.col("s_nationkey") + 20 * (F.col("s_suppkey") % 2))
    names = t.nation.select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("name"))
    return K.with_source_name(suppliers, names).select("s_suppkey", "s_name", "source_name")


@R.add(CTE + " SELECT slug, count(*) AS n FROM settings GROUP BY slug HAVING count(*) > 1")
def duplicate_slugs(t: Tables) -> DataFrame:
    return K.duplicates(definitions(t), "slug")


@R.add(CTE + " SELECT source_id, count(*) AS n FROM datasets GROUP BY source_id HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return K.duplicates(datasets(t), "source_id")


@R.add(CTE + """ SELECT nation AS source_id, count(*) AS definitions, count(*) FILTER (WHERE enabled) AS enabled FROM settings GROUP BY nation""")
def affected_definitions(t: Tables) -> DataFrame:
    by_nation = t.customer.selectExpr("c_nationkey AS source_id", "c_nationkey <> 7 AS enabled")
    return K.affected_definitions(by_nation)


# --- lifecycle --------------------------------------------------------------

D1_SQL = CTE + """, p AS (SELECT entity_id, min(seq) AS p FROM ds_events WHERE event = 'publish' GROUP BY 1),
a AS (SELECT entity_id, min(seq) AS a FROM ds_events JOIN p USING (entity_id) WHERE event = 'archive' AND seq > p GROUP BY 1),
s AS (SELECT entity_id, seq, event, p, a FROM ds_events LEFT JOIN p USING (entity_id) LEFT JOIN a USING (entity_id))"""


@R.add(D1_SQL + """ SELECT entity_id, CASE WHEN any_value(a) IS NOT NULL THEN 'archived' WHEN any_value(p) IS NOT NULL THEN 'published' ELSE 'draft' END AS status,
  any_value(p) AS published_seq, any_value(a) AS archived_seq, count(*) AS events FROM s GROUP BY entity_id""")
def dataset_states(t: Tables) -> DataFrame:
    return L.dataset_states(t.orders.selectExpr(*DATASET_EVENTS))


@R.add(D1_SQL + """ SELECT entity_id, seq, event, CASE WHEN seq > a THEN 'archived' WHEN seq > p THEN 'published' ELSE 'draft' END AS status
FROM s WHERE seq IS DISTINCT FROM p AND seq IS DISTINCT FROM a""")
def illegal_transitions(t: Tables) -> DataFrame:
    return L.illegal_transitions(t.orders.selectExpr(*DATASET_EVENTS))


# The SQL fold walks the events of each source in order, one state at a time.
D2_FOLD = (
    "WITH RECURSIVE "
    + _cte(src_events=(SOURCE_EVENTS, "events"))
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS i FROM src_events),
f AS (SELECT entity_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS seq, '' AS event, 'pending' AS status, 'pending' AS previous, false AS removed, false AS accepted
    FROM (SELECT DISTINCT entity_id FROM src_events)
  UNION ALL
  SELECT o.entity_id, o.i, o.seq, o.event,
    CASE WHEN f.removed THEN f.status WHEN o.event = 'remove' THEN 'error'
      WHEN o.event = 'start' THEN 'processing' WHEN f.status <> 'processing' THEN f.status
      WHEN o.event = 'succeed' THEN 'ready' WHEN o.event = 'fail' THEN 'error' ELSE f.previous END,
    CASE WHEN NOT f.removed AND o.event = 'start' AND f.status <> 'processing' THEN f.status ELSE f.previous END,
    f.removed OR o.event = 'remove',
    NOT f.removed AND CASE o.event WHEN 'remove' THEN true WHEN 'start' THEN f.status <> 'processing' ELSE f.status = 'processing' END
  FROM f JOIN o ON o.entity_id = f.entity_id AND o.i = f.i + 1)"""
)


@R.add(D2_FOLD + " SELECT entity_id, seq, event, accepted FROM f WHERE i > 0")
def source_transitions(t: Tables) -> DataFrame:
    return L.judged_source_events(t.events.selectExpr(*SOURCE_EVENTS))


@R.add(D2_FOLD + """ SELECT entity_id, arg_max(status, i) AS status, bool_or(removed) AS removed FROM f GROUP BY entity_id""")
def source_states(t: Tables) -> DataFrame:
    return L.source_states(t.events.selectExpr(*SOURCE_EVENTS))


@R.add(CTE + """ SELECT definition_id, source_id, 'disable' AS event FROM settings
WHERE enabled AND source_id IN (SELECT source_id FROM sources WHERE status = 'error')""")
def disable_definitions(t: Tables) -> DataFrame:
    return L.disable_events(definitions(t), sources(t).where("status = 'error'"))


@R.add("""WITH b AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS description FROM customer),
p AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS name,
  CASE WHEN o_orderstatus = 'P' THEN 'order ' || CAST(o_orderkey AS VARCHAR) END AS description FROM orders),
n AS (SELECT id, arg_max(name, seq) FILTER (WHERE name IS NOT NULL) AS n, arg_max(description, seq) FILTER (WHERE description IS NOT NULL) AS d FROM p GROUP BY id)
SELECT id, coalesce(n, name) AS name, coalesce(d, description) AS description FROM b LEFT JOIN n USING (id)""")
def partial_updates(t: Tables) -> DataFrame:
    base = t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS description")
    patches = t.orders.selectExpr(
        "o_custkey AS id",
        "o_orderkey AS seq",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS name",
        "CASE WHEN o_orderstatus = 'P' THEN 'order ' || CAST(o_orderkey AS STRING) END AS description",
    )
    return L.fold_updates(base, patches, "id", ["name", "description"])


# --- definitions ------------------------------------------------------------

RESOLVED_SQL = CTE + """, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY version DESC) AS rn
  FROM datasets WHERE status = 'published') WHERE rn = 1),
res AS (SELECT d.definition_id, d.slug, d.nation, d.segment, d.enabled, d.max_limit,
  CASE WHEN f THEN l.dataset_id ELSE p.dataset_id END AS dataset_id,
  CASE WHEN f THEN l.version ELSE p.version END AS version, CASE WHEN f THEN l.status ELSE p.status END AS status,
  CASE WHEN f THEN l.row_count ELSE p.row_count END AS row_count,
  CASE WHEN f AND l.dataset_id IS NULL THEN 'no-published' WHEN NOT f AND p.dataset_id IS NULL THEN 'dataset-not-found' END AS reason
  FROM (SELECT *, follow_latest OR dataset_id IS NULL AS f FROM settings) d
  LEFT JOIN datasets p ON p.dataset_id = d.dataset_id LEFT JOIN latest l ON l.source_id = d.source_id),
named AS (SELECT definition_id, dataset_id, 'a_f' AS field, 'fields[0]' AS "where" FROM res WHERE nation <> 11
  UNION ALL SELECT definition_id, dataset_id, segment, 'fields[1]' FROM res WHERE nation <= 3
  UNION ALL SELECT definition_id, dataset_id, 'r_o', 'filters[0].field' FROM res
  UNION ALL SELECT definition_id, dataset_id, 'a_f', 'filters[1].field' FROM res
  UNION ALL SELECT definition_id, dataset_id, CASE WHEN nation = 4 THEN 'N O' ELSE 'r_o' END, 'sort[0].field' FROM res),
unknown AS (SELECT n.* FROM named n LEFT JOIN columns c ON c.dataset_id = n.dataset_id AND c.key = n.field
  WHERE n.dataset_id IS NOT NULL AND c.key IS NULL)"""


def resolved(t: Tables) -> DataFrame:
    return D.resolve(definitions(t), datasets(t))


@R.add(RESOLVED_SQL + " SELECT definition_id, dataset_id, version, status, row_count, reason FROM res")
def resolve_definitions(t: Tables) -> DataFrame:
    return D.resolved_summary(resolved(t))


@R.add(RESOLVED_SQL + ' SELECT definition_id, dataset_id, field, "where" FROM unknown')
def unknown_fields(t: Tables) -> DataFrame:
    return D.unknown_fields(resolved(t), columns(t))


@R.add(RESOLVED_SQL + """ SELECT definition_id, string_agg(field, '|' ORDER BY field) AS columns
FROM (SELECT DISTINCT definition_id, field FROM unknown) GROUP BY definition_id""")
def offending_columns(t: Tables) -> DataFrame:
    found = D.offending_columns(D.unknown_fields(resolved(t), columns(t)))
    return found.withColumn("columns", F.array_join("columns", "|"))


@R.add(RESOLVED_SQL + """ SELECT r.definition_id, r.dataset_id, c.key FROM res r JOIN columns c USING (dataset_id)
LEFT JOIN named n ON n.definition_id = r.definition_id AND n.field = c.key AND starts_with(n."where", 'fields') WHERE n.field IS NULL""")
def unexposed_columns(t: Tables) -> DataFrame:
    return D.unexposed_columns(resolved(t), columns(t))


@R.add(RESOLVED_SQL + """, u AS (SELECT definition_id, string_agg("where", '|' ORDER BY "where") AS unknown FROM unknown GROUP BY 1)
SELECT definition_id, u.unknown IS NULL AND reason IS NULL AND coalesce(status = 'published', false) AS valid, dataset_id, version, status,
  coalesce(u.unknown, '') AS unknown, coalesce(reason, CASE WHEN status <> 'published' THEN 'dataset-' || status END) AS reason
FROM res LEFT JOIN u USING (definition_id)""")
def validate_definitions(t: Tables) -> DataFrame:
    report = D.validation_report(resolved(t), columns(t))
    return report.withColumn("unknown", F.array_join("unknown", "|"))


@R.add(RESOLVED_SQL + """ SELECT definition_id, slug, CASE WHEN NOT enabled THEN 'slug-not-found' WHEN reason IS NOT NULL THEN reason
  WHEN status <> 'published' THEN 'dataset-' || status ELSE 'served' END AS outcome FROM res""")
def serveability(t: Tables) -> DataFrame:
    return D.serveability(resolved(t))


@R.add(CTE + """, m AS (SELECT slug, count(*) AS n FROM settings GROUP BY 1)
SELECT definition_id, slug, CASE WHEN length(slug) NOT BETWEEN 3 AND 80 THEN 'SLUG_LENGTH'
  WHEN NOT regexp_full_match(slug, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'SLUG_INVALID' WHEN nation = 4 THEN 'FIELD_INVALID'
  WHEN default_limit > max_limit OR max_limit > 500 THEN 'LIMITS_INVALID'
  WHEN NOT follow_latest AND dataset_id IS NULL THEN 'DATASET_REQUIRED' WHEN m.n > 1 THEN 'SLUG_TAKEN' END AS error
FROM settings JOIN m USING (slug)""")
def definition_checks(t: Tables) -> DataFrame:
    return D.definition_checks(definitions(t))


@R.add(CTE + """ SELECT s.definition_id, s.dataset_id, s.source_id, d.source_id AS owner_id
FROM settings s JOIN datasets d USING (dataset_id) WHERE d.source_id <> s.source_id""")
def cross_source_references(t: Tables) -> DataFrame:
    return D.reference_errors(definitions(t), datasets(t))


@R.add(CTE + """ SELECT event_id AS request_id, definition_id FROM (SELECT event_id, 'customer-' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS slug FROM events)
LEFT JOIN (SELECT slug, definition_id FROM settings WHERE enabled) USING (slug)""")
def find_by_slug(t: Tables) -> DataFrame:
    return D.find_by_slug(requests(t), definitions(t)).select("request_id", "definition_id")


# --- requests ---------------------------------------------------------------


def requests(t: Tables) -> DataFrame:
    """Logged requests: one shape per event type, values from the event."""
    params = F.expr(
        """CASE event_type
        WHEN 'view' THEN map('page', array(CAST(CAST(value AS INT) - 2 AS STRING)))
        WHEN 'signup' THEN map('limit', array(CAST(CAST(value * 4 AS INT) AS STRING)), 'r_o', array(CAST(value AS STRING)))
        WHEN 'click' THEN map('r_o', array(concat(props, 'x')), 'sort', array('r_o:desc'))
        WHEN 'error' THEN map('n_f', array('1'))
        ELSE map('sort', array(CASE WHEN value < 50 THEN 'r_o' WHEN value < 100 THEN 'r_o:up' ELSE 'a_f:asc' END), 'fields', array('a_f'), 'r_o', array('5')) END"""
    )
    slug = F.concat(F.lit("customer-"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    return t.events.select(F.col("event_id").alias("request_id"), slug.alias("slug"), params.alias("params"))


@R.add(RESOLVED_SQL + """, q AS (SELECT event_id AS request_id, event_type, value, 'customer-' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS slug FROM events),
has AS (SELECT dataset_id, bool_or(key = 'a_f') AS a_f, bool_or(key = 'r_o') AS r_o FROM columns GROUP BY 1),
j AS (SELECT q.*, r.definition_id, r.nation, r.segment, r.max_limit, coalesce(r.reason, CASE WHEN r.status <> 'published' THEN r.status END) AS unserved,
  coalesce(a_f, false) AS a_f, coalesce(r_o, false) AS r_o FROM q LEFT JOIN res r ON r.slug = q.slug AND r.enabled LEFT JOIN has h ON h.dataset_id = r.dataset_id)
SELECT request_id, slug, CASE WHEN definition_id IS NULL THEN 'SLUG_NOT_FOUND' WHEN unserved IS NOT NULL THEN 'DATASET_NOT_SERVED'
  WHEN event_type = 'error' THEN 'FILTER_NOT_ALLOWED'
  WHEN nation <> 11 AND NOT a_f OR nation <= 3 THEN 'SCHEMA_MISMATCH'
  WHEN event_type = 'purchase' AND nation = 11 AND NOT a_f THEN 'PROJECTION_NOT_ALLOWED'
  WHEN event_type = 'view' AND trunc(value) - 2 < 1 THEN 'INVALID_PAGE'
  WHEN event_type = 'signup' AND (trunc(value * 4) < 1 OR trunc(value * 4) > max_limit) THEN 'INVALID_LIMIT'
  WHEN nation = 4 OR NOT r_o THEN 'SCHEMA_MISMATCH'
  WHEN event_type = 'purchase' AND value >= 50 THEN 'SORT_NOT_ALLOWED'
  WHEN NOT a_f THEN 'SCHEMA_MISMATCH'
  WHEN event_type = 'click' THEN 'VALUE_CAST_ERROR' END AS error FROM j""")
def request_audit(t: Tables) -> DataFrame:
    return A.request_audit(requests(t), resolved(t), columns(t))


@R.add("""SELECT event_id AS request_id, canonical, substr(sha256(CAST(user_id AS VARCHAR) || '|' || CAST(event_id AS VARCHAR) || '|' || canonical), 1, 32) AS etag
FROM (SELECT *, 'fields=' || event_type || '|x&page=' || CAST(user_id AS VARCHAR) || '&sort=' || props AS canonical FROM events)""")
def request_fingerprint(t: Tables) -> DataFrame:
    params = F.expr("map('sort', array(props), 'fields', array(event_type, 'x'), 'page', array(CAST(user_id AS STRING)))")
    canonical = canonical_params(params)
    return t.events.select(
        F.col("event_id").alias("request_id"),
        canonical.alias("canonical"),
        fingerprint(F.col("user_id"), F.col("event_id"), canonical).alias("etag"),
    )
