"""JSON payloads, reader choice, size guard and source configurations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridpress.functions.urls import is_http_url, media_type, url_extension
from gridpress.model import ROW
from gridpress.operators.keys import key_positions
from gridpress.plans.catalog import latest_published
from gridpress.plans.source_config import config_checks
from gridpress.session import scratch_root
from gridpress.sources import jsonrows as J
from gridpress.sources.delimited import read_delimited
from gridpress.sources.jsonindex import array_rows
from gridpress.sources.landing import dispatch, size_guard
from workloads.base import Registry, Tables, even
from workloads.catalog import CTE, columns, datasets

R = Registry()

# --- JSON -------------------------------------------------------------------


def _array_files(t: Tables, head: str, tail: str) -> str:
    """All orders as arrays in four files, each one JSON value over many lines."""
    group = F.pmod("o_orderkey", F.lit(4))
    ends = t.orders.groupBy(group.alias("g")).agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    record = F.to_json(F.struct("o_orderkey", F.concat(F.lit('a,"b" ]} '), "o_orderpriority").alias("note"), F.array(F.struct("o_custkey")).alias("who")))
    before = F.when(F.col("o_orderkey") == F.col("first"), F.lit(head)).otherwise(F.lit(""))
    after = F.when(F.col("o_orderkey") == F.col("last"), F.lit(tail)).otherwise(F.lit(","))
    lines = t.orders.withColumn("g", group).join(ends, "g").select("g", "o_orderkey", F.concat(before, record, after).alias("value"))
    path = f"{scratch_root(t.spark)}/gridpress/json-{uuid.uuid4().hex}"
    lines.repartition(4, "g").sortWithinPartitions("g", "o_orderkey").select("g", "value").write.partitionBy("g").text(path)
    return path


ARRAYS = """SELECT CAST(o_orderkey % 4 AS BIGINT) AS g, CAST(row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS BIGINT) AS pos,
  o_orderkey, 'a,"b" ]} ' || o_orderpriority AS note, o_custkey FROM orders"""


def _array_rows(t: Tables, path: str, json_path: str | None) -> DataFrame:
    rows, _ = array_rows(t.spark, path, json_path)
    row = F.from_json("_t", "o_orderkey bigint, note string, who array<struct<o_custkey: bigint>>").alias("r")
    group = F.regexp_extract("_file", r"g=(\d)", 1).cast("long").alias("g")
    return rows.select(group, F.col("_pos").alias("pos"), row).select("g", "pos", "r.o_orderkey", "r.note", F.col("r.who")[0]["o_custkey"].alias("o_custkey"))


@R.add(ARRAYS)
def json_array_file(t: Tables) -> DataFrame:
    """Elements of files that are one array each."""
    return _array_rows(t, _array_files(t, "[", "]"), None)


@R.add(ARRAYS)
def json_array_path(t: Tables) -> DataFrame:
    """Elements of the array at a path of each file."""
    return _array_rows(t, _array_files(t, '{"n":[1,2],"data":[0,{"x":{"list":[9]},"list":[', ']}],"end":"]"}'), "data.1.list")


RECORD = """named_struct('id', o_orderkey, 'cliente', named_struct('clave', o_custkey, 'nivel', named_struct('p', o_orderpriority)),
  'tags', array(o_orderstatus, o_orderpriority), 'total', o_totalprice)"""


def orders(t: Tables) -> DataFrame:
    """What payloads are made of, dealt over all tasks: the file may be a single row group."""
    return even(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), "o_orderkey")


def payloads(t: Tables) -> DataFrame:
    """One payload per order: an object, an array of two, or an object around an array."""
    # An object with an array member would be a wrapper, so this one has none.
    single = RECORD.replace("'tags', array(o_orderstatus, o_orderpriority), ", "").replace("\n  ", " ")
    pair = f"'[', to_json({RECORD}), ',{{\"id\":', o_orderkey + 1, ',\"total\":null}}]'"
    return orders(t).selectExpr(
        "o_orderkey AS payload_id",
        f"""CASE o_orderstatus WHEN 'O' THEN to_json({single}) WHEN 'F' THEN concat(' ', {pair})
        ELSE concat('{{"nota":"[x","items":', {pair}, '}}') END AS payload""",
    )


ROWS_SQL = """WITH first AS (SELECT o_orderkey, 0 AS pos, 'id=' || CAST(o_orderkey AS VARCHAR) || '&cliente_clave=' || CAST(o_custkey AS VARCHAR)
  || '&cliente_nivel_p=' || o_orderpriority || CASE WHEN o_orderstatus = 'O' THEN '' ELSE '&tags=["' || o_orderstatus || '","' || o_orderpriority || '"]' END || '&total=' || CAST(o_totalprice AS VARCHAR) AS cells FROM orders),
second AS (SELECT o_orderkey, 1 AS pos, 'id=' || CAST(o_orderkey + 1 AS VARCHAR) || '&total=' AS cells FROM orders WHERE o_orderstatus <> 'O')"""


def _shown(cells: str = "cells"):
    return F.array_join(
        F.transform(cells, lambda c: F.concat(c["key"], F.lit("="), F.coalesce(c["text"], F.lit("")))), "&"
    )


def flat_rows(t: Tables) -> DataFrame:
    located = J.locate_rows(J.parse_payloads(payloads(t)))
    return J.flatten_rows(J.explode_rows(located, ["payload_id"]))


@R.add(ROWS_SQL + """ SELECT o_orderkey AS payload_id, CAST(pos AS BIGINT) AS pos, cells FROM first
UNION ALL SELECT o_orderkey, pos, cells FROM second""")
def json_rows(t: Tables) -> DataFrame:
    return flat_rows(t).select("payload_id", F.col("_pos").alias("pos"), _shown().alias("cells"))


@R.add("""SELECT doc_id AS payload_id, 'invalid-json' AS status FROM documents
UNION ALL SELECT event_id, CASE event_type WHEN 'click' THEN 'no-rows' WHEN 'view' THEN 'not-rows' ELSE 'ok' END FROM events""")
def json_payload_status(t: Tables) -> DataFrame:
    props = F.when(F.col("event_type") == "click", F.lit("[ ]")).when(
        F.col("event_type") == "view", F.col("value").cast("string")
    ).otherwise(F.col("props"))
    texts = t.documents.select(F.col("doc_id").alias("payload_id"), F.concat(F.lit("{"), "text").alias("payload"))
    both = texts.unionByName(t.events.select(F.col("event_id").alias("payload_id"), props.alias("payload")))
    return J.locate_rows(J.parse_payloads(both)).select("payload_id", "status")


def path_payloads(t: Tables) -> DataFrame:
    return orders(t).selectExpr(
        "o_orderkey AS payload_id",
        f"""CASE o_orderpriority WHEN '1-URGENT' THEN concat('{{"data":[{{"rows":[', to_json({RECORD}), ',7]}}]}}')
        WHEN '2-HIGH' THEN '{{"data":[]}}' WHEN '3-MEDIUM' THEN '{{"data":[{{"rows":{{"a":1}}}}]}}'
        WHEN '5-LOW' THEN '{{"data":[{{"rows":[]}}]}}' ELSE '{{"data":"x"}}' END AS payload""",
    )


@R.add("""SELECT o_orderkey AS payload_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'ok' WHEN '2-HIGH' THEN 'index-out-of-range'
  WHEN '3-MEDIUM' THEN 'not-an-array' WHEN '5-LOW' THEN 'no-rows' ELSE 'not-an-object' END AS status FROM orders""")
def json_path_status(t: Tables) -> DataFrame:
    return J.follow_path(J.parse_payloads(path_payloads(t)), "data. 0 .rows").select("payload_id", "status")


@R.add(ROWS_SQL.replace("o_orderstatus = 'O'", "false") + """ SELECT o_orderkey AS payload_id, CAST(0 AS BIGINT) AS pos, cells FROM first JOIN orders USING (o_orderkey) WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o_orderkey, 1, 'col_1=7' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def json_path_rows(t: Tables) -> DataFrame:
    located = J.follow_path(J.parse_payloads(path_payloads(t)), "data.0.rows")
    rows = J.flatten_rows(J.explode_rows(located, ["payload_id"]))
    return rows.select("payload_id", F.col("_pos").alias("pos"), _shown().alias("cells"))


@R.add("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'number' AS kind FROM events""")
def json_flatten(t: Tables) -> DataFrame:
    parsed = J.parse_payloads(t.events.select("event_id", F.col("props").alias("payload")))
    rows = J.flatten_rows(J.explode_rows(J.locate_rows(parsed), ["event_id"]))
    cell = F.col("cells")[0]
    return rows.select("event_id", cell["text"].try_cast("bigint").alias("k"), cell["kind"].alias("kind"))


@R.add("""WITH k AS (SELECT o_orderkey * 10 AS place, 'id' AS key FROM orders UNION ALL SELECT o_orderkey * 10 + 1, 'cliente_clave' FROM orders
UNION ALL SELECT o_orderkey * 10 + 2, 'cliente_nivel_p' FROM orders
UNION ALL SELECT o_orderkey * 10 + 3, 'tags' FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT o_orderkey * 10 + CASE WHEN o_orderstatus = 'O' THEN 3 ELSE 4 END, 'total' FROM orders)
SELECT key, CAST(row_number() OVER (ORDER BY min(place)) AS INT) AS pos FROM k GROUP BY key""")
def json_keys(t: Tables) -> DataFrame:
    rows = flat_rows(t).withColumn(ROW, F.col("payload_id") * 2 + F.col("_pos"))
    # One record per distinct key is left when the window runs.
    found = key_positions(rows, F.transform("cells", lambda c: c["key"]))
    return found.select("key", F.row_number().over(W.orderBy("first")).alias("pos"))


@R.add("SELECT 'tags' AS key FROM orders HAVING count(*) > 0")
def json_array_keys(t: Tables) -> DataFrame:
    return J.array_keys(flat_rows(t))


@R.add("""WITH n AS (SELECT *, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END) OVER (ORDER BY o_orderkey)
  - CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS BIGINT) AS r FROM orders)
SELECT r AS _row, CAST(o_orderkey AS DOUBLE) AS id, CAST(o_custkey AS DOUBLE) AS cliente_clave, o_orderpriority AS cliente_nivel_p,
  CASE WHEN o_orderstatus <> 'O' THEN '["' || o_orderstatus || '","' || o_orderpriority || '"]' END AS tags, o_totalprice AS total FROM n
UNION ALL SELECT r + 1, o_orderkey + 1, NULL, NULL, NULL, NULL FROM n WHERE o_orderstatus <> 'O'""")
def json_table(t: Tables) -> DataFrame:
    return J.read_json(payloads(t), "manual").table.rows


DEEP = 12


@R.add(f"""SELECT o_orderkey AS payload_id, 'id=' || CAST(o_orderkey AS VARCHAR) || '&a{"_b" * DEEP}=' || CAST(o_custkey AS VARCHAR) || '&t=' || o_orderstatus AS cells FROM orders""")
def json_deep_rows(t: Tables) -> DataFrame:
    opening, closing = '{"b":' * DEEP, "}" * DEEP
    deep = orders(t).selectExpr(
        "o_orderkey AS payload_id",
        f"""concat('{{"id":', o_orderkey, ',"a":{opening}', o_custkey, '{closing},"t":"', o_orderstatus, '"}}') AS payload""",
    )
    rows = J.flatten_rows(J.explode_rows(J.locate_rows(J.parse_payloads(deep)), ["payload_id"]))
    return rows.select("payload_id", _shown().alias("cells"))


# --- delimited text ---------------------------------------------------------


def _written(t: Tables, lines: DataFrame, order: str) -> str:
    """Text files of a table, four or more, in the order of a key."""
    path = f"{scratch_root(t.spark)}/gridpress/text-{uuid.uuid4().hex}"
    lines.repartitionByRange(4, order).sortWithinPartitions(order).select("value").write.text(path)
    return path


CUSTOMERS = """SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS _row, c_custkey, c_name || ', "x"' AS name, c_acctbal FROM customer"""


@R.add(f"SELECT _row, CAST(c_custkey AS VARCHAR) AS key, name, CAST(c_acctbal AS VARCHAR) AS bal FROM ({CUSTOMERS})")
def csv_table(t: Tables) -> DataFrame:
    path = f"{scratch_root(t.spark)}/gridpress/text-{uuid.uuid4().hex}"
    rows = t.customer.select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("name"), "c_acctbal")
    sorted_rows = rows.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    sorted_rows.write.option("header", True).option("escape", '"').csv(path)
    table = read_delimited(t.spark, path)
    key, name, bal = table.cells
    return table.rows.select(ROW, key.alias("key"), name.alias("name"), bal.alias("bal"))


LETTERS = """SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS _row, c_custkey,
  'Dear "' || c_name || '",' || chr(10) || chr(10) || 'yours, ' || c_mktsegment || chr(10) AS note, c_acctbal FROM customer"""


@R.add(f"SELECT _row, CAST(c_custkey AS VARCHAR) AS key, note, CAST(c_acctbal AS VARCHAR) AS bal FROM ({LETTERS})")
def csv_multiline(t: Tables) -> DataFrame:
    """Cells with quotes, delimiters and line breaks inside them."""
    path = f"{scratch_root(t.spark)}/gridpress/text-{uuid.uuid4().hex}"
    note = F.concat(F.lit('Dear "'), "c_name", F.lit('",\n\nyours, '), "c_mktsegment", F.lit("\n"))
    rows = t.customer.select("c_custkey", note.alias("note"), "c_acctbal")
    sorted_rows = rows.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    sorted_rows.write.options(header=True, escape='"', ignoreTrailingWhiteSpace=False).csv(path)
    table = read_delimited(t.spark, path, multi_line=True)
    key, note, bal = table.cells
    return table.rows.select(ROW, key.alias("key"), note.alias("note"), bal.alias("bal"))


RAGGED = """SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS r,
  CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 3 END AS n FROM customer"""


def _ragged(t: Tables):
    rest = F.when(F.col("c_custkey") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit(","), F.col("c_nationkey")))
    value = F.concat(F.col("c_custkey").cast("string"), F.lit(',"a,b"'), rest)
    lines = t.customer.select("c_custkey", value.alias("value"))
    return read_delimited(t.spark, _written(t, lines, "c_custkey"), has_header=False)


@R.add(f"""SELECT r AS _row, CAST(c_custkey AS VARCHAR) AS col_1, 'a,b' AS col_2, CASE WHEN n = 3 THEN CAST(c_nationkey AS VARCHAR) END AS col_3
FROM ({RAGGED}) JOIN customer USING (c_custkey)""")
def csv_headerless(t: Tables) -> DataFrame:
    table = _ragged(t)
    return table.rows.select(ROW, *[c.alias(h) for c, h in zip(table.cells, table.headers)])


@R.add(f"""SELECT r AS _row, 'row ' || CAST(r + 1 AS VARCHAR) || ' had 2 cells, expected 3' AS detail FROM ({RAGGED}) WHERE n = 2""")
def csv_ragged_warnings(t: Tables) -> DataFrame:
    return _ragged(t).warnings.select(ROW, "detail")


# --- files ------------------------------------------------------------------

FILES = [
    "page_id",
    """CASE WHEN url LIKE '%.html%' THEN 'text/html; charset=utf-8' WHEN url LIKE '%utm_source%' THEN ' Application/JSON ; charset=utf-8'
       WHEN url LIKE '%#top' THEN 'text/csv' END AS content_type""",
    "CASE WHEN url LIKE 'https://m.%' THEN 'APPLICATION/PDF;q=1' END AS hint",
    """CASE WHEN url LIKE '%//blog.%' THEN url || '/datos.TSV?x=1.pdf' WHEN url LIKE '%.example.org/%' THEN url || '/.json' ELSE url END AS url""",
]
FILES_CTE = f"WITH f AS (SELECT {', '.join(FILES)} FROM pages), e AS (SELECT *, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') AS seg FROM f)," + """
x AS (SELECT *, CASE WHEN position('.' IN substr(seg, 2)) > 0 THEN lower(regexp_extract(seg, '\\.([^.]*)$', 1)) ELSE '' END AS ext FROM e)"""


@R.add(FILES_CTE + " SELECT page_id, ext FROM x")
def url_extension_of_pages(t: Tables) -> DataFrame:
    return t.pages.selectExpr(*FILES).select("page_id", url_extension(F.col("url")).alias("ext"))


@R.add(FILES_CTE + """ SELECT page_id, coalesce(CASE WHEN content_type LIKE '%JSON%' THEN 'json' WHEN content_type = 'text/csv' THEN 'csv' END,
  CASE WHEN hint IS NOT NULL THEN 'pdf' END, CASE ext WHEN 'pdf' THEN 'pdf' WHEN 'json' THEN 'json' WHEN 'geojson' THEN 'json'
  WHEN 'csv' THEN 'csv' WHEN 'tsv' THEN 'csv' WHEN 'txt' THEN 'csv' END) AS reader FROM x""")
def dispatch_media_type(t: Tables) -> DataFrame:
    return dispatch(t.pages.selectExpr(*FILES), "content_type", "hint", "url").select("page_id", "reader")


@R.add(FILES_CTE + " SELECT page_id, lower(trim(split_part(content_type, ';', 1))) AS media FROM x")
def media_type_of_pages(t: Tables) -> DataFrame:
    return t.pages.selectExpr(*FILES).select("page_id", media_type(F.col("content_type")).alias("media"))


@R.add("""SELECT page_id, regexp_matches(u, '^https?://[^/ ]+') AND NOT contains(u, ' ') AS ok FROM (SELECT page_id, CASE WHEN url LIKE '%/fr/%' THEN replace(url, 'http', 'ftp')
  WHEN url LIKE '%/es/%' THEN 'x y ' || url ELSE url END AS u FROM pages)""")
def http_urls(t: Tables) -> DataFrame:
    url = F.expr("CASE WHEN url LIKE '%/fr/%' THEN replace(url, 'http', 'ftp') WHEN url LIKE '%/es/%' THEN 'x y ' || url ELSE url END")
    return t.pages.select("page_id", is_http_url(url).alias("ok"))


@R.add("SELECT doc_id, n_chars, n_chars <= 2000 AS accepted FROM documents")
def size_guarded(t: Tables) -> DataFrame:
    return size_guard(t.documents.select("doc_id", "n_chars"), "n_chars", 2000)


@R.add(CTE + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY version DESC) AS rn FROM datasets WHERE status = 'published') WHERE rn = 1)
SELECT source_id, dataset_id, key, type FROM l JOIN columns USING (dataset_id)""")
def latest_schemas(t: Tables) -> DataFrame:
    latest = latest_published(datasets(t)).select("source_id", "dataset_id")
    return latest.join(columns(t), "dataset_id")


CONFIG = """CASE c_nationkey
  WHEN 0 THEN '{"format":"csv","payload":"a,b"}' WHEN 1 THEN '{"format":"xml","payload":"a"}' WHEN 2 THEN '{"format":"json","payload":"  "}'
  WHEN 3 THEN '{"url":"https://a.example.com/x","method":"GET"}' WHEN 4 THEN '{"url":"ftp://a.example.com","method":"POST","contentTypeHint":"x"}'
  WHEN 5 THEN '{"url":"https://a.example.com","pages":[1,2],"tableIndex":0,"headerHints":["a"]}' WHEN 6 THEN '{"url":"https://a.example.com","pages":[0]}'
  WHEN 7 THEN '{"url":"https://a.example.com","tableIndex":1.5}' WHEN 8 THEN '{"url":"https://a.example.com","headerHints":[1]}'
  WHEN 9 THEN 'not json' WHEN 10 THEN '{"url":"https://a.example.com","contentTypeHint":5}' ELSE '{"url":"https://a.example.com/d.pdf"}' END"""
CONFIG_TYPE = """CASE WHEN c_nationkey <= 2 THEN 'manual' WHEN c_nationkey <= 4 THEN 'api' WHEN c_nationkey <= 8 THEN 'pdf' ELSE 'url' END"""


@R.add("""SELECT c_custkey AS source_id, CASE WHEN c_nationkey IN (1, 6, 7, 8, 9, 10) THEN 'CONFIG_SHAPE'
  WHEN c_nationkey = 2 THEN 'PAYLOAD_EMPTY' WHEN c_nationkey = 4 THEN 'URL_INVALID' END AS error FROM customer""")
def source_config_checks(t: Tables) -> DataFrame:
    return config_checks(t.customer.selectExpr("c_custkey AS source_id", f"{CONFIG_TYPE} AS type", f"{CONFIG} AS config"))
