"""Display text of numbers, dates, counts, sizes, durations and whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.functions import display as V
from gridpress.model import Column
from workloads.base import Registry, Tables, even

R = Registry()


@R.add("""WITH x AS (SELECT *, CAST(l_extendedprice AS DECIMAL(18, 4)) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, translate(format('{:,.2f}', l_extendedprice), ',.', '.,') AS scale_2,
  replace(format('{:,}', CAST(round(p, 0) AS BIGINT)), ',', '.') AS scale_0,
  '-' || translate(format('{:,.3f}', l_extendedprice), ',.', '.,') AS scale_3,
  CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || ' %' AS percent, '—' AS missing
FROM x""")
def render_numbers(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    lines = even(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), "l_orderkey", "l_linenumber")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        V.number_display(price).alias("scale_2"),
        V.count_display(price).alias("scale_0"),
        V.number_display(-price, 3).alias("scale_3"),
        V.number_display(F.col("l_discount"), 4).alias("percent"),
        V.number_display(F.lit(None).cast("double"), 2).alias("missing"),
    )


@R.add("""SELECT o_orderkey, coalesce(strftime(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, '%d/%m/%Y'), '—') AS day,
  strftime(o_orderdate + INTERVAL 754 MINUTE, '%d/%m/%Y, %H:%M') AS instant FROM orders""")
def render_dates(t: Tables) -> DataFrame:
    kept = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    later = F.col("o_orderdate") + F.expr("INTERVAL '754' MINUTE")
    return t.orders.select(
        "o_orderkey", V.day_display(kept).alias("day"), V.datetime_display(later).alias("instant")
    )


@R.add("""WITH x AS (SELECT doc_id, n_chars AS n, n_chars * 1000 AS m FROM documents)
SELECT doc_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' ELSE CAST((n * 20 + 1024) // 2048 // 10 AS VARCHAR) || ',' || CAST((n * 20 + 1024) // 2048 % 10 AS VARCHAR) || ' kB' END AS small,
  CASE WHEN m < 1024 THEN CAST(m AS VARCHAR) || ' B' WHEN m < 1048576 THEN CAST((m * 20 + 1024) // 2048 // 10 AS VARCHAR) || ',' || CAST((m * 20 + 1024) // 2048 % 10 AS VARCHAR) || ' kB'
    ELSE CAST((m * 20 + 1048576) // 2097152 // 10 AS VARCHAR) || ',' || CAST((m * 20 + 1048576) // 2097152 % 10 AS VARCHAR) || ' MB' END AS large,
  replace(format('{:,}', n), ',', '.') AS count FROM x""")
def render_sizes(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return t.documents.select(
        "doc_id",
        V.bytes_display(n).alias("small"),
        V.bytes_display(n * 1000).alias("large"),
        V.count_display(n).alias("count"),
    )


@R.add("""WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS ms FROM orders UNION ALL SELECT o_orderkey, CAST(floor(o_totalprice / 7) AS BIGINT) FROM orders)
SELECT o_orderkey, CASE WHEN ms < 1000 THEN CAST(ms AS VARCHAR) || ' ms'
  WHEN ms < 60000 THEN CASE WHEN ms % 500 = 250 THEN CAST((ms + 50) // 1000 AS VARCHAR) || ',' || CAST((ms + 50) // 100 % 10 AS VARCHAR)
    ELSE replace(format('{:.1f}', ms / 1000.0), '.', ',') END || ' s'
  ELSE CAST(ms // 60000 AS VARCHAR) || ' min ' || CAST((ms % 60000 + 500) // 1000 AS VARCHAR) || ' s' END AS duration FROM x""")
def render_durations(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    ms = t.orders.select("o_orderkey", F.explode(F.array(F.floor(price), F.floor(price / 7))).alias("ms"))
    return ms.select("o_orderkey", V.duration_display(F.col("ms")).alias("duration"))


@R.add("""SELECT event_id, CASE event_type WHEN 'view' THEN '—' WHEN 'click' THEN 'Sí' ELSE 'No' END AS flag,
  CASE WHEN event_type = 'error' THEN '—' ELSE props END AS json FROM events
UNION ALL SELECT doc_id, 'No', CASE WHEN coalesce(text, '') = '' THEN '—' WHEN length(text) <= 120 THEN text ELSE left(text, 119) || '…' END FROM documents""")
def render_flags_and_json(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    flag = F.when(kind != "view", kind == "click")
    events = t.events.select(
        "event_id",
        V.boolean_display(flag).alias("flag"),
        V.json_display(F.when(kind == "error", F.lit("")).otherwise(F.col("props"))).alias("json"),
    )
    texts = t.documents.select(
        F.col("doc_id").alias("event_id"), V.boolean_display(F.lit(False)).alias("flag"), V.json_display(F.col("text")).alias("json")
    )
    return events.unionByName(texts)


@R.add("""SELECT CAST(o_orderkey AS VARCHAR) AS "Orden", strftime(o_orderdate, '%d/%m/%Y') AS "Fecha",
  translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS "Importe ($)" FROM orders""")
def render_rows(t: Tables) -> DataFrame:
    columns = [
        Column("o_orderkey", "string", "Orden"),
        Column("o_custkey", "number", "Cliente"),
        Column("o_orderdate", "date", "Fecha"),
        Column("o_totalprice", "number", "Importe ($)", decimal_scale=2),
    ]
    rows = t.orders.withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    return V.render(rows, columns, ["o_totalprice", "o_orderkey", "o_orderdate"])
