"""Cell reading, header keys and schema inference over text built from the tables."""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridpress.functions import cells as X
from gridpress.functions import numbers as N
from gridpress.functions.text import (
    collapse,
    header_key_expr,
    slug_valid,
    slugify,
    unique_keys_expr,
)
from gridpress.model import ROW
from gridpress.operators.keys import header_union, key_positions, widest_row
from gridpress.operators.normalize import normalize_table
from gridpress.session import stage
from workloads.base import Registry, Tables, even

R = Registry()

PRICE = "l_extendedprice"


def es_ar(value: C, scale: int = 2) -> C:
    return F.translate(F.format_number(value, scale), ",.", ".,")


# One writing of the price per line number; the SQL side never parses text.
def amount_texts() -> C:
    n = F.col("l_linenumber")
    return (
        F.when(n == 1, es_ar(F.col(PRICE)))
        .when(n == 2, F.format_number(F.col(PRICE), 2))
        .when(n == 3, F.concat(F.lit("$ "), es_ar(F.col(PRICE))))
        .when(n == 4, F.concat(F.lit("("), es_ar(F.col(PRICE)), F.lit(")")))
        .when(n == 5, F.concat(F.lit(" -"), N.number_text(F.col(PRICE))))
        .when(n == 6, es_ar(F.floor(F.col(PRICE)), 0))
        .otherwise(F.concat(N.number_text(F.col(PRICE)), F.lit("x")))
    )


@R.add("""SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber <= 3 THEN l_extendedprice WHEN l_linenumber <= 5 THEN -l_extendedprice
       WHEN l_linenumber = 6 AND l_extendedprice < 1000 THEN floor(l_extendedprice) END AS value,
  l_linenumber = 6 AND l_extendedprice >= 1000 AS ambiguous
FROM lineitem""")
def normalize_numbers(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", amount_texts().alias("raw"))
    return rows.withColumn("p", N.parse_number(F.col("raw"))).select(
        "l_orderkey", "l_linenumber", "p.value", "p.ambiguous"
    )


@R.add("""SELECT l_orderkey, l_linenumber, round(l_discount * 100) / 100 AS discount, round(l_tax * 100) / 100 AS tax
FROM lineitem""")
def normalize_percent(t: Tables) -> DataFrame:
    def back(df: DataFrame, name: str) -> DataFrame:
        text = F.concat(es_ar(F.col(name) * 100, 1), F.lit("%"))
        return X.read_cells(df.withColumn("raw", text), "raw").select(
            *df.columns, F.col("cell.n").alias(name.removeprefix("l_"))
        )

    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return back(back(rows, "l_discount"), "l_tax").drop("l_discount", "l_tax")


@R.add("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents""")
def collapse_whitespace(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", collapse(F.col("text")).alias("text"))


# A word per customer segment: null markers, truth words, and ordinary text.
WORD = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ' N/A' WHEN 'BUILDING' THEN '--'
  WHEN 'FURNITURE' THEN 'Sí' WHEN 'MACHINERY' THEN 'NO' ELSE 'No aplica' END"""


@R.add(f"""SELECT c_custkey, lower(trim(w)) IN ('n/a', '--') AS is_null,
  CASE lower(trim(w)) WHEN 'sí' THEN true WHEN 'no' THEN false END AS flag
FROM (SELECT c_custkey, {WORD} AS w FROM customer)""")
def null_and_boolean_tokens(t: Tables) -> DataFrame:
    text = collapse(F.expr(WORD))
    return t.customer.select(
        "c_custkey", X.is_null_token(text).alias("is_null"), X.boolean_value(text).alias("flag")
    )


@R.add("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS instant
FROM orders""")
def iso_dates(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    raw = (
        F.when(status == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(status == "F", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    )
    instant = F.date_format(X.date_value(raw), "yyyy-MM-dd'T'HH:mm:ss")
    return t.orders.select("o_orderkey", instant.alias("instant"))


def cell_texts() -> C:
    n = F.col("l_linenumber")
    return (
        F.when(n == 1, es_ar(F.col(PRICE)))
        .when(n == 2, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .when(n == 3, F.when(F.col("l_returnflag") == "N", F.lit("no")).otherwise(F.lit(" SI ")))
        .when(n == 4, F.lit(" Sin   dato "))
        .when(n == 5, F.concat(F.lit("  lote   "), F.col("l_returnflag"), F.lit("\t"), F.col("l_linestatus")))
        .when(n == 6, es_ar(F.floor(F.col(PRICE)), 0))
        .otherwise(F.concat(es_ar(F.col("l_quantity"), 0), F.lit("%")))
    )


@R.add("""SELECT l_orderkey, l_linenumber,
  CASE l_linenumber WHEN 1 THEN 'number' WHEN 2 THEN 'date' WHEN 3 THEN 'boolean' WHEN 4 THEN 'null' WHEN 5 THEN 'string'
    WHEN 6 THEN CASE WHEN l_extendedprice < 1000 THEN 'number' ELSE 'string' END ELSE 'number' END AS kind,
  CASE l_linenumber WHEN 5 THEN 'lote ' || l_returnflag || ' ' || l_linestatus
    WHEN 6 THEN CASE WHEN l_extendedprice >= 1000 THEN replace(format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)), ',', '.') END END AS s,
  CASE l_linenumber WHEN 1 THEN l_extendedprice WHEN 6 THEN CASE WHEN l_extendedprice < 1000 THEN floor(l_extendedprice) END
    WHEN 7 THEN l_quantity / 100 END AS n,
  CASE l_linenumber WHEN 3 THEN l_returnflag <> 'N' END AS b,
  CASE l_linenumber WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d') END AS t,
  l_linenumber = 6 AND l_extendedprice >= 1000 AS ambiguous
FROM lineitem""")
def normalize_cells(t: Tables) -> DataFrame:
    lines = even(t.lineitem, "l_orderkey", "l_linenumber")
    rows = stage(lines.select("l_orderkey", "l_linenumber", cell_texts().alias("raw")), "cells")
    return X.read_cells(rows, "raw").select(
        "l_orderkey",
        "l_linenumber",
        "cell.kind",
        "cell.s",
        "cell.n",
        "cell.b",
        F.date_format("cell.t", "yyyy-MM-dd").alias("t"),
        "cell.ambiguous",
    )


@R.add("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_type || ') %'), '[^a-z0-9]+', '_', 'g'), '_') AS key,
  'col_' || CAST(p_size AS VARCHAR) || '_' || replace(p_name, ' ', '_') AS digit_key, 'col_' || CAST(p_size + 1 AS VARCHAR) AS empty_key
FROM part""")
def header_key_texts(t: Tables) -> DataFrame:
    header = F.concat("p_name", F.lit(" ("), "p_type", F.lit(") %"))
    digits = F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit("° "), F.col("p_name"))
    place = F.col("p_size")
    return t.part.select(
        "p_partkey",
        header_key_expr(header, place).alias("key"),
        header_key_expr(digits, place).alias("digit_key"),
        header_key_expr(F.lit("***"), place).alias("empty_key"),
    )


@R.add("""SELECT p_partkey, k || ',' || k || '_2,' || k || '_2_2,' || k || '_3' AS keys
FROM (SELECT p_partkey, lower(p_type) AS k FROM part)""")
def header_key_dedupe(t: Tables) -> DataFrame:
    kind = F.col("p_type")
    headers = F.array(kind, F.concat(kind, F.lit(".")), F.concat(kind, F.lit(" 2")), kind)
    keys = F.transform(headers, header_key_expr)
    return t.part.select("p_partkey", F.array_join(unique_keys_expr(keys), ",").alias("keys"))


@R.add("""SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  regexp_full_match(p_name, '[a-z0-9]+(-[a-z0-9]+)*') AND length(p_name) BETWEEN 3 AND 80 AS raw_valid, true AS slug_valid
FROM part""")
def slug_texts(t: Tables) -> DataFrame:
    slug = slugify(F.concat("p_brand", F.lit(" "), "p_name"))
    return t.part.select(
        "p_partkey",
        slug.alias("slug"),
        slug_valid(F.col("p_name")).alias("raw_valid"),
        slug_valid(slug).alias("slug_valid"),
    )


# --- whole-table normalisation ---------------------------------------------

HEADERS = ["Nº Línea", "Monto ($)", "Rebaja %", "Desde", "Activo", "Nota", "Nota"]


def raw_table(t: Tables) -> DataFrame:
    """Lineitem written as a messy text table, seven cells per row.

    The row position is the place in (order, line, part) order, as a file
    written in that order would have it.
    """
    note = F.when(F.col("l_linestatus") == "F", es_ar(F.col("l_quantity"), 0)).otherwise(
        F.concat(F.lit("lote  "), F.col("l_returnflag"))
    )
    cells = F.array(
        F.col("l_linenumber").cast("string"),
        es_ar(F.col(PRICE)),
        F.concat(es_ar(F.col("l_discount") * 100, 0), F.lit("%")),
        F.date_format("l_shipdate", "yyyy-MM-dd"),
        F.when(F.col("l_returnflag") == "R", F.lit("-")).when(F.col("l_returnflag") == "A", F.lit("Sí")).otherwise("No"),
        note,
        F.when(F.col("l_linenumber") > 1, F.lit("x")),
    )
    # The surrogate position keeps source order without a global window.
    position = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = even(t.lineitem, "l_orderkey", "l_linenumber")
    # The normaliser reads the text more than once: it is a table, as a file would be.
    return stage(lines.select(position.alias(ROW), cells.alias("cells")), "raw")


def normalized(t: Tables):
    cells = [F.get(F.col("cells"), F.lit(i)) for i in range(len(HEADERS))]
    return normalize_table(raw_table(t), HEADERS, cells, source="manual")


def columns_frame(spark, columns) -> DataFrame:
    return spark.createDataFrame(
        [(i, c.key, c.label, c.type, c.nullable, c.decimal_scale, c.percent) for i, c in enumerate(columns)],
        "pos int, key string, label string, type string, nullable boolean, decimal_scale int, percent boolean",
    )


@R.add("""WITH x AS (SELECT *, CAST(l_extendedprice AS VARCHAR) AS p, CAST(round(l_discount * 100) / 100 AS VARCHAR) AS d FROM lineitem),
s AS (SELECT max(CASE WHEN l_extendedprice = floor(l_extendedprice) THEN 0 ELSE length(split_part(p, '.', 2)) END) AS ps,
  max(CASE WHEN round(l_discount * 100) % 100 = 0 THEN 0 ELSE length(split_part(d, '.', 2)) END) AS ds,
  bool_or(l_returnflag = 'R') AS r, bool_or(l_linenumber = 1) AS one FROM x)
SELECT * FROM (SELECT 0 AS pos, 'no_linea' AS key, 'Nº Línea' AS label, 'number' AS type, false AS nullable, CAST(NULL AS INT) AS decimal_scale, false AS percent
UNION ALL SELECT 1, 'monto', 'Monto ($)', 'number', false, CAST(ps AS INT), false FROM s
UNION ALL SELECT 2, 'rebaja', 'Rebaja %', 'number', false, CAST(ds AS INT), true FROM s
UNION ALL SELECT 3, 'desde', 'Desde', 'date', false, NULL, false
UNION ALL SELECT 4, 'activo', 'Activo', 'boolean', r, NULL, false FROM s
UNION ALL SELECT 5, 'nota', 'Nota', 'string', false, NULL, false
UNION ALL SELECT 6, 'nota_2', 'Nota', 'string', one, NULL, false FROM s)""")
def infer_schema(t: Tables) -> DataFrame:
    return columns_frame(t.spark, normalized(t).columns)


@R.add("""SELECT l_orderkey * 8 + l_linenumber AS _row, CAST(l_linenumber AS DOUBLE) AS no_linea, l_extendedprice AS monto,
  round(l_discount * 100) / 100 AS rebaja, strftime(l_shipdate, '%Y-%m-%d') AS desde,
  CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS activo,
  CASE WHEN l_linestatus = 'F' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE 'lote ' || l_returnflag END AS nota,
  CASE WHEN l_linenumber > 1 THEN 'x' END AS nota_2
FROM lineitem""")
def normalize_rows(t: Tables) -> DataFrame:
    rows = normalized(t).rows
    return rows.withColumn("desde", F.date_format("desde", "yyyy-MM-dd"))


@R.add("""SELECT 'mixed-types' AS kind, 5 AS col_pos, 'mixed-types column ''nota'': ' || string_agg(k, ', ' ORDER BY r) || ' -> string' AS detail
FROM (SELECT CASE WHEN l_linestatus = 'F' THEN 'number' ELSE 'string' END AS k, min(l_orderkey * 8 + l_linenumber) AS r
  FROM lineitem GROUP BY 1) HAVING count(*) > 1""")
def column_warnings(t: Tables) -> DataFrame:
    return normalized(t).warnings.select("kind", "col_pos", "detail")


@R.add("""SELECT l_orderkey * 8 + l_linenumber AS _row, 0 AS col_pos,
  'column ''monto'': ambiguous-number "' || replace(format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)), ',', '.') || '"' AS detail
FROM lineitem WHERE l_extendedprice >= 1000 AND l_extendedprice < 1000000""")
def cell_warnings(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(ROW), es_ar(F.floor(F.col(PRICE)), 0).alias("m")
    )
    out = normalize_table(rows, ["Monto"], [F.col("m")])
    return out.warnings.where("kind = 'ambiguous-number'").select(ROW, "col_pos", "detail")


@R.add("""SELECT count(*) FILTER (WHERE nullif(o_orderpriority, '5-LOW') IS NULL) > 0 AS nullable,
  max(CASE WHEN o_totalprice = floor(o_totalprice) THEN 0 ELSE length(split_part(CAST(o_totalprice AS VARCHAR), '.', 2)) END) AS scale
FROM orders""")
def nullable_scale(t: Tables) -> DataFrame:
    return t.orders.agg(
        F.bool_or(F.nullif("o_orderpriority", F.lit("5-LOW")).isNull()).alias("nullable"),
        F.max(N.decimal_places(F.col("o_totalprice"))).alias("scale"),
    ).select("nullable", F.col("scale").cast("bigint").alias("scale"))


# --- headers from rows ------------------------------------------------------


def labelled_rows(t: Tables) -> DataFrame:
    """Part rows as text maps whose keys vary with brand and size."""
    row = F.map_concat(
        F.create_map(F.lit("nombre"), F.col("p_name")),
        F.when(F.col("p_size") > 25, F.create_map(F.lit("grande"), F.lit("sí"))).otherwise(
            F.create_map(F.lit("chico"), F.lit("sí"))
        ),
        F.create_map(F.concat(F.lit("marca "), F.col("p_brand")), F.col("p_type")),
    )
    return t.part.select(F.col("p_partkey").alias(ROW), row.alias("m"))


HEADER_SQL = """WITH k AS (SELECT p_partkey AS r, 0 AS p, 'nombre' AS key FROM part
UNION ALL SELECT p_partkey, 1, CASE WHEN p_size > 25 THEN 'grande' ELSE 'chico' END FROM part
UNION ALL SELECT p_partkey, 2, 'marca ' || p_brand FROM part),
f AS (SELECT key, min(r * 10 + p) AS first FROM k GROUP BY key)
SELECT key, CAST(row_number() OVER (ORDER BY first) AS BIGINT) AS pos FROM f"""


@R.add(HEADER_SQL)
def header_union_keys(t: Tables) -> DataFrame:
    found = key_positions(labelled_rows(t), F.map_keys("m"))
    # One record per distinct key is left: numbering them is a small window.
    return found.select("key", F.row_number().over(W.orderBy("first")).cast("bigint").alias("pos"))


@R.add("""SELECT p_partkey AS _row, p_name AS nombre, CASE WHEN p_size > 25 THEN true END AS grande,
  CASE WHEN p_size <= 25 THEN true END AS chico FROM part""")
def normalize_labelled_rows(t: Tables) -> DataFrame:
    rows = labelled_rows(t)
    headers = header_union(rows, F.map_keys("m"))
    out = normalize_table(rows, headers, [F.col("m")[h] for h in headers], source="api")
    return out.rows.select(ROW, "nombre", "grande", "chico")


@R.add("SELECT CAST(max(len(string_split(text, ' '))) AS BIGINT) AS width FROM documents")
def widest_row_cells(t: Tables) -> DataFrame:
    width = widest_row(t.documents, F.split("text", " "))
    return t.spark.createDataFrame([(width,)], "width bigint")
