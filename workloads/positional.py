"""Tables rebuilt from positioned fragments, and the window steps they use.

Fragments are laid out from lineitem: one page per order, one printed row per
line, with a title, a header row and a page mark. Amounts are right-aligned,
baselines jitter, and a zero discount prints nothing.
"""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridpress.model import ROW
from gridpress.operators import positional as P
from gridpress.operators.intervals import gap_threshold, merge_intervals, merge_runs, run_gaps
from gridpress.operators.normalize import bulk_cells
from gridpress.operators.profile import profile_tables
from gridpress.session import stage
from workloads.base import Registry, Tables
from workloads.cells import es_ar

R = Registry()

PAGES_PER_DOC = 50


def fragments(t: Tables) -> DataFrame:
    """The printed fragments as a table of their own, as extraction finds them."""
    return stage(printed_fragments(t), "fragments")


def printed_fragments(t: Tables) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"
    )
    doc = F.floor(F.col("l_orderkey") / PAGES_PER_DOC)
    lines = t.lineitem.select(
        doc.alias("doc_id"),
        (F.col("l_orderkey") - doc * PAGES_PER_DOC + 1).cast("int").alias("page"),
        F.row_number().over(order).alias("r"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("code"),
        es_ar(F.col("l_quantity"), 0).alias("qty"),
        es_ar(F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_discount") > 0, F.concat(es_ar(F.col("l_discount") * 100, 0), F.lit("%"))).alias("disc"),
    )

    def at(text, y, x=None, right=None, jitter=0.0, width=None) -> C:
        text = text if isinstance(text, C) else F.lit(text)
        wide = F.lit(width) if width else F.length(text) * 5.0
        left = F.lit(float(x)) if x is not None else F.lit(float(right)) - wide
        return F.when(
            text.isNotNull(),
            F.struct(
                text.alias("str"), left.alias("x"), (y + jitter).cast("double").alias("y"), wide.alias("width")
            ),
        )

    row_y = F.lit(800) - F.col("r") * 22
    cells = [
        at(F.col("code"), row_y, x=60),
        at(F.col("qty"), row_y, right=200, jitter=0.5),
        at(F.col("price"), row_y, right=330, jitter=1.0),
        at(F.col("disc"), row_y, right=430, jitter=1.5),
    ]
    top = F.lit(800)
    furniture = [
        at("Informe de operaciones del periodo", F.lit(830), x=60, width=400.0),
        at("Clave", top, x=60),
        at("Cantidad", top, right=200, jitter=0.5),
        at("Monto", top, right=330, jitter=1.0),
        at("Rebaja", top, right=430, jitter=1.5),
        at(F.concat(F.lit("Página "), F.col("page").cast("string")), F.lit(20), x=60),
    ]
    printed = F.when(F.col("r") == 1, F.array(*cells, *furniture)).otherwise(F.array(*cells))
    return lines.select("doc_id", "page", F.explode(F.array_compact(printed)).alias("f")).select(
        "doc_id", "page", "f.*", F.lit(10.0).alias("height"), F.lit(595.0).alias("page_width")
    )


# The same layout in SQL: rows numbered per order, page and document.
ROWS_SQL = """r AS (SELECT *, l_orderkey // 50 AS doc_id, CAST(l_orderkey % 50 + 1 AS INT) AS page,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) AS r,
  l_returnflag || '-' || l_linestatus AS code, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty,
  translate(format('{:,.2f}', l_extendedprice), ',.', '.,') AS price,
  CASE WHEN l_discount > 0 THEN CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '%' END AS disc
  FROM lineitem),
p AS (SELECT doc_id, page, count(*) AS n, count(disc) AS nd, CAST(CASE WHEN count(disc) = 0 THEN 3 ELSE 4 END AS INT) AS cols,
  max(length(qty)) AS lq, max(length(price)) AS lp, max(length(disc)) AS ld, min(length(qty)) AS mq FROM r GROUP BY ALL)"""


@R.add("""WITH i AS (SELECT DISTINCT l_suppkey AS k, CAST(l_quantity * 20 AS BIGINT) AS a,
  CAST(l_quantity * 20 AS BIGINT) + l_linenumber AS b FROM lineitem),
m AS (SELECT k, a, max(b) AS b FROM i GROUP BY k, a),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
  OR row_number() OVER (PARTITION BY k ORDER BY a) = 1 THEN 1 ELSE 0 END AS o FROM m),
g AS (SELECT *, sum(o) OVER (PARTITION BY k ORDER BY a) AS run FROM f)
SELECT k, CAST(run AS BIGINT) AS run, min(a) AS a, max(b) AS b FROM g GROUP BY k, run""")
def merged_intervals(t: Tables) -> DataFrame:
    return merge_intervals(_spans(t), ["k"], "a", "b")


def _spans(t: Tables) -> DataFrame:
    a = (F.col("l_quantity") * 20).cast("bigint")
    return t.lineitem.select(F.col("l_suppkey").alias("k"), a.alias("a"), (a + F.col("l_linenumber")).alias("b"))


GAPS_SQL = """WITH i AS (SELECT l_suppkey AS k, CAST(l_quantity * 20 AS BIGINT) AS a,
  CAST(l_quantity * 20 AS BIGINT) + l_linenumber AS b FROM lineitem),
m AS (SELECT k, a, max(b) AS b FROM i GROUP BY k, a),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
  THEN 1 ELSE 0 END AS o FROM m),
g AS (SELECT *, sum(o) OVER (PARTITION BY k ORDER BY a) AS run FROM f),
u AS (SELECT k, run, min(a) AS a, max(b) AS b FROM g GROUP BY k, run),
v AS (SELECT *, a - lag(b) OVER (PARTITION BY k ORDER BY a) AS gap FROM u),
w AS (SELECT k, greatest(2, coalesce(median(gap), 0) * 0.25) AS threshold FROM v GROUP BY k)"""


@R.add(GAPS_SQL + " SELECT k, CAST(threshold AS DOUBLE) AS threshold FROM w")
def gap_thresholds(t: Tables) -> DataFrame:
    gaps = run_gaps(merge_intervals(_spans(t), ["k"], "a", "b"), ["k"], "a", "b")
    return gaps.groupBy("k").agg(gap_threshold(F.median("gap")).alias("threshold"))


@R.add(GAPS_SQL + """, x AS (SELECT v.*, sum(CASE WHEN gap > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a) AS band
  FROM v JOIN w USING (k))
SELECT k, CAST(band AS INT) AS band, min(a) AS a, max(b) AS b FROM x GROUP BY k, band""")
def merged_bands(t: Tables) -> DataFrame:
    gaps = run_gaps(merge_intervals(_spans(t), ["k"], "a", "b"), ["k"], "a", "b")
    return merge_runs(gaps, ["k"], "a", "b")


@R.add("SELECT l_suppkey, median(l_extendedprice) AS price FROM lineitem GROUP BY l_suppkey")
def exact_median(t: Tables) -> DataFrame:
    return P.frequency_median(t.lineitem, ["l_suppkey"], "l_extendedprice", "price")


def _lined(t: Tables) -> DataFrame:
    return P.group_lines(P.clean_fragments(fragments(t)))


LINES_SQL = f"""WITH {ROWS_SQL}, l AS (
  SELECT doc_id, page, 0 AS line, 830.0 AS y, 1 AS n, true AS prose, false AS numeric FROM p
  UNION ALL SELECT doc_id, page, 1, 800.75, 4, false, false FROM p
  UNION ALL SELECT doc_id, page, r + 1, 800 - 22 * r + CASE WHEN disc IS NULL THEN 0.5 ELSE 0.75 END,
    CASE WHEN disc IS NULL THEN 3 ELSE 4 END, false, true FROM r
  UNION ALL SELECT doc_id, page, n + 2, 20, 1, false, false FROM p)"""


@R.add(LINES_SQL + " SELECT doc_id, page, CAST(line AS INT) AS line, CAST(n AS BIGINT) AS n FROM l")
def grouped_lines(t: Tables) -> DataFrame:
    return _lined(t).groupBy("doc_id", "page", "line").agg(F.count(F.lit(1)).alias("n"))


@R.add(LINES_SQL + " SELECT doc_id, page, CAST(line AS INT) AS line, prose, numeric FROM l")
def line_tests(t: Tables) -> DataFrame:
    return P.line_summary(_lined(t)).drop("y")


@R.add(LINES_SQL + """ SELECT doc_id, page, CAST(line AS INT) AS line,
  CAST(lag(y) OVER (PARTITION BY doc_id, page ORDER BY line) - y AS DOUBLE) AS pitch FROM l""")
def row_pitches(t: Tables) -> DataFrame:
    lines = P.line_summary(_lined(t))
    return P.row_pitch(lines).select("doc_id", "page", "line", "pitch")


@R.add(LINES_SQL + " SELECT doc_id, page, CAST(min(line) AS INT) AS first_data FROM l WHERE numeric GROUP BY ALL")
def first_data_line(t: Tables) -> DataFrame:
    lines = P.line_summary(_lined(t))
    return lines.groupBy("doc_id", "page").agg(F.min(F.when(F.col("numeric"), F.col("line"))).alias("first_data"))


@R.add(f"""WITH {ROWS_SQL}
SELECT doc_id, page, 0 AS band, CAST(60 AS BIGINT) AS "left", CAST(75 AS BIGINT) AS "right" FROM p
UNION ALL SELECT doc_id, page, 1, 200 - 5 * lq, 200 FROM p
UNION ALL SELECT doc_id, page, 2, 330 - 5 * lp, 330 FROM p
UNION ALL SELECT doc_id, page, 3, 430 - 5 * ld, 430 FROM p WHERE nd > 0""")
def detected_bands(t: Tables) -> DataFrame:
    return P.column_bands(_lined(t))


@R.add(f"""WITH {ROWS_SQL}
SELECT doc_id, page, CAST(r - 1 AS BIGINT) AS _row, code AS c1, qty AS c2, price AS c3, disc AS c4 FROM r""")
def rebuild_table(t: Tables) -> DataFrame:
    rows = P.extract_tables(fragments(t)).rows
    cells = [F.get("cells", F.lit(i)).alias(f"c{i + 1}") for i in range(4)]
    return rows.select("doc_id", "page", ROW, *cells)


@R.add(f"""WITH {ROWS_SQL}
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS INT) AS table_index, cols AS columns,
  CASE WHEN cols = 4 THEN 'Clave|Cantidad|Monto|Rebaja' ELSE 'Clave|Cantidad|Monto Rebaja' END AS headers,
  true AS has_header, n AS row_count FROM p""")
def detected_tables(t: Tables) -> DataFrame:
    tables = P.extract_tables(fragments(t)).tables
    return tables.withColumn("headers", F.array_join("headers", "|"))


@R.add(f"""WITH {ROWS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS nth FROM p)
SELECT doc_id, page, CASE WHEN cols = 4 THEN 'Clave|Cantidad|Monto|Rebaja' ELSE 'Clave|Cantidad|Monto Rebaja' END AS headers
FROM x WHERE nth = 3""")
def hinted_headers(t: Tables) -> DataFrame:
    found = P.extract_tables(fragments(t), header_hints=["clave", "Tramo"], table_index=2)
    return found.tables.select("doc_id", "page", F.array_join("headers", "|").alias("headers"))


@R.add(f"""WITH {ROWS_SQL} SELECT doc_id, page, r AS row, 'cell-count' AS kind,
  'row ' || CAST(r AS VARCHAR) || ' had 3 cells, expected 4' AS detail
FROM r JOIN p USING (doc_id, page) WHERE disc IS NULL AND cols = 4""")
def extraction_warnings(t: Tables) -> DataFrame:
    return P.extract_tables(fragments(t)).warnings.drop("table_index", "_row")


@R.add(f"""WITH {ROWS_SQL}, w AS (SELECT DISTINCT doc_id FROM p), q AS (SELECT doc_id, count(*) AS n FROM p WHERE page <= 2 GROUP BY 1)
SELECT doc_id, CASE WHEN q.n IS NULL THEN 'no-text-on-pages' ELSE 'table-index-out-of-range' END AS reason
FROM w LEFT JOIN q USING (doc_id) WHERE q.n IS NULL OR q.n < 2""")
def extraction_rejects(t: Tables) -> DataFrame:
    # Pages 1 and 2 are the argument under test: the second table among them.
    return P.extract_tables(fragments(t), pages=[2, 1, 2], table_index=1).rejects


@R.add(r"""SELECT doc_id, 'no-table' AS reason FROM documents WHERE regexp_matches(text, '[^\s]')""")
def prose_rejects(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "str"))
    printed = lines.select(
        "doc_id",
        F.lit(1).alias("page"),
        "str",
        F.lit(60.0).alias("x"),
        (F.lit(800.0) - F.col("i") * 24).alias("y"),
        (F.length("str") * 5.0).alias("width"),
        F.lit(10.0).alias("height"),
        F.lit(595.0).alias("page_width"),
    )
    return P.extract_tables(printed).rejects


@R.add(f"""WITH {ROWS_SQL}, d AS (SELECT doc_id, page, max(length(replace(rtrim(disc, '%'), ' ', ''))) AS k,
  bool_or(disc IS NULL) AS missing,
  max(CASE WHEN disc IS NULL OR CAST(rtrim(disc, '%') AS INT) % 10 = 0 THEN 1 ELSE 2 END) AS ds,
  max(CASE WHEN l_extendedprice = floor(l_extendedprice) THEN 0 ELSE length(split_part(CAST(l_extendedprice AS VARCHAR), '.', 2)) END) AS ps
  FROM r GROUP BY ALL)
SELECT doc_id, page, 0 AS pos, 'string' AS type, false AS nullable, CAST(NULL AS INT) AS decimal_scale, false AS percent FROM p
UNION ALL SELECT doc_id, page, 1, 'number', false, NULL, false FROM p
UNION ALL SELECT doc_id, page, 2, 'number', false, CAST(nullif(ps, 0) AS INT), false FROM d
UNION ALL SELECT doc_id, page, 3, 'number', missing, CAST(ds AS INT), true FROM d JOIN p USING (doc_id, page) WHERE nd > 0""")
def extracted_schemas(t: Tables) -> DataFrame:
    rows = P.extract_tables(fragments(t)).rows
    return profile_tables(bulk_cells(rows, ["doc_id", "page"]), ["doc_id", "page"]).drop("kinds")
