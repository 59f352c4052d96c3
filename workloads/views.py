"""View queries: filters, sort, projection, paging, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridpress.model import Column, Definition, FilterRule, SortRule
from gridpress.operators.view import project, view
from workloads.base import Registry, Tables

R = Registry()

ORDER_FIELDS = ("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")


def _filtered(df: DataFrame, field: str, op: str, value: str, fields: tuple[str, ...]) -> DataFrame:
    definition = Definition("orders", fields=fields, filters=(FilterRule(field, op),))
    v = view(df, definition, {field: value})
    return v.filtered.select(*v.projection)


def _orders(field: str, op: str, value: str):
    return lambda t: _filtered(t.orders, field, op, value, ORDER_FIELDS)


@R.add("SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def view_eq(t: Tables) -> DataFrame:
    return _orders("o_orderpriority", "eq", "1-URGENT")(t)


@R.add("""SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders
WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'""")
def view_ne(t: Tables) -> DataFrame:
    return _orders("o_orderpriority", "ne", "1-URGENT")(t)


@R.add("SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 250000.5")
def view_gt(t: Tables) -> DataFrame:
    return _orders("o_totalprice", "gt", "250000.5")(t)


@R.add("""SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01'""")
def view_gte(t: Tables) -> DataFrame:
    return _orders("o_orderdate", "gte", "1998-01-01")(t)


@R.add("""SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders
WHERE o_orderdate < TIMESTAMP '1996-06-30 12:00:00'""")
def view_lt(t: Tables) -> DataFrame:
    return _orders("o_orderdate", "lt", "1996-06-30T12:00:00Z")(t)


@R.add("SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey <= 5000")
def view_lte(t: Tables) -> DataFrame:
    return _orders("o_orderkey", "lte", "5000")(t)


@R.add("""SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def view_in(t: Tables) -> DataFrame:
    return _orders("o_orderpriority", "in", "1-URGENT, 5-LOW ,")(t)


@R.add("""SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders
WHERE o_orderkey < 400000 AND o_orderkey % 4 = 1""")
def view_in_long(t: Tables) -> DataFrame:
    """A list of 100,000 values."""
    return _orders("o_orderkey", "in", ",".join(map(str, range(1, 400_000, 4))))(t)


@R.add("""SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders
WHERE o_totalprice BETWEEN 100000 AND 200000""")
def view_between(t: Tables) -> DataFrame:
    return _orders("o_totalprice", "between", "100000,200000")(t)


@R.add("""SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders
WHERE o_totalprice BETWEEN 200000 AND 100000""")
def view_between_reversed(t: Tables) -> DataFrame:
    return _orders("o_totalprice", "between", "200000,100000")(t)


@R.add("SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'the')")
def view_contains(t: Tables) -> DataFrame:
    return _filtered(t.documents, "text", "contains", "THE", ("doc_id", "lang", "n_chars"))


@R.add("SELECT p_partkey, p_name, p_type FROM part WHERE starts_with(lower(p_name), 'small')")
def view_starts_with(t: Tables) -> DataFrame:
    return _filtered(t.part, "p_name", "starts_with", "SMALL", ("p_partkey", "p_name", "p_type"))


@R.add("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE contains(CASE WHEN l_extendedprice = floor(l_extendedprice)
    THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) ELSE CAST(l_extendedprice AS VARCHAR) END, '99.5')""")
def view_number_contains(t: Tables) -> DataFrame:
    return _filtered(
        t.lineitem, "l_extendedprice", "contains", "99.5", ("l_orderkey", "l_linenumber", "l_extendedprice")
    )


@R.add("""SELECT o_orderkey, o_orderdate FROM orders
WHERE starts_with(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ'), '1997-05-28T00:00:00.000Z')""")
def view_date_starts_with(t: Tables) -> DataFrame:
    return _filtered(t.orders, "o_orderdate", "starts_with", "1997-05-28", ("o_orderkey", "o_orderdate"))


@R.add("SELECT o_orderkey, o_totalprice FROM orders WHERE false")
def view_range_on_text(t: Tables) -> DataFrame:
    return _filtered(t.orders, "o_orderpriority", "gt", "1", ("o_orderkey", "o_totalprice"))


@R.add("""SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_returnflag FROM lineitem
WHERE l_quantity >= 10 AND l_returnflag IN ('A', 'R') AND l_shipdate BETWEEN TIMESTAMP '1996-01-01'
  AND TIMESTAMP '1998-12-31' AND starts_with(lower(l_linestatus), 'f')""")
def view_conjunction(t: Tables) -> DataFrame:
    fields = ("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_returnflag")
    definition = Definition(
        "lines",
        fields=fields,
        filters=(
            FilterRule("l_quantity", "gte", required=True),
            FilterRule("l_returnflag", "in"),
            FilterRule("l_shipdate", "between"),
            FilterRule("l_linestatus", "starts_with"),
        ),
    )
    params = {
        "l_quantity": "10",
        "l_returnflag": "A,R",
        "l_shipdate": "1996-01-01,1998-12-31",
        "l_linestatus": "F",
    }
    v = view(t.lineitem, definition, params)
    return v.filtered.select(*v.projection)


@R.add("""SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders)
WHERE p IS DISTINCT FROM '1-URGENT'""")
def ne_null_cells(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return _filtered(rows, "p", "ne", "1-URGENT", ("o_orderkey", "p"))


_PRICE_VIEW = Definition(
    "orders-by-price",
    fields=ORDER_FIELDS,
    filters=(FilterRule("o_totalprice", "gte"), FilterRule("o_orderpriority", "starts_with")),
    sort=(SortRule("o_totalprice"), SortRule("o_orderpriority"), SortRule("p")),
)


def _ranked(page: DataFrame, keys: list, first: int) -> DataFrame:
    # A page holds at most max_limit rows, so numbering it is a bounded window.
    return page.withColumn("pos", (F.row_number().over(W.orderBy(*keys)) + first).cast("bigint"))


@R.add("""SELECT *, CAST(50 + row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS pos FROM (
  SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders
  WHERE o_totalprice >= 1000 AND starts_with(lower(o_orderpriority), '1-')
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50)""")
def view_sort_page(t: Tables) -> DataFrame:
    return _ranked(view_sorted(t), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50)


def view_sorted(t: Tables) -> DataFrame:
    params = {
        "o_totalprice": "1000",
        "o_orderpriority": "1-",
        "sort": "o_totalprice:desc",
        "page": "2",
        "limit": "50",
    }
    definition = Definition(
        "orders-by-price", _PRICE_VIEW.fields, _PRICE_VIEW.filters, _PRICE_VIEW.sort[:2]
    )
    return view(t.orders, definition, params, tie_break=["o_orderkey"]).page


@R.add("""SELECT *, CAST(row_number() OVER (ORDER BY p NULLS LAST, o_totalprice DESC, o_orderkey) AS BIGINT) AS pos FROM (
  SELECT o_orderkey, o_totalprice, nullif(nullif(o_orderpriority, '5-LOW'), '1-URGENT') AS p FROM orders
  ORDER BY p NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 500)""")
def view_multi_sort(t: Tables) -> DataFrame:
    keys = [F.asc_nulls_last("p"), F.desc("o_totalprice"), F.asc("o_orderkey")]
    return _ranked(_nullable_page(t, ["p", "o_totalprice:desc"]), keys, 0)


@R.add("""SELECT *, CAST(row_number() OVER (ORDER BY p DESC NULLS LAST, o_orderkey) AS BIGINT) AS pos FROM (
  SELECT o_orderkey, o_totalprice, nullif(nullif(o_orderpriority, '5-LOW'), '1-URGENT') AS p FROM orders
  ORDER BY p DESC NULLS LAST, o_orderkey LIMIT 500)""")
def view_nulls_last(t: Tables) -> DataFrame:
    return _ranked(_nullable_page(t, "p:desc"), [F.desc_nulls_last("p"), F.asc("o_orderkey")], 0)


def _nullable_page(t: Tables, sort) -> DataFrame:
    p = F.nullif(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("1-URGENT"))
    rows = t.orders.select("o_orderkey", "o_totalprice", p.alias("p"))
    definition = Definition("orders", sort=(SortRule("p"), SortRule("o_totalprice")))
    return view(rows, definition, {"sort": sort, "limit": "500"}, tie_break=["o_orderkey"]).page


@R.add("""SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority, CAST(o_orderkey - 100 AS BIGINT) AS pos FROM orders
ORDER BY o_orderkey LIMIT 50 OFFSET 100""")
def view_default_order(t: Tables) -> DataFrame:
    page = view(t.orders, Definition("orders", ORDER_FIELDS), {"page": "3"}, tie_break=["o_orderkey"]).page
    return page.withColumn("pos", F.col("o_orderkey") - 100)


@R.add("SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders WHERE false")
def view_past_end(t: Tables) -> DataFrame:
    # 10^9 pages of 500 rows lie past the end of every given table.
    params = {"page": "1000000000", "limit": "500"}
    return view(t.orders, Definition("orders", ORDER_FIELDS), params, tie_break=["o_orderkey"]).page


@R.add("""SELECT count(*) AS total, CAST(greatest(0, least(50, count(*) - 50)) AS BIGINT) AS count,
  CAST(2 AS BIGINT) AS page, CAST(50 AS BIGINT) AS "limit", CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages
FROM orders WHERE o_totalprice >= 1000 AND starts_with(lower(o_orderpriority), '1-')""")
def view_stats(t: Tables) -> DataFrame:
    params = {"o_totalprice": "1000", "o_orderpriority": "1-", "page": "2", "limit": "50"}
    definition = Definition("orders", ORDER_FIELDS, _PRICE_VIEW.filters)
    return view(t.orders, definition, params, tie_break=["o_orderkey"]).stats


@R.add("""SELECT CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS count, CAST(1 AS BIGINT) AS page,
  CAST(50 AS BIGINT) AS "limit", CAST(0 AS BIGINT) AS pages FROM orders WHERE o_totalprice < 0 HAVING count(*) = 0""")
def view_stats_empty(t: Tables) -> DataFrame:
    definition = Definition("orders", ORDER_FIELDS, (FilterRule("o_totalprice", "lt"),))
    return view(t.orders, definition, {"o_totalprice": "0"}, tie_break=["o_orderkey"]).stats


@R.add("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def view_default_projection(t: Tables) -> DataFrame:
    v = view(t.part, Definition("parts"), tie_break=["p_partkey"])
    return v.filtered.select(*v.projection)


@R.add("SELECT p_retailprice, p_name FROM part")
def view_requested_projection(t: Tables) -> DataFrame:
    v = view(t.part, Definition("parts"), {"fields": " p_retailprice , p_name,"}, tie_break=["p_partkey"])
    return v.filtered.select(*v.projection)


@R.add("SELECT p_partkey, p_name, CAST(NULL AS DOUBLE) AS discount FROM part")
def missing_column_null(t: Tables) -> DataFrame:
    columns = [Column("p_partkey", "number"), Column("p_name"), Column("discount", "number")]
    return project(t.part, columns)


@R.add("""SELECT s_suppkey AS k, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def versions_by_name(t: Tables) -> DataFrame:
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    new = t.customer.select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    return old.unionByName(new, allowMissingColumns=True)


@R.add("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100 OFFSET 5500""")
def view_deep_page(t: Tables) -> DataFrame:
    definition = Definition("lines", fields=("l_orderkey", "l_linenumber", "l_extendedprice"), sort=(SortRule("l_extendedprice"),))
    params = {"sort": "l_extendedprice:desc", "page": "56", "limit": "100"}
    return view(t.lineitem, definition, params, tie_break=["l_orderkey", "l_linenumber"]).deep_page()
