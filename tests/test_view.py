"""Views on a small dataset: every operator, ordering, paging, refusals."""

from datetime import datetime

import pytest

from gridpress import errors as E
from gridpress.model import Column, Definition, FilterRule, SortRule
from gridpress.operators import view as V

COLUMNS = [
    Column("code", "string"),
    Column("low", "number"),
    Column("rate", "number"),
    Column("note", "string"),
    Column("active", "boolean"),
    Column("since", "date"),
]
ROWS = [
    (0, "07", 0.0, 0.5, "Base 1.500,00 Peso", True, datetime(2025, 3, 1)),
    (1, "7", 40.0, 0.25, None, False, datetime(2025, 3, 1)),
    (2, "x9", None, 0.25, "above base", True, datetime(2025, 9, 1)),
    (3, "12", 100.0, 0.0, "top", False, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        ROWS, "_row bigint, code string, low double, rate double, note string, active boolean, since timestamp"
    )


def picked(rows, field, op, value, **params):
    definition = Definition("v", filters=(FilterRule(field, op),), sort=(SortRule("rate"), SortRule("low")))
    found = V.view(rows, definition, {field: value, **params}, COLUMNS)
    return [r["code"] for r in found.page.collect()]


@pytest.mark.parametrize(
    "field,op,value,codes",
    [
        ("code", "eq", "7", ["7"]),
        ("low", "eq", "40.0", ["7"]),
        ("low", "ne", "40", ["07", "x9", "12"]),
        ("note", "ne", "top", ["07", "7", "x9"]),
        ("low", "gt", "40", ["12"]),
        ("low", "gte", "40", ["7", "12"]),
        ("low", "lt", "40", ["07"]),
        ("low", "lte", "40", ["07", "7"]),
        ("since", "gt", "2025-03-01", ["x9"]),
        ("since", "eq", "2025-03-01T00:00:00Z", ["07", "7"]),
        ("code", "in", " 7 , 12,", ["7", "12"]),
        ("low", "between", "0,40", ["07", "7"]),
        ("low", "between", "40,0", []),
        ("note", "contains", "BASE", ["07", "x9"]),
        ("note", "starts_with", "base", ["07"]),
        ("low", "contains", "00", ["07", "7", "12"]),
        ("low", "contains", "100", ["12"]),
        ("active", "eq", "1", ["07", "x9"]),
        ("active", "contains", "1", ["07", "x9"]),
        ("since", "contains", "2025-09-01", ["x9"]),
        ("code", "gt", "0", []),
        ("active", "gt", "0", []),
    ],
)
def test_operators(rows, field, op, value, codes):
    assert picked(rows, field, op, value) == codes


def test_sort_keeps_nulls_last_and_ties_in_order(rows):
    assert picked(rows, "note", "ne", "z", sort="rate") == ["12", "7", "x9", "07"]
    assert picked(rows, "note", "ne", "z", sort="low:desc") == ["12", "7", "07", "x9"]
    assert picked(rows, "note", "ne", "z", sort=["rate:desc", "low:asc"]) == ["07", "7", "x9", "12"]
    assert picked(rows, "note", "ne", "z") == ["07", "7", "x9", "12"]


def test_pages_join_up_to_the_sorted_rows(rows):
    definition = Definition("v", fields=("code",), sort=(SortRule("rate"),))
    codes = []
    for page in range(1, 4):
        found = V.view(rows, definition, {"sort": "rate", "page": page, "limit": 2}, COLUMNS)
        codes += [r["code"] for r in found.page.collect()]
        stats = found.stats.first()
        assert (stats["total"], stats["pages"], stats["count"]) == (4, 2, 2 if page < 3 else 0)
    assert codes == [r["code"] for r in found.ordered.collect()] == ["12", "7", "x9", "07"]


def test_deep_pages_agree_with_shallow_ones(spark, rows):
    df = spark.range(5000).selectExpr("id AS _row", "id * 7919 % 13 AS k", "nullif(id % 5, 0) AS n")
    definition = Definition("v", sort=(SortRule("k"), SortRule("n")))
    params = {"sort": ["k:desc", "n"], "limit": "100"}
    for page in ("1", "17", "50", "51"):
        asked = V.view(df, definition, {**params, "page": page})
        assert asked.deep_page().collect() == asked.page.collect()


def test_pages_beyond_32_bit_offsets_are_empty(spark):
    df = spark.range(50).withColumnRenamed("id", "_row").selectExpr("_row", "_row % 3 AS k")
    asked = V.view(df, Definition("v", sort=(SortRule("k"),)), {"sort": "k", "page": "1000000000", "limit": "500"})
    assert asked.page.columns == ["k"] and asked.page.collect() == []
    assert asked.stats.first().asDict() == {"total": 50, "count": 0, "page": 10**9, "limit": 500, "pages": 1}


@pytest.mark.parametrize(
    ("column", "kind", "values"),
    [
        ("id", "number", [str(i) for i in range(0, 3000, 3)] + ["1.5", "7.0"]),
        ("half", "number", [f"{i / 2}" for i in range(0, 3000, 7)]),
        ("name", "string", [f"n{i}" for i in range(0, 3000, 5)]),
        ("day", "date", [f"20{i // 336:02}-{i // 28 % 12 + 1:02}-{i % 28 + 1:02}" for i in range(0, 2600, 3)]),
    ],
)
def test_long_lists_equal_short_ones(spark, monkeypatch, column, kind, values):
    df = spark.range(3000).selectExpr("id AS _row", "nullif(id, 6) AS id", "id / 2D AS half", "concat('n', id) AS name", "timestamp_millis(86400000 * (10957 + id)) AS day")
    columns = [Column(c, k) for c, k in (("id", "number"), ("half", "number"), ("name", "string"), ("day", "date"))]
    asked = lambda: V.view(df, Definition("v", filters=(FilterRule(column, "in"),)), {column: ",".join(values)}, columns).filtered
    monkeypatch.setattr(V, "INLINE_VALUES", 10**6)
    short = asked()
    monkeypatch.setattr(V, "INLINE_VALUES", 10)
    long = asked()
    assert sorted(long.collect()) == sorted(short.collect()) and long.count() > 100
    assert len(long._jdf.queryExecution().analyzed().toString()) < 3000


def test_projection(rows):
    definition = Definition("v", fields=("note", "code"))
    assert V.view(rows, definition, {}, COLUMNS).page.columns == ["note", "code"]
    assert V.view(rows, definition, {"fields": "code"}, COLUMNS).page.columns == ["code"]
    assert V.view(rows, Definition("v"), {}, COLUMNS).page.columns == [c.key for c in COLUMNS]


RULES = Definition(
    "v",
    fields=("code", "low"),
    filters=(FilterRule("low", "between"), FilterRule("since", "gte"), FilterRule("active", "eq"), FilterRule("code", "in")),
    sort=(SortRule("rate"),),
)


@pytest.mark.parametrize(
    "params,error",
    [
        ({"rate": "1"}, E.FilterNotAllowed),
        ({"other": "1"}, E.FilterNotAllowed),
        ({"fields": "rate"}, E.FilterNotAllowed),
        ({"page": "0"}, E.InvalidPagination),
        ({"page": "1.5"}, E.InvalidPagination),
        ({"limit": "501"}, E.InvalidPagination),
        ({"limit": ""}, E.InvalidPagination),
        ({"sort": "low"}, E.SortNotAllowed),
        ({"sort": "rate:up"}, E.SortNotAllowed),
        ({"low": "1"}, E.ValueCastError),
        ({"low": "1,x"}, E.ValueCastError),
        ({"since": "2025"}, E.ValueCastError),
        ({"since": "2025-02-31"}, E.ValueCastError),
        ({"active": "yes"}, E.ValueCastError),
        ({"code": " , "}, E.ValueCastError),
        ({"page": "x", "sort": "low", "low": "q"}, E.InvalidPagination),
    ],
)
def test_refusals(params, error):
    with pytest.raises(error):
        V.parse_request(params, RULES, COLUMNS)


def test_required_and_vanished_columns():
    with pytest.raises(E.FilterNotAllowed):
        V.parse_request({}, Definition("v", filters=(FilterRule("low", "eq", True),)), COLUMNS)
    for broken in (
        Definition("v", fields=("gone",)),
        Definition("v", filters=(FilterRule("gone", "eq"),)),
        Definition("v", sort=(SortRule("gone"),)),
    ):
        with pytest.raises(E.SchemaMismatch):
            V.parse_request({}, broken, COLUMNS)


def test_literals():
    assert V.cast_literal(" 1e3 ", "number", "p") == 1000.0
    assert V.cast_literal("0x10", "number", "p") == 16.0
    for bad in ("", "Infinity", "1,5", "1_0", "abc"):
        with pytest.raises(E.ValueCastError):
            V.cast_literal(bad, "number", "p")
    assert V.cast_literal("2025-01-02T03:00:00-03:00", "date", "p").hour == 6


def test_filters_and_columns_reach_the_scan(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    rows.write.parquet(path)
    definition = Definition("v", fields=("code",), filters=(FilterRule("low", "gte"), FilterRule("since", "lt")))
    found = V.view(spark.read.parquet(path), definition, {"low": "10", "since": "2026-01-01"}, COLUMNS)
    plan = found.page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(low,10.0)" in plan and "LessThan(since" in plan
    assert "TakeOrderedAndProject" in plan and "note" not in plan.split("ReadSchema")[1]
