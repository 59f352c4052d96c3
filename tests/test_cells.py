"""Cells, headers and whole-table normalisation."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridpress.functions import cells as X
from gridpress.functions import numbers as N
from gridpress.functions import text as T
from gridpress.functions.display import bytes_display, duration_display, number_display
from gridpress.operators.normalize import normalize_table, ordered_warnings, positional_cells

NUMBERS = [
    ("1.876,25", 1876.25, False),
    ("14,5", 14.5, False),
    ("3.210.987,65", 3210987.65, False),
    ("2,345.67", 2345.67, False),
    ("6,789", 6789.0, False),
    ("6,789,012", 6789012.0, False),
    ("6.789", None, True),
    ("8.5", 8.5, False),
    ("8.50", 8.5, False),
    ("$ 9.000", None, True),
    ("$ 9.000,50", 9000.5, False),
    ("-3.456,7", -3456.7, False),
    ("(3.456,7)", -3456.7, False),
    ("+12", 12.0, False),
    ("hola", None, False),
    ("4.5.6", None, True),
    ("12345,678", 12345678.0, False),
    (",678", None, True),
    (",67", 0.67, False),
    (".678", 0.678, False),
    ("5.", 5.0, False),
    (".", None, False),
    ("1.2345", 1.2345, False),
    ("1,2345", None, True),
    ("1.234,5678", None, True),
    ("1234.567,8", None, True),
    ("1 234 567", 1234567.0, False),
    ("€12,50", 12.5, False),
    ("(-5)", None, False),
    ("(5", None, False),
    ("-", None, False),
    ("", None, False),
    ("9" * 400, None, False),
]


def test_numbers(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in NUMBERS], "t string")
    got = [(r["t"], r["p"]["value"], r["p"]["ambiguous"]) for r in df.select("t", N.parse_number(F.col("t")).alias("p")).collect()]
    assert got == NUMBERS


UTC = datetime.datetime
CELLS = [
    ("  ", "null", None),
    (" N/A ", "null", None),
    ("Sin  Dato", "null", None),
    ("–", "null", None),
    ("0", "number", 0.0),
    ("0,00", "number", 0.0),
    ("45%", "number", 0.45),
    ("12,5%", "number", 0.125),
    ("-7%", "number", -0.07),
    ("%", "string", "%"),
    ("45 %", "string", "45 %"),
    ("SÍ", "boolean", True),
    ("falso", "boolean", False),
    ("No aplica", "string", "No aplica"),
    ("2025-08-09", "date", UTC(2025, 8, 9)),
    ("2025-08-09 10:11", "date", UTC(2025, 8, 9, 10, 11)),
    ("2025-08-09T10:11:12.3456Z", "date", UTC(2025, 8, 9, 10, 11, 12, 345000)),
    ("2025-08-09T10:11:12-0300", "date", UTC(2025, 8, 9, 13, 11, 12)),
    ("2025-02-31", "string", "2025-02-31"),
    ("09/08/2025", "string", "09/08/2025"),
    ("  a   b\t", "string", "a b"),
    ("$ 1.500,25", "number", 1500.25),
    ("(20)", "number", -20.0),
    ("1 234", "string", "1 234"),
]


def test_cells(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in CELLS], "raw string")
    got = []
    for r in X.read_cells(df, "raw").collect():
        c = r["cell"]
        value = {"number": c["n"], "boolean": c["b"], "date": c["t"], "string": c["s"], "null": None}[c["kind"]]
        got.append((r["raw"], c["kind"], value))
    assert got == CELLS


def test_strict_gate_leaves_signs_and_currency_as_text(spark):
    df = spark.createDataFrame([("-5",), ("$ 5",), ("(5)",), ("5",), ("5%",)], "raw string")
    kinds = [r["cell"]["kind"] for r in X.read_cells(df, "raw", strict_gate=True).collect()]
    assert kinds == ["string", "string", "string", "number", "number"]


def test_bulk_header_keys_fold_every_character(spark):
    chars = [chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c < 0xE000]
    headers = [f"x{c}Y{c}" for c in chars] + ["½ ﬁn Ⅻ", "ｆｕｌｌ－ｗｉｄｔｈ", "㎏/㎡", "①②", "…"]
    rows = spark.createDataFrame(list(enumerate(headers)), "i int, h string").repartition(8)
    got = {r.i: r.key for r in rows.select("i", T.header_key_expr(F.col("h"), F.col("i")).alias("key")).collect()}
    wrong = [(h, got[i], T.header_key(h, i)) for i, h in enumerate(headers) if got[i] != T.header_key(h, i)]
    assert not wrong, (len(wrong), wrong[:5])


def test_header_keys(spark):
    headers = ["Precio Final ($)", "Código %", "  --Suma---Total--  ", "ok", "", "***", "2030", "2do Año", "½ kg"]
    expected = ["precio_final", "codigo", "suma_total", "ok", "col_5", "col_6", "col_2030", "col_2do_ano", "col_1_2_kg"]
    assert T.header_keys(headers) == expected
    assert T.header_keys(["Neto", "Neto", "Neto 2", "neto"]) == ["neto", "neto_2", "neto_2_2", "neto_3"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(headers[:8])], "i int, h string").orderBy("i")
    bulk = [r[0] for r in df.select(T.header_key_expr(F.col("h"), F.col("i"))).collect()]
    assert bulk == expected[:8]
    keys = spark.createDataFrame([(["a", "a", "a_2", "a", "b"],)], "k array<string>")
    assert keys.select(T.unique_keys_expr(F.col("k"))).first()[0] == T.unique_keys(["a", "a", "a_2", "a", "b"])


def test_slug(spark):
    df = spark.createDataFrame([("Tabla Única 3ª",), (" --x-- ",), ("é" * 90,)], "n string")
    assert [r[0] for r in df.select(T.slugify(F.col("n"))).collect()] == ["tabla-unica-3a", "x", "e" * 80]


def table(spark, headers, rows, **options):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "_row bigint, cells array<string>")
    return normalize_table(df, headers, positional_cells("cells", len(headers)), **options)


def test_table(spark):
    out = table(
        spark,
        ["Clave", "Precio", "Activo", "Desde", "Extra"],
        [["B1", "2.345,50", "true", "2025-01-01"], ["B2", "10,255", "no", "-"], ["B3", "-1%", "si", "2025-01-02", "x"]],
        source="manual",
    )
    assert [(c.key, c.type, c.nullable, c.decimal_scale, c.percent) for c in out.columns] == [
        ("clave", "string", False, None, False),
        ("precio", "number", False, 2, True),
        ("activo", "boolean", False, None, False),
        ("desde", "date", True, None, False),
        ("extra", "string", True, None, False),
    ]
    rows = [tuple(r) for r in out.rows.orderBy("_row").collect()]
    assert rows[1] == (1, "B2", 10255.0, False, None, None)
    assert rows[2] == (2, "B3", -0.01, True, UTC(2025, 1, 2), "x")
    assert out.warnings.count() == 0
    assert out.rows.schema["precio"].metadata["decimal_scale"] == 2


def test_mixed_and_ambiguous_columns_fall_back_to_text(spark):
    out = table(spark, ["Monto", "Nota"], [["3.000", "No"], ['4."0', "otra"], ["5.000", None]])
    assert [c.type for c in out.columns] == ["string", "string"]
    assert [r["nota"] for r in out.rows.orderBy("_row").collect()] == ["No", "otra", None]
    details = [(r["_row"], r["detail"]) for r in ordered_warnings(out.warnings).collect()]
    assert details == [
        (0, "column 'monto': ambiguous-number \"3.000\""),
        (2, "column 'monto': ambiguous-number \"5.000\""),
        (None, "mixed-types column 'nota': boolean, string -> string"),
    ]


def test_json_columns_keep_their_text(spark):
    out = table(spark, ["Tags"], [['["a"]'], [None], ["[]"]], json_keys=frozenset({"tags"}))
    assert (out.columns[0].type, out.columns[0].nullable) == ("json", True)
    assert [r["tags"] for r in out.rows.orderBy("_row").collect()] == ['["a"]', None, "[]"]


def test_normalising_typed_text_again_changes_nothing(spark):
    first = table(spark, ["A", "B"], [["1,5", "x"], ["2,25", "y z"]])
    again = first.rows.select("_row", F.array(N.number_text(F.col("a")), "b").alias("cells"))
    second = normalize_table(again, ["a", "b"], positional_cells("cells", 2))
    assert second.rows.orderBy("_row").collect() == first.rows.orderBy("_row").collect()


def test_hundreds_of_columns(spark):
    out = table(spark, [f"h{i}" for i in range(300)], [[str(i) for i in range(300)], ["x"] * 300])
    assert len(out.columns) == 300 and {c.type for c in out.columns} == {"string"}
    assert out.rows.count() == 2


@pytest.mark.parametrize(
    "value,scale,text",
    [
        (65432.19, 2, "65.432,19"),
        (65432.19, 0, "65.432"),
        (65432.19, 3, "65.432,190"),
        (0.125, 2, "0,13"),
        (1.005, 2, "1,01"),
        (-2.5, 2, "-2,50"),
        (0.35, 4, "35 %"),
        (0.1234, 4, "12,34 %"),
        (0.225, 4, "22,5 %"),
        (0.0, 4, "0 %"),
        (1.0, None, "1,00"),
        (float("nan"), 2, "—"),
        (float("inf"), 2, "—"),
        (1e12, 2, "1.000.000.000.000,00"),
    ],
)
def test_number_display(spark, value, scale, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(number_display(F.col("v"), scale)).first()[0] == text


def test_sizes_and_durations(spark):
    df = spark.createDataFrame([(1000.0,), (4096.0,), (7.0 * 1024**2,), (3.0 * 1024**4,), (None,)], "v double")
    assert [r[0] for r in df.select(bytes_display(F.col("v"))).collect()] == ["1000 B", "4,0 kB", "7,0 MB", "3072,0 GB", "—"]
    ms = spark.createDataFrame([(640,), (2360,), (1450,), (1250,), (75_000,), (119_600,)], "v int")
    assert [r[0] for r in ms.select(duration_display(F.col("v"))).collect()] == [
        "640 ms", "2,4 s", "1,4 s", "1,3 s", "1 min 15 s", "1 min 60 s"
    ]
