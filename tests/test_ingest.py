"""Readers, the store, and ingest to serve, end to end."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridpress import errors as E
from gridpress.operators.normalize import normalize_table
from gridpress.plans.ingest import ingest, ingest_api, register
from gridpress.plans.serve import serve
from gridpress.plans.store import Store
from gridpress.sources import jsonrows as J
from gridpress.sources.delimited import normalize_delimited, read_delimited
from gridpress.sources.landing import archive, manifest, read_payloads


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def cells(rows):
    return [tuple(r) for r in rows.orderBy("_row").collect()]


def test_ragged_csv_with_bom_and_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", '﻿Clave,Texto,Precio\nA,"uno, dos","1.200,50"\n\nB\nC,"dijo ""hola""",3,extra\n')
    raw = read_delimited(spark, path)
    assert raw.headers == ["Clave", "Texto", "Precio"]
    assert cells(raw.rows) == [(0, "A", "uno, dos", "1.200,50"), (1, "B", None, None), (2, "C", 'dijo "hola"', "3")]
    out = normalize_delimited(raw, "manual")
    assert [c.type for c in out.columns] == ["string", "string", "number"]
    assert [r["detail"] for r in out.warnings.orderBy("_row").collect()] == [
        "row 2 had 1 cells, expected 3",
        "row 3 had 4 cells, expected 3",
    ]


def test_headerless_and_other_delimiters(spark, tmp_path):
    path = write(tmp_path / "b.csv", "1;2\n3;4;5\n")
    raw = read_delimited(spark, path, ";", has_header=False)
    assert raw.headers == ["col_1", "col_2", "col_3"]
    assert cells(raw.rows) == [(0, "1", "2", None), (1, "3", "4", "5")]
    for text in ("", "a,b\n"):
        with pytest.raises(E.UnprocessableContent):
            read_delimited(spark, write(tmp_path / "c.csv", text))


def test_row_positions_follow_files_and_splits(spark, tmp_path):
    for name in ("x", "y"):
        write(tmp_path / f"{name}.csv", "k,v\n" + "".join(f"{name}{i},{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = read_delimited(spark, str(tmp_path))
        got = [r["c0"] for r in raw.rows.orderBy("_row").collect()]
        assert raw.rows.agg(F.min("_row"), F.max("_row"), F.countDistinct("_row")).first() == (0, 5999, 6000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{n}{i}" for n in ("x", "y") for i in range(3000)]


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'a,b\n"one\ntwo",2\n')
    assert cells(read_delimited(spark, path, multi_line=True).rows) == [(0, "one\ntwo", "2")]


PAYLOADS = [
    ("p1", '[{"b":1,"a":{"y":"2,5","x":null}},{"b":2,"t":["q",1]}]'),
    ("p2", '{"note":"[z","items":[{"b":3},5]}'),
    ("p3", '{"b":4,"a":{"z":{"w":true}}}'),
    ("p4", "nope"),
    ("p5", "[]"),
    ("p6", '"text"'),
]


def test_json_shapes(spark):
    df = spark.createDataFrame(PAYLOADS, "payload_id string, payload string")
    found = J.read_json(df, "manual")
    assert {(r[0], r[1]) for r in found.rejects.collect()} == {("p4", "invalid-json"), ("p5", "no-rows"), ("p6", "not-rows")}
    assert [(c.key, c.type) for c in found.table.columns] == [
        ("b", "number"), ("a_y", "number"), ("a_x", "string"), ("t", "json"), ("col_1", "number"), ("a_z_w", "boolean")
    ]
    assert cells(found.table.rows) == [
        (0, 1.0, 2.5, None, None, None, None),
        (1, 2.0, None, None, '["q",1]', None, None),
        (2, 3.0, None, None, None, None, None),
        (3, None, None, None, None, 5.0, None),
        (4, 4.0, None, None, None, None, True),
    ]


def test_json_numbers_stay_numbers_unless_asked(spark):
    df = spark.createDataFrame([("p", '[{"n":1.234},{"n":-5}]')], "payload_id string, payload string")
    rows = J.flatten_rows(J.explode_rows(J.locate_rows(J.parse_payloads(df)), ["payload_id"])).withColumn("_row", F.col("_pos"))
    assert J.normalize_json(rows, "api").columns[0].type == "number"
    assert J.normalize_json(rows, "api", json_number_text=True).columns[0].type == "string"


@pytest.mark.parametrize(
    "path,status",
    [
        ("data.1.rows", "ok"), ("data.0.rows", "no-rows"), ("data.2", "index-out-of-range"), ("data.-1", "index-out-of-range"),
        ("data.x", "missing-key"), ("gone", "missing-key"), ("state.x", "not-an-object"), ("state", "not-an-array"),
        ("__proto__", "missing-key"), ("by.0.rows", "ok"), ("", "not-an-array"), ("data", "ok"),
    ],
)
def test_json_path(spark, path, status):
    body = {"state": "ok", "data": [{"rows": []}, {"rows": [{"a": 1}]}], "by": {"0": {"rows": [1]}}}
    df = spark.createDataFrame([("p", json.dumps(body))], "payload_id string, payload string")
    assert J.follow_path(J.parse_payloads(df), path).first()["status"] == status


@pytest.mark.parametrize("depth", [1, 8, 12, 30])
def test_rows_of_any_depth_are_kept(spark, depth):
    text = '[{"a":' + '{"b":' * depth + "1" + "}" * depth + ',"w":"{{{{{{{{{{{{"},{"a":2}]'
    df = spark.createDataFrame([("p", text)], "payload_id string, payload string")
    found = J.read_json(df, "api")
    assert found.rejects.count() == 0
    assert [c.key for c in found.table.columns] == ["a" + "_b" * depth, "w", "a"]
    assert found.table.rows.count() == 2


def test_last_of_repeated_members_counts(spark):
    df = spark.createDataFrame([("p", '[{"a":1,"a":7}]')], "payload_id string, payload string")
    found = J.read_json(df, "api")
    assert found.rejects.count() == 0
    assert [r["a"] for r in found.table.rows.collect()] == [7]


def test_manifest_and_size_limit(spark, tmp_path):
    write(tmp_path / "small.json", "[1]")
    write(tmp_path / "big.json", "[" + "1," * 500 + "1]")
    assert sorted(r["bytes"] for r in manifest(spark, str(tmp_path)).collect()) == [3, 1003]
    assert [r["payload"] for r in read_payloads(spark, str(tmp_path), 100).collect()] == ["[1]"]
    assert archive(spark, str(tmp_path), str(tmp_path / "kept"), "s1", "t1")
    assert spark.read.parquet(str(tmp_path / "kept")).where("source_id = 's1'").count() == 2
    assert not archive(spark, str(tmp_path / "missing"), str(tmp_path / "kept"), "s1", "t2")


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "catalog"))


CSV = 'Código,Nombre Largo,Precio\nA1,"Uno, dos","1.500,50"\nA2,Tres,"20,25"\nA3,cuatro,-\n'


def test_ingest_publish_serve(spark, store):
    register(store, "s1", "Precios", "manual", {"format": "csv", "payload": CSV})
    first = ingest(store, "s1")
    assert (first.version, first.row_count, first.columns_count) == (1, 3, 3)
    assert store.sources().first()["status"] == "ready"
    store.append(
        "definitions",
        ("d1", "precios", "Precios", "s1", None, True, ["codigo", "precio"], [("precio", "gte", False)], [("precio", "asc")], 50, 500, True),
        ("d2", "fijo", "Fijo", "s1", first.dataset_id, False, None, [], [], 2, 500, True),
    )
    with pytest.raises(E.DatasetUnresolved):
        serve(store, "precios")
    with pytest.raises(E.DatasetNotPublished):
        serve(store, "fijo")
    store.publish(first.dataset_id)
    with pytest.raises(E.InvalidState):
        store.publish(first.dataset_id)
    served = serve(store, "precios", {"precio": "1", "sort": "precio:desc"})
    assert [tuple(r) for r in served.page.collect()] == [("A1", 1500.5), ("A2", 20.25)]
    assert served.stats.first()["total"] == 2 and len(served.etag) == 32

    second = ingest(store, "s1")
    assert second.version == 2 and store.read_version("s1", 1).count() == 3
    store.publish(second.dataset_id)
    assert serve(store, "precios").version == 2 and serve(store, "fijo").version == 1
    store.archive(first.dataset_id)
    with pytest.raises(E.DatasetNotPublished):
        serve(store, "fijo")

    head, truncated = store.preview(second.dataset_id, 2)
    assert [r["codigo"] for r in head.collect()] == ["A1", "A2"] and truncated
    assert [c.label for c in store.columns(second.dataset_id)] == ["Código", "Nombre Largo", "Precio"]
    assert store.remove_source("s1") == 2
    with pytest.raises(E.NotFound):
        serve(store, "precios")
    with pytest.raises(E.InvalidState):
        ingest(store, "s1")


def test_failed_ingests_store_nothing(spark, store):
    register(store, "s2", "Uno", "manual", {"format": "json", "payload": "[1,2,3]"})
    with pytest.raises(E.RowsLimitExceeded):
        ingest(store, "s2", max_rows=2)
    assert store.datasets().count() == 0 and store.sources().first()["status"] == "error"
    assert ingest(store, "s2", max_rows=None).row_count == 3
    table = normalize_source(store)
    with pytest.raises(E.VersionConflict):
        store.write_version("s2", "Uno", table, version=1)
    with pytest.raises(E.SourceConfigInvalid):
        register(store, "s3", "x", "manual", {"format": "xml", "payload": "x"})


def normalize_source(store):
    df = store.spark.createDataFrame([("p", "[7]")], "payload_id string, payload string")
    return J.read_json(df, "manual").table


def test_landed_sources(spark, store, tmp_path):
    api = write(tmp_path / "a.json", '{"data":[{"k":1,"o":{"p":"x"}}]}')
    register(store, "a", "A", "api", {"url": "https://h.example.com/a", "method": "GET", "jsonPath": "data", "landed": api})
    assert ingest(store, "a").columns_count == 2
    tsv = write(tmp_path / "b.tsv", "k\tv\nx\t1,5\n")
    register(store, "b", "B", "url", {"url": "https://h.example.com/b.tsv?x=1", "landed": tsv})
    assert ingest(store, "b").columns_count == 2
    register(store, "c", "C", "url", {"url": "https://h.example.com/c", "landed": tsv})
    with pytest.raises(E.UnsupportedMediaType):
        ingest(store, "c")


def test_a_broken_write_is_not_in_the_way(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    register(store, "s1", "S", "manual", {"format": "csv", "payload": "a,b\n1,2\n"})
    append = Store.append
    for step in ("columns", "ingest_runs", "datasets"):
        def broken(self, name, *records, at=step):
            if name == at:
                raise OSError("lost")
            append(self, name, *records)

        monkeypatch.setattr(Store, "append", broken)
        with pytest.raises(OSError):
            ingest(store, "s1")
        monkeypatch.undo()
    version = ingest(store, "s1", max_bytes=None)
    assert version.version == 1 and store.read_version("s1", 1).count() == 1
    assert [c.key for c in store.columns(version.dataset_id)] == ["a", "b"]
    with pytest.raises(E.PayloadTooLarge):
        ingest(store, "s1", max_bytes=3)


def test_definition_writes_fold(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create_definition("d1", "prices", source_id="s1", fields=["a"])
    store.update_definition("d1", fields=["a", "b"], enabled=False)
    (only,) = store.definitions().collect()
    assert only["fields"] == ["a", "b"] and not only["enabled"] and only["slug"] == "prices"
    with pytest.raises(E.InvalidState):
        store.create_definition("d2", "prices")
    with pytest.raises(E.InvalidState):
        store.update_definition("d1", slug="other")
    store.remove_definition("d1")
    assert store.definitions().count() == 0
    store.create_definition("d2", "prices")
    assert store.definitions().count() == 1


def test_definitions_are_checked_when_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "catalog"))
    for fields, error in (
        ({"slug": "No Good"}, "SLUG_INVALID"),
        ({"slug": "prices", "default_limit": 900, "max_limit": 100}, "LIMITS_INVALID"),
        ({"slug": "prices", "follow_latest": False}, "DATASET_REQUIRED"),
        ({"slug": "prices", "source_id": "s1", "dataset_id": "none"}, "DATASET_NOT_FOUND"),
    ):
        with pytest.raises(E.UnprocessableContent) as refused:
            store.create_definition("d1", **fields)
        assert refused.value.details["error"] == error
    store.create_definition("d1", "prices", source_id="s1")
    with pytest.raises(E.UnprocessableContent):
        store.update_definition("d1", default_limit=0)
    store.remove_definition("d1")


def test_large_json_files_are_ingested_like_small_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": {"list": [{"k": "a,b", "n": {"x": 1}}, {"k": "c"}]}}')
    (tmp_path / "b.json").write_text('{"data": {"list": [{"k": "d", "n": {"x": 2}}]}}')
    config = {"landed": str(tmp_path), "url": "http://h/", "jsonPath": "data.list"}
    small, _ = ingest_api(spark, config)
    large, _ = ingest_api(spark, config, max_bytes=None)
    assert [c.key for c in large.columns] == [c.key for c in small.columns]
    assert large.rows.orderBy("_row").collect() == small.rows.orderBy("_row").collect()
    (tmp_path / "c.json").write_text('{"data": {"list": []}}')
    with pytest.raises(E.UnprocessableContent):
        ingest_api(spark, config, max_bytes=None)


def test_a_guarded_write_reads_its_source_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "catalog"))
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        met.add(1)
        return text

    table = normalize_table(spark.range(40).selectExpr("id AS _row", "concat('v', id) AS c"), ["c"], [F.col("c")])
    counted = replace(table, rows=table.rows.withColumn("c", seen("c")))
    version = store.write_version("s1", "one", counted, max_rows=40)
    assert (version.row_count, met.value) == (40, 40)
    with pytest.raises(E.RowsLimitExceeded):
        store.write_version("s1", "one", counted, max_rows=39)
    assert met.value == 80 and store.next_version("s1") == 2
    assert not list((tmp_path / "catalog/rows/source_id=s1/version=2").rglob("*.parquet"))


def test_one_of_two_writers_has_the_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "catalog"))
    store._claim("s1", 1)
    with pytest.raises(E.VersionConflict):
        store._claim("s1", 1)
    table = normalize_table(spark.range(3).selectExpr("id AS _row", "concat('v', id) AS c"), ["c"], [F.col("c")])
    with pytest.raises(E.VersionConflict):
        store.write_version("s1", "one", table, version=1)
    assert store.write_version("s1", "one", table).version == 2
