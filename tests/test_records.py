"""Delimited text with line breaks inside quotes, split over many tasks, beside the one-task reader."""

import random

import pytest

from gridpress.errors import UnprocessableContent
from gridpress.sources.delimited import read_delimited

BITS = ["a", "b,c", 'say ""hi""', "line\nbreak", "\n\n", ",", "é", "", "x\r\ny", '""', "1", ";"]


def cell(rng):
    text = "".join(rng.choice(BITS) for _ in range(rng.randrange(4)))
    return f'"{text}"' if any(c in text for c in ',";\n\r') or rng.random() < 0.2 else text


def one_task(spark, paths, width, header, sep=","):
    """Rows of Spark's reader that takes a file in one task."""
    schema = ", ".join([*[f"c{i} string" for i in range(width)], "_bad string"])
    out = []
    for path in paths:
        reader = spark.read.schema(schema).options(escape='"', header=header, multiLine=True, columnNameOfCorruptRecord="_bad", maxCharsPerColumn=-1, sep=sep)
        out += [tuple(r)[:width] for r in reader.csv(path).collect()]
    return out


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("sep", "end"), [(",", "\n"), (";", "\r\n")])
@pytest.mark.parametrize("header", [True, False])
def test_split_files_read_as_whole_ones(spark, small_splits, tmp_path, sep, end, header):
    rng = random.Random(f"{sep}{header}")
    paths = []
    for f in range(2):
        lines = [sep.join(["h1", "h2", "h3"])] if header else []
        lines += [sep.join(cell(rng) for _ in range(rng.choice([3, 3, 3, 2, 4]))) + rng.choice(["", "", end]) for _ in range(110)]
        path = tmp_path / f"f{f}.csv"
        path.write_bytes((end.join(lines) + end).encode())
        paths.append(str(path))
    assert spark.read.text(paths).rdd.getNumPartitions() > 8
    table = read_delimited(spark, paths, sep, has_header=header, multi_line=True)
    rows = [tuple(r) for r in table.rows.orderBy("_row").collect()]
    width = len(table.headers)
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert [r[1:] for r in rows] == one_task(spark, paths, width, header, sep)
    ragged = {r._row: r.detail for r in table.warnings.collect()}
    assert ragged and all(d.endswith(f"expected {width}") for d in ragged.values())


def test_one_record_over_many_splits(spark, small_splits, tmp_path):
    path = tmp_path / "long.csv"
    body = "\n".join(f'line {i} with ""quotes"", and commas' for i in range(150))
    path.write_text(f'k,v\n1,"{body}"\n2,x\n')
    rows = read_delimited(spark, str(path), multi_line=True).rows.orderBy("_row").collect()
    assert [(r.c0, r.c1) for r in rows] == [("1", body.replace('""', '"')), ("2", "x")]


def test_headers_of_files_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"k\nk",v\n1,2\n')
    (tmp_path / "b.csv").write_text('﻿"k\nk",v\n3,4\n')
    table = read_delimited(spark, str(tmp_path), multi_line=True)
    assert table.headers == ["k\nk", "v"] and [tuple(r) for r in table.rows.orderBy("_row").collect()] == [(0, "1", "2"), (1, "3", "4")]
    (tmp_path / "c.csv").write_text("other,v\n5,6\n")
    with pytest.raises(UnprocessableContent):
        read_delimited(spark, str(tmp_path), multi_line=True)


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n\n")
    with pytest.raises(UnprocessableContent):
        read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True)
    (tmp_path / "b.csv").write_text("\n\n")
    with pytest.raises(UnprocessableContent):
        read_delimited(spark, str(tmp_path / "b.csv"), multi_line=True)
