"""Large JSON files read in pieces, beside the reader that takes a payload whole."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gridpress.sources import jsonindex as X
from gridpress.sources import jsonrows as J
from gridpress.sources.jsonindex import array_rows


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def value(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    if kind == 0:
        return rng.choice([None, True, 1.5, -3, 10**12])
    if kind < 4:
        return "".join(rng.choice(['a,b', '"', "\\", "]", "}", "[{", ":", "é", " ", "\n", "\\u0041", "x"]) for _ in range(rng.randrange(5)))
    if kind == 4:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", "n,m", 'q"t', "]", "z"]) + str(i): value(rng, depth - 1) for i in range(rng.randrange(4))}


def plain(text, path):
    """Rows of a payload read whole: its elements, or its status."""
    data = json.loads(text)
    if path is None:
        if isinstance(data, dict):
            data = next((v for v in data.values() if isinstance(v, list)), [data])
    else:
        for segment in path.split("."):
            data = data[int(segment)] if isinstance(data, list) else data[segment]
    return data


def check(spark, folder, texts, path):
    for i, text in enumerate(texts):
        (folder / f"{i:03}.json").write_text(text)
    rows, rejects = array_rows(spark, str(folder), path)
    got: dict[int, list] = {}
    for r in rows.orderBy("_file", "_pos").collect():
        mine = got.setdefault(int(os.path.basename(r._file)[:3]), [])
        assert r._pos == len(mine)
        mine.append(json.loads(r._t))
    refused = {int(os.path.basename(r._file)[:3]): r.status for r in rejects.collect()}
    return got, refused


def test_shapes_equal_whole_payloads(spark, small_splits, tmp_path):
    rng = random.Random(2)
    texts = []
    for i in range(24):
        rows = [value(rng, 3) for _ in range(rng.randrange(1, 25))]
        indent = rng.choice([None, 1])
        if i % 3 == 0:
            data = rows
        elif i % 3 == 1:
            data = {"note, with": "[x", "o": {"a": [1]}, "items, all": rows, "more": [2]}
        else:
            data = {"note": "a,[b", "o": {"inner": [1, 2]}, "n": 3}
        texts.append(json.dumps(data, indent=indent, ensure_ascii=rng.random() < 0.5))
    got, refused = check(spark, tmp_path, texts, None)
    assert not refused and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    for i, text in enumerate(texts):
        assert got[i] == plain(text, None), i


@pytest.mark.parametrize("path", ["data.list", "data.list.1.deep", "0.rows"])
def test_paths_equal_whole_payloads(spark, small_splits, tmp_path, path):
    rng = random.Random(path)
    texts = []
    for _ in range(10):
        rows = [value(rng, 3) for _ in range(rng.randrange(1, 12))]
        data = {
            "data.list": {"x": value(rng, 3), "data": {"y": "list", "list": rows, "z": value(rng, 2)}, "list": [0]},
            "data.list.1.deep": {"data": {"list": [value(rng, 3), {"w": value(rng, 2), "deep": rows}, 5]}},
            "0.rows": [{"a": value(rng, 3), "rows": rows}, {"rows": [1]}],
        }[path]
        texts.append(json.dumps(data))
    got, refused = check(spark, tmp_path, texts, path)
    assert not refused
    for i, text in enumerate(texts):
        assert got[i] == plain(text, path), i


def test_refused_files_equal_whole_payloads(spark, tmp_path):
    texts = ["[]", " [ ] ", "3", '{"a":[]}', "[1,,2]", "[1,2", '[1,{"b":x}]', '"s,t"', "[1]", '{"p":{"q":[1,2]}}', '{"p":[1]}', '{"p":{"q":{}}}', '{"p":{"q":[]}}']
    got, refused = check(spark, tmp_path, texts, None)
    payloads = spark.createDataFrame(list(enumerate(texts)), "payload_id int, payload string")
    located = J.locate_rows(J.parse_payloads(payloads))
    want = {r.payload_id: r.status for r in located.select("payload_id", "status").where("status <> 'ok'").collect()}
    assert refused == want and set(got) == set(range(len(texts))) - set(want)
    for path in ("p.q", "p.0", "0"):
        got, refused = check(spark, tmp_path, texts, path)
        located = J.follow_path(J.parse_payloads(payloads), path)
        want = {r.payload_id: r.status for r in located.select("payload_id", F.col("status")).collect() if r.status != "ok"}
        # A file that breaks off is refused either way, for what is met first.
        broken = {5, 4, 6}
        assert {k: v for k, v in refused.items() if k not in broken} == {k: v for k, v in want.items() if k not in broken}, path
        assert broken <= set(refused)


def test_names_with_commas_are_refused_in_paths(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    with pytest.raises(ValueError):
        array_rows(spark, str(tmp_path), "a,b")


@pytest.mark.parametrize("path", [None, "data.list", "0.rows", "7"])
def test_short_stretches_equal_whole_payloads(spark, small_splits, tmp_path, monkeypatch, path):
    monkeypatch.setattr(X, "STRETCH_BITS", 2)
    rng = random.Random(str(path))
    texts = []
    for _ in range(6):
        rows = [value(rng, 3) for _ in range(rng.randrange(1, 40))]
        whole = {None: rows, "data.list": {"data": {"list": rows}}, "0.rows": [{"a": [1, {}], "rows": rows}], "7": [value(rng, 2) for _ in range(7)] + [rows, 1]}
        texts.append(json.dumps(whole[path]))
    got, refused = check(spark, tmp_path, texts, path)
    assert not refused
    for i, text in enumerate(texts):
        assert got[i] == plain(text, path), i


def test_no_task_takes_a_whole_file(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (tmp_path / "a.json").write_text(json.dumps(["x"] * 50))
        index = X.structural_index(spark, str(tmp_path))
        ends = X._ends(index, X._roots(index).drop("kind", "status"))
        members = X._members(index, X._roots(index).drop("kind", "status"))
        rows, _ = array_rows(spark, str(tmp_path))
        for frame in (ends, members, rows):
            assert "BroadcastHashJoin [_file#" in frame._jdf.queryExecution().executedPlan().toString()
        assert ends.count() == 1 and rows.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
