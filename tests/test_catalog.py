"""Lifecycle folds, ordered helpers and request audit against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gridpress import errors as E
from gridpress.model import Column, Definition, FilterRule, SortRule
from gridpress.operators.intervals import merge_intervals
from gridpress.operators.ordered import chunked_lag, chunked_rank
from gridpress.operators.view import parse_request
from gridpress.plans import audit as A
from gridpress.plans import definitions as D
from gridpress.plans import lifecycle as L
from gridpress.plans.source_config import config_checks


def hot_groups(seed, kinds, n=400):
    """Events where one entity holds half of the log."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"e{rng.randrange(20)}", i, rng.choice(kinds)) for i in range(n)]


@pytest.mark.parametrize("step", [1, 7, 1_000_000_007])
def test_chunked_rank_and_lag(spark, step):
    rows = [(k, i * step, v) for k, i, v in hot_groups(step % 100, ["a", "b"])]
    df = spark.createDataFrame(rows, "k string, seq bigint, v string")
    ranks, down, lags, seen = {}, {}, {}, {}
    for k, seq, v in rows:
        mine = seen.setdefault(k, [])
        ranks[k, seq] = len(mine) + 1
        lags[k, seq] = mine[-1] if mine else None
        mine.append(v)
    for (k, seq), r in ranks.items():
        down[k, seq] = len(seen[k]) - r + 1
    got = {(r["k"], r["seq"]): r["at"] for r in chunked_rank(df, ["k"], "seq", "at").collect()}
    assert got == ranks
    got = {(r["k"], r["seq"]): r["at"] for r in chunked_rank(df, ["k"], "seq", "at", True).collect()}
    assert got == down
    got = {(r["k"], r["seq"]): r["p"] for r in chunked_lag(df, ["k"], "seq", "v", "p").collect()}
    assert got == lags


def test_dataset_fold(spark):
    events = hot_groups(3, [L.PUBLISH, L.ARCHIVE])
    status, illegal = {}, set()
    for k, seq, event in events:
        now = status.setdefault(k, "draft")
        if (now, event) == ("draft", L.PUBLISH):
            status[k] = "published"
        elif (now, event) == ("published", L.ARCHIVE):
            status[k] = "archived"
        else:
            illegal.add((k, seq, event, now))
    df = spark.createDataFrame(events, "entity_id string, seq bigint, event string")
    assert {(r["entity_id"], r["status"]) for r in L.dataset_states(df).collect()} == set(status.items())
    assert {tuple(r) for r in L.illegal_transitions(df).collect()} == illegal


@pytest.mark.parametrize("seed", range(4))
def test_source_fold(spark, seed):
    kinds = [L.START, L.START, L.SUCCEED, L.FAIL, L.RESTORE]
    events = hot_groups(seed, kinds if seed % 2 else kinds * 20 + [L.REMOVE])
    state, accepted = {}, set()
    for k, seq, event in events:
        status, previous, removed = state.get(k, ("pending", "pending", False))
        ok = not removed and (
            event == L.REMOVE or (status != "processing" if event == L.START else status == "processing")
        )
        if ok:
            accepted.add((k, seq))
            if event == L.START:
                status, previous = "processing", status
            else:
                status = {L.SUCCEED: "ready", L.FAIL: "error", L.REMOVE: "error", L.RESTORE: previous}[event]
        state[k] = (status, previous, removed or event == L.REMOVE)
    df = spark.createDataFrame(events, "entity_id string, seq bigint, event string")
    judged = L.judged_source_events(df)
    assert judged.count() == len(events)
    assert {(r["entity_id"], r["seq"]) for r in judged.where("accepted").collect()} == accepted
    assert {(r["entity_id"], r["status"], r["removed"]) for r in L.source_states(df).collect()} == {
        (k, s, gone) for k, (s, _, gone) in state.items()
    }


def test_merge_intervals(spark):
    rng = random.Random(1)
    spans = [("k", a, a + rng.randrange(4)) for a in (rng.randrange(200) for _ in range(60))]
    points = sorted({p for _, a, b in spans for p in range(a, b + 1)})
    expected = sum(1 for i, p in enumerate(points) if i == 0 or p > points[i - 1] + 1)
    runs = merge_intervals(spark.createDataFrame(spans, "k string, a bigint, b bigint"), ["k"], "a", "b")
    assert runs.count() == expected
    assert runs.agg(F.sum(F.col("b") - F.col("a") + 1)).first()[0] == len(points)


DEFINITION = Definition(
    "v",
    fields=("n", "s"),
    filters=(FilterRule("n", "between"), FilterRule("d", "gte"), FilterRule("b", "eq"), FilterRule("s", "in", True)),
    sort=(SortRule("n"), SortRule("d")),
    max_limit=100,
)
TYPES = {"n": "number", "s": "string", "d": "date", "b": "boolean", "x": "string"}
REQUESTS = [
    {"s": "a"}, {}, {"s": " , "}, {"s": "a", "x": "1"}, {"s": "a", "fields": "n,x"}, {"s": "a", "fields": "s, n"},
    {"s": "a", "page": "0"}, {"s": "a", "page": "+1"}, {"s": "a", "page": " 2 "}, {"s": "a", "limit": "101"},
    {"s": "a", "limit": "100"}, {"s": "a", "limit": "9" * 60}, {"s": "a", "sort": "n:desc"}, {"s": "a", "sort": "n:down"},
    {"s": "a", "sort": ["n", "x:asc"]}, {"s": "a", "sort": "n:asc:desc"}, {"s": "a", "n": "1,2"}, {"s": "a", "n": "1"},
    {"s": "a", "n": "1,zz"}, {"s": "a", "n": "0x1f,1e3"}, {"s": "a", "d": "2025-01-01"}, {"s": "a", "d": "2025-13-01"},
    {"s": "a", "d": "2025"}, {"s": "a", "b": "TRUE"}, {"s": "a", "b": "si"}, {"page": "x", "sort": "q", "n": "q"},
]


def test_request_audit_agrees_with_request_parsing(spark):
    codes = {
        E.FilterNotAllowed: {"FILTER_NOT_ALLOWED", "PROJECTION_NOT_ALLOWED", "REQUIRED_FILTER_MISSING"},
        E.InvalidPagination: {"INVALID_PAGE", "INVALID_LIMIT"},
        E.SortNotAllowed: {"SORT_NOT_ALLOWED"},
        E.ValueCastError: {"VALUE_CAST_ERROR"},
    }
    columns = [Column(k, t) for k, t in TYPES.items()]
    rule = [(f.field, f.op, f.required) for f in DEFINITION.filters]
    order = [(s.field, s.dir) for s in DEFINITION.sort]
    defs = spark.createDataFrame(
        [("d1", "v", "s1", "ds1", False, list(DEFINITION.fields), rule, order, 50, 100, True)],
        "definition_id string, slug string, source_id string, dataset_id string, follow_latest boolean,"
        " fields array<string>, filters array<struct<field:string,op:string,required:boolean>>,"
        " sort array<struct<field:string,dir:string>>, default_limit int, max_limit int, enabled boolean",
    )
    sets = spark.createDataFrame(
        [("ds1", "s1", 1, "published", 10)],
        "dataset_id string, source_id string, version int, status string, row_count bigint",
    )
    cols = spark.createDataFrame([("ds1", k, t) for k, t in TYPES.items()], "dataset_id string, key string, type string")
    logged = [
        (i, "v", {k: v if isinstance(v, list) else [v] for k, v in r.items()}) for i, r in enumerate(REQUESTS)
    ] + [(99, "none", {})]
    log = spark.createDataFrame(logged, "request_id bigint, slug string, params map<string,array<string>>")
    got = {r["request_id"]: r["error"] for r in A.request_audit(log, D.resolve(defs, sets), cols).collect()}
    assert got.pop(99) == "SLUG_NOT_FOUND"
    for i, params in enumerate(REQUESTS):
        try:
            parse_request(params, DEFINITION, columns)
            assert got[i] is None, (params, got[i])
        except E.GridpressError as error:
            assert got[i] in codes[type(error)], (params, got[i], error)


def test_config_checks(spark):
    vectors = [
        ("manual", '{"format":"csv","payload":"a"}', None),
        ("manual", '{"format":"csv","payload":" "}', "PAYLOAD_EMPTY"),
        ("api", '{"url":"https://h.example.com","method":"PUT"}', "CONFIG_SHAPE"),
        ("url", '{"url":"file:///etc/x"}', "URL_INVALID"),
        ("pdf", '{"url":"http://h.example.com/a.pdf","pages":[1,2.0]}', None),
        ("pdf", '{"url":"http://h.example.com/a.pdf","pages":"1"}', "CONFIG_SHAPE"),
        ("pdf", '{"url":"http://h.example.com/a.pdf","tableIndex":"2"}', "CONFIG_SHAPE"),
        ("pdf", '[1]', "CONFIG_SHAPE"),
        ("other", '{"url":"http://h.example.com"}', "CONFIG_SHAPE"),
    ]
    df = spark.createDataFrame([(str(i), t, c) for i, (t, c, _) in enumerate(vectors)], "source_id string, type string, config string")
    got = {r["source_id"]: r["error"] for r in config_checks(df).collect()}
    assert got == {str(i): e for i, (_, _, e) in enumerate(vectors)}
