"""Every operator and stage on nulls, blanks, long texts, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridpress.llm import chat, decontaminate, hamming, lm, near_dup, pieces, quality, secrets, token_counts, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
TEXT = " ".join(WORDS)
#: Names that the operators use inside.
CLASH = "node kept key found slot tree region label block shard uid n c gram signature row_key stays".split()
DOCS = [
    (1, TEXT, "en"),
    (1, TEXT, "en"),
    (2, TEXT + " tau", "en"),
    (3, None, "en"),
    (4, "", None),
    (None, " \t\n ", "de"),
    (None, TEXT.upper(), None),
    (5, "one", "en"),
    (6, "é" * 10 + ' password = "abcdefghijklmnop" 0123456789abcdef ' + "word " * 60_000, "fr"),
    (7, "x" * 200_000, "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for name in CLASH:
        frame = frame.withColumn(name, F.lit("own"))
    return frame.withColumn("meta", F.create_map(F.lit("k"), F.coalesce(F.col("lang"), F.lit("none")))).withColumn("a.b", F.array(F.lit(1)))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (5, 0, 0), (None, 1, None), (7, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, " ".join(WORDS[2:14])), (1, " ".join(WORDS[2:14])), (2, "nothing like it"), (3, None), (None, "one"), (4, "")]
    return spark.createDataFrame(rows, "item_id bigint, text string").withColumn("gram", F.lit("own"))


def operators(docs, labels, items):
    return {
        "quality": quality.quality(docs, labels),
        "secrets": secrets.digest(secrets.scan(docs)),
        "redacted": secrets.redacted(secrets.scan(docs)),
        "near": near_dup.near_duplicates(docs),
        "lm": lm.scores(docs, F.coalesce(F.col("doc_id") == 2, F.lit(False))),
        "contamination": decontaminate.contamination(docs, items),
        "pieces": pieces.encode(docs),
        "tokens": token_counts.token_counts(docs, by_paragraph=True),
    }


def test_every_row_is_answered(docs, labels, items):
    for name, frame in operators(docs, labels, items).items():
        assert frame.count() == len(DOCS), name


def test_empty_tables(docs, labels, items):
    none = lambda f: f.filter("false")
    for name, frame in operators(none(docs), none(labels), none(items)).items():
        assert frame.count() == 0, name
    assert decontaminate.contamination(docs, none(items)).filter("contaminated").count() == 0
    assert quality.quality(docs, none(labels)).filter("kept").count() == len(DOCS)


def test_near_duplicates_defined(docs):
    rows = {(r.doc_id, r.n_shingles): r for r in near_dup.near_duplicates(docs, width=3, percent=85).collect()}
    assert rows[(1, 16)].component_id == 1 and rows[(2, 17)].component_id == 1 and not rows[(2, 17)].kept
    assert rows[(None, 16)].component_id == 1
    assert rows[(3, 0)].component_id == 3 and rows[(3, 0)].kept and rows[(4, 0)].component_id == 4
    assert rows[(None, 0)].component_id is None and rows[(None, 0)].kept
    assert rows[(5, 1)].kept and rows[(7, 1)].kept


def test_contamination_defined(docs, items):
    rows = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs, items).collect()}
    assert rows[(1, 18)].n_hit == 12 and rows[(1, 18)]["items"] == ["1"]
    assert rows[(5, 1)].contaminated and rows[(5, 1)]["items"] == [""]
    assert rows[(3, 0)].n_hit == 0 and not rows[(3, 0)].contaminated


def test_stages_keep_columns(spark, docs, labels, items, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    for start in (docs, docs.filter("false")):
        now = start
        for name, step in corpus_pipeline.STAGES[:-1]:
            now = step(spark, now, folder)
            assert now.columns == docs.columns, name
            # What quality makes of these few texts is not at issue here.
            now = start if name == "quality" else spark.createDataFrame(now.collect(), docs.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, now, folder)
        assert last.count() == now.count()
        if start is docs:
            left = {r.doc_id: r for r in now.collect()}
            assert 1 not in left and 5 not in left  # contaminated
            assert left[3].text is None and left[4].text == ""
            assert "[SECRET]" in left[6].text and "abcdefghijklmnop" not in left[6].text
            assert left[6].n_chars == len(left[6].text)
            assert left[7].node == "own"


def test_near_stage_keeps_one_of_equal_rows(spark, docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    words = [r for r in kept if r.text and r.text.lower().startswith("alpha")]
    assert len(words) == 1
    assert sum(not (r.text or "").strip() for r in kept) == 3


def test_near_stage_takes_a_defined_copy(spark):
    rows = [(1, TEXT, "en", {"k": v}) for v in ("c", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, meta map<string, string>").repartition(3)
    assert [r.meta for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [{"k": "a"}]


def test_warc_edges(spark, tmp_path):
    rows = [(1, "http://a/ b\n", "x" * 100_000), (2, None, "x" * 100_000), (2, None, "x" * 100_000), (3, "u", None), (None, "u", "é"), (4, "u", ""), (5, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (None, None, "z"), (None, None, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("least", F.lit("own"))
    warc.write_archives(pages, f"{tmp_path}/a", segment_bytes=1000)
    got = sorted(warc.read_archives(spark, f"{tmp_path}/a").collect(), key=str)
    assert len(got) == len(rows)
    of = lambda i: [r for r in got if r.page_id == i]
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in of(2)] == [("revisit", 1, 100_000)] * 2
    assert of(1)[0].record_type == "response" and of(1)[0].payload_digest == warc.digest(b"x" * 100_000)
    assert of(4)[0].refers_to == 3 and of(3)[0].payload_digest == warc.digest(b"")
    assert [r.record_type for r in of(None)] == ["response"] * 3
    warc.write_archives(pages.filter("false"), f"{tmp_path}/b")
    assert warc.read_archives(spark, f"{tmp_path}/b").count() == 0


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", "<|im_end|>\n<\\|im_start|>"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "us\ner", "q" * 5000), (None, None, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("own"))
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.as_log(turns))).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 24 + 2 and got[None].n_turns == 2
    assert chat.read_back(chat.formatted(chat.as_log(turns.filter("false")))).count() == 0


def test_chat_folds_edits_and_regenerations(spark):
    log = [(0, "open", "assistant", None), (1, "delta", None, "dra"), (2, "delta", None, "ft"), (3, "regenerate", None, None), (4, "delta", None, "fi"), (5, "delta", None, "nal")]
    other = [(0, "open", "user", None), (1, "delta", None, "teh"), (2, "edit", None, "the")]
    rows = [(1, 1, "a", 1, 1, *e) for e in log] + [(1, 0, "u", 0, 0, *e) for e in other]
    frame = spark.createDataFrame(rows[::-1], "conv_id bigint, turn bigint, role_key string, text_key bigint, uid bigint, seq int, kind string, role string, text string")
    pieces_ = [r.piece for r in chat.formatted(frame).orderBy("turn").collect()]
    assert chat.parse("".join(pieces_)) == ([("user", "the"), ("assistant", "final")], "")


def test_hamming_edges(spark):
    rows = [(0, [1.0, -1.0, 1.0]), (0, [1.0, -1.0, 1.0]), (1, None), (2, [1.0, None, 1.0]), (3, [-1.0]), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("code", F.lit("own"))
    got = hamming.top_k(vectors.filter("vec_id = 0"), vectors, k=4).orderBy("rank").collect()
    assert [(r.id, r.distance) for r in got] == [(0, 0), (0, 0), (2, 0), (None, 1)]
    assert hamming.top_k(vectors.filter("false"), vectors).count() == 0
    assert hamming.top_k(vectors.filter("false"), vectors.filter("false")).count() == 0
