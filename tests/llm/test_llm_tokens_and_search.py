"""Byte-level BPE, alignment, lexical search and the sharded sums beside plain versions."""

import base64
import hashlib
import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from compare import compare, duck
from gridpress.llm import align, bpe, lexical, sums, token_counts
from gridpress.llm.stretches import CUT, runs

FOLDER, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
BITS = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "'s", "'", "ll", "é", "ß", "€", "😀", "1", "23", "!", "\x1c", " ", "　", "ing", "aaaa", "    ", "<|endoftext|>", "\x85", "日本", "​", "\x00", "ÿ"]
EDGES = [None, "", " ", "  ", " a", "a ", "a  b", "a\n b", "a\n  b \n", "x▁y", "▁", " ▁ a", "<|endoftext|> <s> </s>", "日本 語", "é  ß\t z", "a\x1c b", "　 a", "a\x00b c", "it's 'll", "😀 😀", " " * 2000, "a" * 3000 + " b", "\n" * 300, "a b", "a b"]


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def plain():
    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.tokenizer_of(bpe.RANKS), bpe.PATTERN)


def random_text(rng, n=25):
    return "".join(rng.choice(BITS) for _ in range(rng.randrange(1, n)))


def test_stretches_join_to_the_text():
    rng = random.Random(1)
    for _ in range(300):
        text = random_text(rng, 60)
        assert "".join(runs(text, 7)) == text
        assert [s for r in runs(text, 7) for s in CUT.split(r)] == CUT.split(text)


def test_bpe_equals_merging_by_rank(plain, vocabulary):
    rng = random.Random(3)
    for text in [random_text(rng) for _ in range(5000)] + ["".join(rng.choice("ab") for _ in range(400)) for _ in range(20)]:
        ids = vocabulary.encode(text)
        assert ids.tolist() == plain.encode_ordinary(text) and vocabulary.decode(ids) == text.encode()


def test_bpe_splits_every_kind_of_character_alike(plain, vocabulary):
    for c in itertools.chain(range(0, 0xD800, 5), range(0xE000, 0x32000, 11)):
        text = f"a{chr(c)}a1{chr(c)}1 {chr(c)}!"
        assert vocabulary.encode(text).tolist() == plain.encode_ordinary(text), hex(c)


def test_bpe_of_small_and_odd_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    assert bpe.merge_of(b"abc", ranks) == (b"ab", b"c")
    assert bpe.merge_of(b"xyz", ranks) is None


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "a" * 1_000_000, "\n" * 500_000 + "b", "é" * 200_000])
def test_long_runs(spark, vocabulary, text):
    ids = vocabulary.encode(text)
    assert vocabulary.decode(ids) == text.encode()
    row = token_counts.token_counts(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), by_paragraph=True).first()
    assert row.n_tokens == len(ids) == sum(row.section_tokens)


def test_bpe_query_and_edges(spark, plain):
    docs = spark.createDataFrame(list(enumerate(EDGES)) + [(None, "é")], "doc_id bigint, text string").withColumn("ids", F.lit("own")).withColumn("decoded", F.lit("own"))
    found = bpe.decode(bpe.encode(docs)).collect()
    texts = dict(enumerate(EDGES)) | {None: "é"}
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id] or ""
        assert r.ids == plain.encode_ordinary(text) and bytes(r.decoded) == text.encode() and bpe.text_of(r.decoded) == text
        at, want = 0, []
        points = [k for k, ch in enumerate(text) for _ in ch.encode()]
        for i in r.ids:
            size = len(plain.decode_single_token_bytes(i))
            want.append((points[at], points[at + size - 1] + 1))
            at += size
        assert list(zip(r.starts, r.ends, strict=True)) == want
        assert r.n_split == sum(b[0] < a[1] for a, b in itertools.pairwise(want))
    odd = bpe.decode(spark.createDataFrame([(1, [220, None, -4, 10**6]), (2, None), (3, [])], "doc_id bigint, ids array<int>"))
    assert {r.doc_id: bytes(r.decoded) for r in odd.collect()} == {1: b" ", 2: b"", 3: b""}
    assert bpe.decode(bpe.encode(docs.filter("false"))).count() == 0


@tables
def test_bpe_query_on_documents(spark, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in entry.queries()["op12_byte_bpe"](spark, FOLDER).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(texts[r.doc_id]))


def ends(sizes):
    return list(itertools.accumulate(sizes))


def aligned(texts):
    """Rows of the alignment query, token by token."""
    a = Tokenizer.from_file(align.TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.MODEL)
    byte = {c: i for i, c in enumerate(bpe.byte_characters())}
    a_bytes = {i: bytes([byte[c] for c in t]) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, counts = [], Counter()
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in x) != raw or b"".join(map(b_bytes, y)) != raw:
            rows.append(None)
            continue
        left, right = ends(len(a_bytes[i]) for i in x), ends(len(b_bytes(i)) for i in y)
        groups, low = [], 0
        for e in sorted(set(left) & set(right)):
            groups.append(([i for i, z in zip(x, left, strict=True) if low < z <= e], [i for i, z in zip(y, right, strict=True) if low < z <= e]))
            low = e
        at = dict(zip(right, y, strict=True))
        links = [(i, at[z]) for i, z in zip(x, left, strict=True) if z in at]
        counts.update(links)
        rows.append((len(x), len(y), groups, links))
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            shown = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in row[2])
            out.append((row[0], row[1], len(row[2]), len(row[3]), sum(counts[k] == top[k[1]] for k in row[3]), sum(counts[k] for k in row[3]), digest(shown)))
    return out


def shown(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_alignment_against_token_loops(spark):
    rng = random.Random(5)
    texts = EDGES + [random_text(rng, 12) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("block", F.lit("own")).withColumn("place", F.lit("own")).repartition(5)
    got = {r.doc_id: shown(r) for r in align.alignment_scores(docs).collect()}
    assert [got[i] for i in range(len(texts))] == aligned(texts)
    assert align.alignment_scores(docs.filter("false")).count() == 0
    only = align.alignment_scores(docs.filter("doc_id < 2")).collect()
    assert [shown(r) for r in only] == [(0, 0, 0, 0, 0, 0, "")] * 2


@tables
def test_alignment_query_on_documents(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: shown(r) for r in entry.queries()["op11_alignment"](spark, FOLDER).collect()}
    want = aligned([r.text for r in rows if len(r.text or "") < 4000])
    short = [r.doc_id for r in rows if len(r.text or "") < 4000]
    assert len(got) == len(rows)
    # Corpus counts are over all texts; the rest must agree text by text.
    assert [got[i][:4] + got[i][6:] for i in short] == [w[:4] + w[6:] for w in want]


def test_alignment_pairs(spark):
    docs = spark.createDataFrame([(1, "hello wörld"), (2, None), (3, "a▁b")], "doc_id bigint, text string")
    got = {r.doc_id: r.pairs for r in align.align(docs).collect()}
    assert got[2] == got[3] == []
    assert got[1][-1].end == len(" hello wörld".encode()) and got[1][-1].linked
    assert [p.group for p in got[1]] == sorted(p.group for p in got[1])


def test_groups_and_overlaps_of_random_tilings():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 30)
        cut = lambda n=n: np.array(sorted({*(rng.randrange(1, n + 1) for _ in range(rng.randrange(1, 12))), n}))
        a, b = cut(), cut()
        both = sorted(set(a) & set(b))
        group = [np.searchsorted(both, side) for side in (a, b)]
        assert all((x == y).all() for x, y in zip(group, align.groups_of(a, b), strict=True))
        start = [np.concatenate([[0], side[:-1]]) for side in (a, b)]
        want = [(i, j, a[i] == b[j]) for i in range(len(a)) for j in range(len(b)) if max(start[0][i], start[1][j]) < min(a[i], b[j])]
        assert list(zip(*align.overlaps(a, b), strict=True)) == want


def test_sums_over_many_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(sums, "PART_BLOCKS", 3)
    rng = np.random.default_rng(4)
    rows, asked, want = [], [], {}
    values = {int(k): (int(k) % 1000 - 500, float(k % 7) / 3) for k in rng.integers(0, 1 << 62, 500)}
    known = np.array([*values, 5, 6], np.uint64)
    for block in range(10):
        size = int(rng.integers(1, 40))
        n = int(rng.integers(1, 900))
        # One hot key holds a third of all occurrences.
        keys = np.where(rng.random(n) < 0.33, known[0], known[rng.integers(0, len(known), n)])
        docs = np.sort(rng.integers(0, size, n))
        told = sums.postings(keys, docs, size)
        asked += [(block, s, bytearray(p)) for s, p in told]
        rows += [(block * 100 + d, block, d, len(told)) for d in range(size)]
        for d in range(size):
            mine = [values.get(int(k), (0, 0.0)) for k, at in zip(keys, docs, strict=True) if at == d]
            want[block * 100 + d] = (sum(x for x, _ in mine), sum(y for _, y in mine))
    table = spark.createDataFrame([(k, *v) for k, v in values.items()], "key bigint, x bigint, y double")
    got = sums.summed(spark.createDataFrame(rows, "doc_id bigint, block bigint, place int, asked int"), spark.createDataFrame(asked, sums.POSTINGS), table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.x == want[r.doc_id][0] and r.y == pytest.approx(want[r.doc_id][1])


def test_sharing_dag_gives_back_the_items():
    rng = random.Random(7)
    for _ in range(50):
        items, leaves = rng.randrange(1, 12), rng.randrange(1, 15)
        holders = [sorted(rng.sample(range(items), rng.randrange(1, items + 1))) for _ in range(leaves)]
        unions, last = lexical.sharing_dag(holders, items)
        content = [{i} for i in range(leaves)]
        for u, v in unions:
            assert not content[u] & content[v]
            content.append(content[u] | content[v])
        for item, nodes in enumerate(last):
            assert sorted(x for n in nodes for x in content[n]) == [i for i, h in enumerate(holders) if item in h]
        # Nothing is left to share.
        pairs = Counter(p for nodes in last for p in itertools.combinations(nodes, 2))
        assert not pairs or max(pairs.values()) == 1


@tables
@pytest.mark.parametrize("folder", [FOLDER, SMALL])
def test_lexical_query_against_sql(spark, folder):
    ok, note = compare(spark, duck(folder), folder, entry.queries()["op13_lexical_search"], entry.oracle_sql()["op13_lexical_search"])
    assert ok, note


def brute_search(docs, items, k):
    import math
    import re

    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    held = [(i, terms(t)) for i, t in docs]
    big, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        rows = []
        for doc, w in held:
            tf, m = Counter(w), 50 + (50 * len(w) * big) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(terms(text)) if tf[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, n + 1, None if void else doc, -s) for n, (s, void, doc) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("item_bytes", [lexical.ITEM_BYTES, 200])
def test_lexical_search_with_ties_blocks_and_gaps(spark, item_bytes):
    rng = random.Random(12)
    word = lambda: rng.choice(["a", "B", "c1", "é", "zeta", "Eta", "theta"])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(150)] + [(3, "a b"), (3, "a b"), (None, "zeta a"), (200, None), (201, "!?"), (202, "a " * 50_000)]
    items = [(i, ", ".join(word() for _ in range(rng.randrange(0, 6)))) for i in range(30)] + [(5, "a theta"), (5, "a theta"), (None, "é"), (40, None), (41, "none such")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item", F.lit("own")).repartition(4)
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit("own"))
    got = lexical.search(d, i, k=7, item_bytes=item_bytes)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_search(docs, items, 7)
    assert lexical.search(d.filter("false"), i).count() == 0 and lexical.search(d, i.filter("false")).count() == 0


def test_filters_hold_all_their_keys(spark):
    from gridpress.llm.filters import filter_of, may_hold

    rng = np.random.default_rng(9)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)
    bits = np.frombuffer(filter_of(spark.createDataFrame([(int(k),) for k in keys], "key bigint"), both=True), np.uint8)
    assert may_hold(bits, keys.view(np.uint64)).all()
    others = rng.integers(0, (1 << 63) - 1, 200_000).astype(np.uint64)
    assert may_hold(bits, others).mean() < 1e-4
