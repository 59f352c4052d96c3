"""Operators beside plain Python on the small tables, and their parts on random input."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, duck
from gridpress.llm import decontaminate, hamming, lm, near_dup, pieces, quality, secrets, token_counts, trigrams, warc, words
from gridpress.llm.graph import components
from gridpress.llm.trie import EliasFano, Trie

FOLDER = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def read(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


@tables
@pytest.mark.parametrize("name", ["op2_secrets", "op5_warc", "op6_decontaminate", "op8_top_k", "op9_chat"])
def test_queries_against_sql(spark, name):
    ok, note = compare(spark, duck(SMALL), SMALL, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_operator_has_a_query():
    for n in range(1, 11):
        assert any(q.startswith(f"op{n}_") for q in entry.queries())
    assert "pipeline" in entry.queries()


def test_words_match_plain_splitting():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \t\n\x0b\x1céÉß ▁.") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None]
    data, offsets = words.buffer(pa.array(texts))
    cut = words.split(data, offsets)
    plain = [split_words(t) for t in texts]
    got = [bytes(cut.data[a:b]).decode() for a, b in zip(cut.start, cut.end, strict=True)]
    assert got == [w for p in plain for w in p]
    by_word = defaultdict(set)
    for w, h in zip(got, cut.hashes(), strict=True):
        by_word[w].add(int(h))
    assert all(len(x) == 1 for x in by_word.values()) and len({min(x) for x in by_word.values()}) == len(by_word)
    rows = [r for r in words.slices(pa.array(texts), 20)]
    assert [r[:2] for r in rows][0][0] == 0 and rows[-1][1] == len(texts)


def links_of(texts, width, percent):
    sets = []
    for t in texts:
        w = split_words(t)
        sets.append({tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set())
    return sets, [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def roots(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    return [root(i) for i in range(n)]


def check_near(spark, texts, width, percent):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets, links = links_of(texts, width, percent)
    want = roots(len(texts), links)
    got = {r.doc_id: r for r in near_dup.near_duplicates(rows, width, percent).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].kept for i in range(len(texts))] == [i == w for i, w in enumerate(want)]


@tables
def test_near_duplicates_against_all_pairs(spark):
    check_near(spark, [r["text"] for r in sorted(read(SMALL, "documents"), key=lambda r: r["doc_id"])][:600], 3, 85)


def edited(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_duplicates_in_a_dense_group(spark, monkeypatch):
    """Many near copies, some linked only through others, with regions and groups cut small."""
    monkeypatch.setattr(near_dup, "REGION_ROWS", 64)
    monkeypatch.setattr(near_dup, "GROUP_SHINGLES", 3000)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    texts = [edited(rng, base, rng.randrange(1, 5)) for _ in range(250)] + [" ".join(base)]
    texts += [edited(rng, [f"o{k}x{i}" for i in range(80)], 0) for k in range(20)]
    texts += [edited(rng, texts[k].split(), 2) for k in range(251, 271)] + texts[:5]
    check_near(spark, texts, 3, 85)


def test_components(spark):
    rng = random.Random(5)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(300)]
    edges = [(ids[i], ids[i + 1]) for i in range(100)] + [(rng.choice(ids[150:]), rng.choice(ids[150:])) for _ in range(90)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    number = {v: k for k, v in enumerate(ids)}
    want = roots(len(ids), [(number[a], number[b]) for a, b in edges])
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (want[number[a]] == want[number[b]])
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_trie_and_sequences():
    rng = np.random.default_rng(0)
    for n, contexts, successors in ((1, 1, 1), (40, 5, 9), (3000, 200, 1 << 36)):
        pairs = np.unique(np.stack([rng.integers(0, contexts, n), rng.integers(0, successors, n)], 1), axis=0).astype(np.uint64)
        codes = rng.integers(1, 256, len(pairs)).astype(np.uint8)
        trie = Trie(Trie.pack(pairs[:, 0], pairs[:, 1], codes))
        assert (trie.find(pairs[:, 0].copy(), pairs[:, 1].copy()) == codes).all()
        held = {tuple(p): c for p, c in zip(pairs.tolist(), codes, strict=True)}
        asked = np.stack([rng.integers(0, contexts + 2, 500), rng.integers(0, successors + 2, 500)], 1).astype(np.uint64)
        assert [held.get(tuple(a), 0) for a in asked.tolist()] == trie.find(asked[:, 0].copy(), asked[:, 1].copy()).tolist()
        values = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        packed = EliasFano(EliasFano.pack(values), 0)
        assert (packed.get(np.arange(n)) == values).all()
        assert (packed.successor(values) == np.searchsorted(values, values)).all()


def test_trie_opens_from_a_file(tmp_path):
    one = np.array([1, 1, 4], np.uint64)
    path = tmp_path / "trie"
    path.write_bytes(Trie.pack(one, np.array([2, 9, 1], np.uint64), np.array([7, 8, 9], np.uint8)))
    assert Trie.open(str(path)).find(one, np.array([9, 3, 1], np.uint64)).tolist() == [8, 0, 9]


@tables
def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(lm, "SHARD_BYTES", 100_000)
    rows = read(FOLDER, "documents")
    got = {r.doc_id: r for r in entry.queries()["op4_lm_scores"](spark, FOLDER).collect()}
    texts = {r["doc_id"]: split_words(r["text"]) + [None] for r in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    train = [t for i, t in texts.items() if not out[i]]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["", *t], t))
    n, v = sum(c.values()), len(c)
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        best = worst = 0.0
        for u, w in zip(["", *t], t):
            before = len(train) if u == "" else c[u]
            g = min(1.0, lm.DISCOUNT * before ** (lm.HEAPS - 1)) if before else 1.0
            part, rest = (1 - g) * pairs[u, w] / max(before, 1), g * (c[w] + 1) / (n + v + 1)
            best += math.log10(part + rest)
            worst += math.log10(part / 1.12 + rest)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and worst - 1e-6 <= r.score <= best + 1e-6


def kneser_ney(texts):
    """ln p(w | u v) of interpolated modified Kneser-Ney, by dictionaries."""
    three = Counter()
    for t in texts:
        t = ["<s>", "<s>", *t, "</s>"]
        three.update(zip(t, t[1:], t[2:]))
    two = Counter((v, w) for _, v, w in three)
    one = Counter((w,) for _, w in two)

    def order(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        d = [0.5, 0.75, 0.9]
        if min(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
        off = lambda c: d[min(c, 3) - 1]
        total, lost = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            lost[g[:-1]] += off(c)
        return {g: (c - off(c)) / total[g[:-1]] for g, c in counts.items()}, {k: lost[k] / total[k] for k in total}

    (s3, g3), (s2, g2), (s1, g1) = order(three), order(two), order(one)
    root = 1 / (len(one) + 1)

    def p(u, v, w):
        low = s1.get((w,), 0) + g1[()] * root
        mid = s2.get((v, w), 0) + g2[(v,)] * low if (v,) in g2 else low
        return s3.get((u, v, w), 0) + g3[(u, v)] * mid if (u, v) in g3 else mid

    return p


@pytest.mark.parametrize("slots", [quality.HOT_SLOTS, 32])
def test_kneser_ney_against_dictionaries(spark, monkeypatch, slots):
    # Most grams are then looked up in the shards.
    plain = quality._hot
    monkeypatch.setattr(quality, "_hot", lambda model: tuple(np.where(np.arange(quality.HOT_SLOTS) % (quality.HOT_SLOTS // slots) == 0, x, 0) for x in plain(model)))
    rng = random.Random(2)
    texts = [[f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randrange(1, 30))] for _ in range(120)]
    model, unknown = quality.train(spark.createDataFrame([(" ".join(t),) for t in texts[:100]], "text string"))
    p = kneser_ney(texts[:100])
    asked = [*texts[80:], ["new", "w1", "new", "w2", "w3"], [], texts[0] * 300]
    docs = spark.createDataFrame([(i, " ".join(t), "en") for i, t in enumerate(asked)], "doc_id bigint, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality.perplexities(docs, model, unknown).collect()}
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        t = ["<s>", "<s>", *t, "</s>"]
        want = sum(math.log(p(*g)) for g in zip(t, t[1:], t[2:]))
        assert got[i].log_p == pytest.approx(want, rel=1e-9) and got[i].n_tokens == len(t) - 2


@tables
def test_quality_on_held_out_labels(spark):
    rows = {r.doc_id: r.kept for r in entry.queries()["op1_quality"](spark, SMALL).collect()}
    labels = read(SMALL, "labels")
    good = [rows[x["doc_id"]] for x in labels if x["quality"] == 1]
    bad = [rows[x["doc_id"]] for x in labels if x["quality"] == 0]
    assert len(rows) == len(read(SMALL, "documents"))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.4


def test_trigram_conditions_hold_for_every_match():
    rng = random.Random(4)
    samples = ["password=abcdefghijklmno", "API_KEY: 'aaaaaaaaaaaaaa'", "apikey=bbbbbbbbbbbbbbb", "AKIA" + "Q" * 16, "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefghij.eyJabcdefghij.abcdefghij", "token : zzzzzzzzzzzzzzz"]
    texts = ["".join(rng.choice(samples + ["x", " ", "\n", "passwor", "AKI"]) for _ in range(5)) for _ in range(300)]
    for rule in secrets.RULES:
        condition = trigrams.mandatory(rule.pattern)
        for t in texts:
            if re.search(rule.pattern, t) and condition is not None:
                assert any(all(g in t.lower() for g in a) for a in condition)
    assert trigrams.mandatory("[0-9a-f]{16,}") is None and trigrams.mandatory("a?b") is None
    assert trigrams.mandatory("(abc|x?)yzw") == [frozenset({"abc", "bcy", "cyz", "yzw"}), frozenset({"yzw"})][1:]


def test_secrets_in_crowded_texts(spark):
    rng = random.Random(6)
    part = ["password=token=abcdefghijkl", "secret: 'short'", "ApiKey=" + "k" * 14, "AKIA" + "Z9" * 8, "0123456789abcdef" * 2, "é▁", " ", "deadbeef", "\n", "-----BEGIN PRIVATE KEY-----"]
    texts = ["".join(rng.choice(part) for _ in range(n)) for n in (1, 3, 8, 40, 900)]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in got:
        want = []
        for k, rule in enumerate(secrets.RULES):
            want += [(m.start(), k, m.end(), rule.kind) for m in re.finditer(rule.pattern, r.text, re.A) if len(m[rule.group]) >= rule.least]
        assert [tuple(z) for z in r.found] == sorted(want)
    clean = {r.doc_id: r.text for r in secrets.redacted(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))).collect()}
    for r in got:
        mask = np.zeros(len(r.text) + 1, bool)
        for z in r.found:
            mask[z["start"] : z["end"]] = True
        outside = "".join(ch for ch, m in zip(r.text, mask, strict=False) if not m)
        assert clean[r.doc_id].replace("[SECRET]", "") == outside


def test_decontamination_in_blocks(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(40))) for i in range(60)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, text(rng.randrange(1, 14))) for i in range(30)], "item_id bigint, text string")
    one = sorted(decontaminate.contamination(docs, items, width=8).collect())
    many = sorted(decontaminate.contamination(docs, items, width=8, block_bytes=200).collect())
    assert one == many and any(r.contaminated for r in one)
    given = {r.doc_id: r.text for r in docs.collect()}
    for r in one:
        spans = sum(len(given[r.doc_id][s["start"] : s["end"]].split()) for s in r.spans)
        assert spans == r.n_hit


def segmentations(v, s):
    """(score, ids) of every path through the lattice of a stretch."""
    if not s:
        return [(0.0, [])]
    out = []
    for j, k, score in v.arcs(s, 0):
        head = v.ids(s, [(0, k)])
        out += [(score + x, head + y) for x, y in segmentations(v, s[j:])]
    return out


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Vocabulary(f.read())


def test_n_best_against_all_segmentations(vocabulary):
    v = vocabulary
    for s in ["▁the", "▁nations", "▁Über", "▁▁x1", "▁a☃b", "▁ab.cd", "\n", "▁"]:
        every = sorted((-x for x, _ in segmentations(v, s)))
        got = v.n_best(s, 6)
        assert [-x for x, _ in got] == pytest.approx(every[:6])
        assert len({tuple(y) for _, y in got}) == len(got)
        assert all((pytest.approx(x), y) in segmentations(v, s) for x, y in got)
        index = v.add(s)
        assert v.score[index] == pytest.approx(-every[0])
        assert v.lead[index] == pytest.approx((every[1] - every[0]) if len(every) > 1 else math.inf)


def test_text_n_best_against_all_segmentations(vocabulary):
    v = vocabulary
    for text in ["to be", "a b c", "it, is", "x", "wa\nit"]:
        normal = v.model.normalize(text)
        stretches = [s for s in v.stretch.findall(normal) if s]
        assert "".join(stretches) == normal
        index = np.array([v.known.get(s) or v.add(s) for s in stretches])
        every = sorted(-x for x, _ in segmentations(v, normal))
        got = v.text_n_best(stretches, index, 5)
        assert [-x for x, _ in got] == pytest.approx(every[:5])


def test_pieces_round_trip(spark):
    rng = random.Random(9)
    texts = ["", None, " ", "a  b", "héllo wörld", "日本語のテキスト", "tab\tline\n", "☃ snow", "x" * 3000, "".join(chr(rng.randrange(32, 0x3000)) for _ in range(500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    coded = pieces.encode(docs, n=3)
    assert all(r.round_trip for r in coded.collect())
    back = {r.doc_id: r.text for r in pieces.decode(coded).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))


def test_token_counts_against_a_loop(spark):
    import base64

    import tiktoken

    with open(token_counts.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(10)
    rows = []
    for i in range(40):
        text = "".join(rng.choice(["word ", "é☃", "\n", " 12", "日本", "x"]) for _ in range(rng.randrange(30)))
        sections = [{"start": a, "end": a + rng.randrange(-2, 12)} for a in (rng.randrange(len(text) + 3) for _ in range(5))]
        rows.append((i, text, sections))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sections array<struct<start: int, end: int>>")
    for rule in ("start", "middle", "last"):
        got = {r.doc_id: r for r in token_counts.token_counts(docs, rule).collect()}
        for i, text, sections in rows:
            at, spans = 0, []
            raw = text.encode()
            points = [k for k, ch in enumerate(text) for _ in ch.encode()]
            for t in encoding.encode_ordinary(text):
                size = len(encoding.decode_single_token_bytes(t))
                spans.append((points[at], points[at + size - 1] + 1))
                at += size
            assert at == len(raw)
            anchor = [{"start": a, "last": b - 1, "middle": (a + b - 1) // 2}[rule] for a, b in spans]
            assert got[i].n_tokens == len(spans)
            assert got[i].section_tokens == [sum(s["start"] <= a < s["end"] for a in anchor) for s in sections]
            assert got[i].n_outside == sum(not any(s["start"] <= a < s["end"] for s in sections) for a in anchor)
    lines = {r.doc_id: r for r in token_counts.token_counts(docs, by_paragraph=True).collect()}
    assert all(len(lines[i].section_tokens) == t.count("\n") + 1 and sum(lines[i].section_tokens) == lines[i].n_tokens for i, t, _ in rows)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(11)
    codes = rng.integers(0, 2, (120, 40)) * 2.0 - 1
    codes[60:100] = codes[0]
    rows = [(int(i), [float(x) for x in c]) for i, c in enumerate(codes)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in hamming.top_k(vectors.filter("vec_id % 20 = 0"), vectors, k=7).orderBy("query", "rank").collect():
        got[r["query"]].append((r.distance, r.id))
    for q in range(0, 120, 20):
        assert got[q] == sorted((int((codes[q] != c).sum()), i) for i, c in enumerate(codes))[:7]


def test_chunked_coding():
    for size in (0, 1, 7, 8, 9, 100):
        body = os.urandom(size)
        assert warc.dechunked(warc.chunked(body, 8)) == body


@tables
def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        before = sorted(docs.collect(), key=lambda r: r.doc_id)
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        texts = [r.text for r in before]
        if name == "near_duplicates":
            want = roots(len(texts), links_of(texts, 5, 80)[1])
            assert set(after) == {r.doc_id for k, r in enumerate(before) if want[k] == k}
        elif name == "decontamination":
            cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
            grams = set()
            for b in read(FOLDER, "benchmark"):
                w = cut(b["text"])
                grams |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 10, 0) + 1)} if w else set()
            sizes = {len(g) for g in grams}
            hit = lambda w: any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))
            assert set(after) == {r.doc_id for r in before if not hit(cut(r.text))}
        elif name == "secrets":
            assert set(after) == {r.doc_id for r in before}
            rules = [(x.pattern, x.group, x.least) for x in secrets.RULES]
            for r in before:
                dirty = any(len(m[g]) >= n for p, g, n in rules for m in re.finditer(p, r.text or "", re.A))
                assert (after[r.doc_id].text != r.text) == dirty
        elif name == "sentencepiece":
            assert set(after) == {r.doc_id for r in before} and all(r.round_trip for r in after.values())
