"""Secret scans behind a trigram inverted index; DataFrame functions only.

Method. Each rule's regular expression gives a Boolean trigram condition
(``trigrams.mandatory``). One scan builds the inverted index of the trigrams
that any condition names: postings per (trigram, bucket of documents), where
buckets hold some ``BUCKET_ROWS`` documents whatever the size of the table.
Inside each bucket the postings of an alternative are intersected and the
alternatives united; the expression then runs on those candidates alone. A
rule without mandatory trigrams (``hex``) scans every text.

Skew. Postings are keyed by a hash of the whole row, so copies of a row are one
posting and buckets are even. Candidates carry no text. They are joined to the
documents; Spark broadcasts them only under its own size threshold.

Spans are code points, end exclusive; matches of a kind are leftmost and do
not overlap, and one that fails its length test is dropped after it has
consumed its text. ``RULES`` find a private key by its BEGIN line, as the SQL
does; ``REMOVED``, for redaction, covers the block to its END line, or to the
end of its base64 lines where END is missing.

Edge cases. A null text reads as empty; very long texts are scanned whole.
Spans with equal starts come in the order of their rules. Repeated rows are answered one by one,
null ids too. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpress.llm.trigrams import mandatory
from gridpress.session import stage
from workloads.base import Registry, Tables

R = Registry()

BUCKET_ROWS = 4096
#: Prefix sums are taken in two levels of this width.
STRIDE = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret: group ``group`` of ``pattern`` must have ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),
)
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
)
RULES = BASE + MORE

#: Line ends within a key block, written out or as escapes, and what a cut block's lines look like.
_BREAK = r"(?:\s|\\[nr])"
_KEY_LINES = (
    rf"(?:{_BREAK}++[A-Za-z][A-Za-z-]*+:[^\r\n]*+)*+"
    rf"(?:{_BREAK}++[A-Za-z0-9+/]{{40,}}+={{0,2}}+)++"
    rf"(?:{_BREAK}++[A-Za-z0-9+/]+(?:=+|(?=[\x20\t]*+(?:[\r\n\\]|\Z))))?"
)
#: A private key up to its END line; where none follows before another block, its header and base64 lines.
KEY_BLOCK = (
    MORE[0].pattern
    + r"(?:(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END\x20[A-Z ]{0,40}PRIVATE KEY-----"
    + rf"|{_KEY_LINES}|)"
)
#: What is taken out of texts: ``RULES`` with whole key blocks, where ``op2_secrets`` reports their first lines.
REMOVED = BASE + (Rule("pem", KEY_BLOCK, 1), *MORE[1:])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end, kind>> of a rule's matches in a text."""
    rx = F.lit(rule.pattern)
    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("between"),
        F.regexp_extract_all(text, rx, F.lit(0)).alias("found"),
        F.regexp_extract_all(text, rx, F.lit(rule.group)).alias("tested"),
    )

    def starts(p: Column) -> Column:
        steps = F.transform(p["between"], lambda x, i: F.length(x) + F.coalesce(F.length(F.get(p["found"], i - 1)), F.lit(0)))
        sums = lambda s: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(s) - 1) / STRIDE).cast("int")), lambda g: _total(F.slice(s, g * STRIDE + 1, F.lit(STRIDE)))
        )
        return _let(steps, lambda s: _let(F.struct(s.alias("each"), sums(s).alias("blocks")), lambda t: spans(p, t)))

    def spans(p: Column, t: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            block = F.floor(i / STRIDE).cast("int")
            start = _total(F.slice(t["blocks"], F.lit(1), block)) + _total(F.slice(t["each"], block * STRIDE + 1, i - block * STRIDE + 1))
            fits = F.length(F.get(p["tested"], i)) >= rule.least
            return F.when(fits, F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x)).alias("end"), F.lit(rule.kind).alias("kind")))

        return F.filter(F.transform(p["found"], one), lambda z: z.isNotNull())

    return _let(parts, starts)


def _nothing() -> Column:
    return F.lit(None).cast("array<struct<start:int,rank:int,end:int,kind:string>>")


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): for each document key, the bits of the rules whose trigram condition it meets.

    ``keyed`` has key and text. Rules without a condition are not listed.
    """
    conditions = {k: c for k, r in enumerate(rules) if (c := mandatory(r.pattern)) is not None}
    grams = sorted({g for c in conditions.values() for a in c for g in a})
    number = {g: k for k, g in enumerate(grams)}
    buckets = max(1, -(-keyed.count() // BUCKET_ROWS))
    lowered = keyed.select("key", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]))
    index = lowered.select("key", F.explode(present).alias("gram")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    postings = index.groupBy("bucket", "gram").agg(F.collect_set("key").alias("keys"))

    used = [F.flatten(F.collect_list(F.when(F.col("gram") == k, F.col("keys")))).alias(f"p{k}") for k in range(len(grams))]
    lists = postings.groupBy("bucket").agg(*used)

    def evaluated(condition: list[frozenset[str]]) -> Column:
        out = None
        for alternative in condition:
            hit = None
            for g in sorted(alternative):
                column = F.col(f"p{number[g]}")
                hit = column if hit is None else F.array_intersect(hit, column)
            out = hit if out is None else F.array_union(out, hit)
        return out

    each = [F.struct(evaluated(c).alias("keys"), F.lit(1 << k).alias("bit")) for k, c in conditions.items()]
    hits = lists.select(F.explode(F.array(*each)).alias("hit")).select(F.explode("hit.keys").alias("key"), "hit.bit")
    return hits.groupBy("key").agg(F.bit_or("bit").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with their ``found`` secrets in order of start, then of rule.

    ``key`` is what of a row is hashed beside its text; a doc_id that holds
    maps cannot be hashed whole.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64(key, "text"))
    listed = stage(candidates(keyed.select("key", "text"), rules), "candidates")
    rows = keyed.join(listed, "key", "left")
    found = []
    for k, rule in enumerate(rules):
        if mandatory(rule.pattern) is None:
            asked = F.col("text").rlike(rule.pattern)
        else:
            asked = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
        found.append(F.when(asked, matches(F.col("text"), rule, k)).otherwise(_nothing()))
    every = F.flatten(F.array_compact(F.array(*found)))
    return rows.select("doc_id", "text", F.array_sort(every).alias("found"))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda z: F.concat_ws(":", z["kind"], z["start"], z["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base kinds and all spans as text, a row per row of ``scan``."""
    of = lambda k: F.filter("found", lambda z: z["rank"] == k)
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(_listed(F.filter("found", lambda z: z["rank"] < len(BASE))), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )


def redacted(found: DataFrame) -> DataFrame:
    """doc_id and text with every stretch of secrets replaced by ``[SECRET]``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, z: Column) -> Column:
        text = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, z["start"] - a["at"]), F.lit("[SECRET]"))
        fresh = F.struct(z["end"].alias("at"), text.alias("out"))
        return F.when(z["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], z["end"]).alias("at"), a["out"].alias("out")))

    whole = F.aggregate("found", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return found.select("doc_id", F.when(F.size("found") == 0, F.col("text")).otherwise(whole).alias("text"))


def _sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        rx = r.pattern.replace("'", "''")
        parts.append(
            f"select doc_id, text, {k} r, '{r.kind}' kind, {r.least} least, string_split_regex(text, '{rx}') p, "
            f"regexp_extract_all(text, '{rx}') m, regexp_extract_all(text, '{rx}', {r.group}) v from d"
        )
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
k as ({" union all ".join(parts)}),
s as (select doc_id, r, kind, least, m[i] x, v[i] y,
        list_sum([length(z) for z in p[1:i]]) + coalesce(list_sum([length(z) for z in m[1:i - 1]]), 0) a
      from (select *, unnest(range(1, len(m) + 1)) i from k)),
f as (select doc_id, r, kind, a, kind || ':' || a::bigint || ':' || (a + length(x))::bigint t from s where length(y) >= least),
g as (select doc_id, count(*) filter (r = 0) n_assign, count(*) filter (r = 1) n_access, count(*) filter (r = 2) n_hex,
        string_agg(t, ',' order by a, r) filter (r < 3) base, string_agg(t, ',' order by a, r) spans from f group by 1)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
       sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join g using (doc_id)
"""


@R.add(_sql())
def op2_secrets(t: Tables) -> DataFrame:
    """All rules over all documents."""
    return digest(scan(t.documents))
