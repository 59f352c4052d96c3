"""Corpus pipeline: quality, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and reads it back as the next stage's ``docs``. All stages but
the last return the columns they were given.

A row is known by a hash of its id, text and language, so rows without an id
or with equal ids are decided one by one; rows equal in all three share every
decision. Decisions are small tables of hashes; Spark joins them to the texts
by broadcast only under its own size threshold.

Edge cases, beside those of the operators: a null text passes the filters and
stays null; rows equal in id, text and language count as copies, of which the
near-duplicate stage keeps the one whose columns come first as JSON; columns beyond those of documents pass through
whatever their names; an empty table passes through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpress.llm.decontaminate import contamination
from gridpress.llm.near_dup import near_duplicates
from gridpress.llm.pieces import encode
from gridpress.llm.quality import quality
from gridpress.llm.secrets import REMOVED, redacted, scan
from gridpress.session import configure, scratch_root, stage
from workloads.base import Registry, Tables

R = Registry()

#: The pipeline's last stage goes beyond SQL; tests hold its rows against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the row hash under a name that it does not have yet."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64("doc_id", "text", "lang")), name


def _without(docs: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    rejected = stage(rejected.select(F.col("doc_id").alias(key)).distinct(), "rejected")
    return docs.join(rejected, key, "left_anti").drop(key)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose perplexity is above their language's quantile go."""
    configure(spark)
    docs, key = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = docs.select("doc_id", F.col(key).alias("at")).join(labels.select("doc_id", "quality"), "doc_id")
    labels = labels.select(F.col("at").alias("doc_id"), "quality")
    judged = quality(docs.select(F.col(key).alias("doc_id"), "text", "lang"), labels)
    return _without(docs, key, judged.filter(~F.col("kept")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the smallest id."""
    configure(spark)
    columns = docs.columns
    docs, key = _keyed(docs)
    rows = docs.select(F.struct(F.col("doc_id").alias("id"), F.col(key).alias("at")).alias("doc_id"), "text")
    found = near_duplicates(rows, width=5, percent=80)
    each = found.groupBy(F.col("doc_id.at").alias(key)).agg(F.max("kept").alias("stays"), F.count("*").alias("n"), F.max("n_shingles").alias("size"))
    # Copies of whole rows share a key: those of a row that stays are cut to one; wordless rows are linked with nothing.
    odd = stage(each.filter("not stays or (n > 1 and size > 0)").select(key, F.col("stays").alias("one_of_many")), "duplicates")
    flag = "stays"
    while flag in docs.columns:
        flag += "_"
    marked = docs.join(odd.withColumnRenamed("one_of_many", flag), key, "left")
    alone = marked.filter(F.col(flag).isNull())
    # Of rows equal in id, text and language, the one whose other columns come first as JSON.
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    copies = marked.filter(F.col(flag)).groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return alone.select(*[F.col(f"`{c}`") for c in columns]).union(copies.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold ten words in a row of a benchmark item, or a whole shorter item, go."""
    configure(spark)
    docs, key = _keyed(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs.select(F.col(key).alias("doc_id"), "text"), items)
    return _without(docs, key, found.filter("contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become ``[SECRET]``; n_chars follows."""
    configure(spark)
    rest = [c for c in docs.columns if c != "text"]
    whole = F.struct(*[F.col(f"`{c}`") for c in rest])
    rows = docs.select(F.struct(whole.alias("rest"), F.col("text").isNull().alias("void")).alias("doc_id"), "text")
    clean = redacted(scan(rows, REMOVED, key="doc_id.rest.doc_id"))
    text = F.when(~F.col("doc_id.void"), F.col("text"))
    kept = {c: F.col(f"doc_id.rest.`{c}`") for c in rest}
    if "n_chars" in kept:
        changed = F.col("text").contains("[SECRET]")
        kept["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(kept["n_chars"])
    return clean.select(*[text.alias("text") if c == "text" else kept[c].alias(c) for c in docs.columns])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, the three best segmentations and the round trip of every text."""
    configure(spark)
    return encode(docs, n=3)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, step in STAGES:
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


@R.add(ORACLE_SQL)
def pipeline(t: Tables) -> DataFrame:
    """All five stages over all documents."""
    return run(t.spark, t.folder)
