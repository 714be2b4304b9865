"""The corpus pipeline: documents of low quality go, then exact and near copies, then benchmark passages; the rest is
mixed to target weights. Every stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.common import join_texts, prepare, read_table
from tallybook.llm.decontaminate import decontaminate
from tallybook.llm.exact_dedup import exact_dedup, normalised
from tallybook.llm.mixing import mix_sources, repeat_documents
from tallybook.llm.quality import quality_scores
from tallybook.llm.simhash import simhash_dedup
from tallybook.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``row``: the id where it stands for one text, else a number from id and text."""
    docs = docs.select(*COLUMNS)
    text = F.coalesce("text", F.lit(""))
    texts = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("low"), F.max(F.xxhash64(text)).alias("high"))
    several = stage(texts.filter("low != high").select(F.col("doc_id").alias("several")), "several")
    # a null id meets its text's hash instead, so that rows without an id don't fall in one task
    found = docs.join(several, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)) == F.col("several"), "left")
    own = F.col("doc_id").isNotNull() & F.col("several").isNull()
    row = F.when(own, F.col("doc_id").cast("long")).otherwise(F.xxhash64(F.lit("row"), "doc_id", F.sha2(text, 256)))
    return found.withColumn("row", row).drop("several")


def _as_documents(rows: DataFrame) -> DataFrame:
    """Numbered rows as a documents table whose id is the row's number."""
    return rows.drop("doc_id").withColumnRenamed("row", "doc_id")


def _keep(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The numbered rows that were found, in the columns of documents."""
    return join_texts(rows, found.select(F.col("doc_id").alias("row")).distinct(), ["row"], "left_semi").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    prepare(spark)
    rows = _numbered(docs)
    return _keep(rows, quality_scores(_as_documents(rows), read_table(spark, sf_dir, "labels")).filter("predicted = 1"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one that stays; of rows that repeat its id and text the longest."""
    prepare(spark)
    kept = exact_dedup(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("digest")).distinct()
    rows = docs.select(*COLUMNS).withColumn("digest", F.sha2(normalised(F.coalesce("text", F.lit(""))), 256))
    rows = join_texts(rows, kept, ["doc_id", "digest"], "left_semi")
    rest = [c for c in COLUMNS if c != "doc_id"]
    longest = rows.groupBy("doc_id", "digest").agg(F.max(F.struct(F.length("text").alias("length"), *rest)).alias("row"))
    return longest.select("doc_id", *(F.col(f"row.{c}").alias(c) for c in rest))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by fingerprints of four-word shingles that differ in at most four bits, the document
    with the smallest id; of those without an id, or under one id, the one with the smallest number."""
    prepare(spark)
    rows = _numbered(docs)
    return _keep(rows, simhash_dedup(_as_documents(rows), words=4, distance=4).filter("doc_id = component_id"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    prepare(spark)
    rows = _numbered(docs)
    return _keep(rows, decontaminate(_as_documents(rows), read_table(spark, sf_dir, "benchmark")).filter("not contaminated"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that enter the mixture, once each, weighted by rate; copies is the whole number ``run`` repeats by."""
    prepare(spark)
    rows = _numbered(docs)
    mixed = mix_sources(_as_documents(rows)).filter("rate > 0").select(F.col("doc_id").alias("row"), "tokens", "domain", "rate", "copies").distinct()
    return join_texts(rows, mixed, ["row"], "inner").drop("row")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources", mixture),
]

# The classifier, the fingerprints and the rates are not SQL: the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written to the shared folder and read again, and the rows of the mixture.

    The last stage weighs documents; here each is repeated by its copies, so that the rows have the target shares.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return repeat_documents(docs)
