"""Licence scans: texts brought to a canonical form and looked up by digest among known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.common import join_texts

# Licence notices that are in common use, by SPDX identifier.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
]
# Spellings that count as equal, each on the right replaced by the one on the left.
SPELLINGS = [("license", "licence"), ("licensed", "licenced"), ("noncommercial", "non commercial"), ("version", "ver")]
COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}\n]*(copyright\b|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, spellings made equal, words separated by one space."""
    out = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, ""))
    out = F.replace(out, F.lit("&"), F.lit(" and "))
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for good, other in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {good} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "licence string, text string")


def scan_licences(documents: DataFrame, licences: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, whole (the licence that the entire text is, else null), n_lines (lines that
    are an entire known text), licences (the names found, sorted and joined by commas, empty if none).

    ``licences`` has licence and text. Texts are equal when their canonical forms have the same SHA-256 digest; forms
    without any word match nothing. Of several names for one form the smallest counts. A null text counts as empty, a
    null doc_id is kept, repeated rows get the same result. Other columns are ignored.

    Lines are looked up before anything is grouped, so only lines that are licences travel by document.
    """
    known = (
        licences.filter("licence is not null and text is not null and text != ''").withColumn("form", canonical(F.col("text"))).filter("form != ''")
        .groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("licence").alias("licence"))
    )
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line != ''").select("doc_id", digest(F.col("line")).alias("digest"))
    found = lines.join(known, "digest").groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set("licence").alias("names"))
    whole = rows.join(known.withColumnRenamed("licence", "whole"), "digest", "left").drop("digest")
    joined = join_texts(whole, found, ["doc_id"])
    names = F.array_sort(F.array_distinct(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.array().cast("array<string>")))))
    return joined.select(F.col("doc_id"), "whole", F.coalesce("n", F.lit(0).cast("long")).alias("n_lines"), F.array_join(names, ",").alias("licences"))
