"""URL filters: a blocked Bloom filter of the listed URLs, then an exact hash join on what passes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import join_texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # 64-bit words in a block of the filter; a key sets one bit in each
BITS_PER_KEY = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Canonical host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    spread = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(spread, 6 * w).bitwiseAND(F.lit(63))).cast("int")) for w in range(WORDS)]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table: a block number and its words."""
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def possible_hits(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of ``keys`` whose key the blocked Bloom filter of ``listed`` lets pass: one probe of one block."""
    blocks = max(1, -(-listed.count() * BITS_PER_KEY // (64 * WORDS)))
    table = bloom_blocks(listed, blocks)
    probed = keys.withColumn("block", _block(F.col("key"), blocks)).join(table, "block")
    passing = F.lit(True)
    for i, bit in enumerate(_bits(F.col("key"))):
        passing = passing & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    return probed.filter(passing).drop("block", *(f"w{i}" for i in range(WORDS)))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict.

    ``rules`` has host, path and verdict; a rule fits its host and all subdomains if the path starts with the
    rule's. The longest fitting rule wins (of equally long ones, the longer host); rows that no rule fits get
    ``default``. A null url, or one without ``://``, has empty host and path. Repeated rows stay; a rule given
    twice counts once, with the smaller verdict. Columns named like the added ones are replaced.

    The keys of a url are its host suffixes joined to its path prefixes, only as long as listed ones are. Each
    distinct key is probed once, so a hot host costs no more than a rare one.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    judged = pages.drop("host", "path", "rule", "verdict").withColumns({"__host": host, "__path": path})
    listed = (
        rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
        .filter("rule_host is not null and verdict is not null")
        .groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))
        .withColumn("key", F.concat("rule_host", "rule_path"))
    )
    # the lengths that listed keys have: numbers bounded by the longest url, not by the list
    shape = listed.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    urls = judged.select("__host", "__path").distinct()
    if shape.labels is None:
        best = urls.select("__host", "__path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    else:
        labels = F.split("__host", r"\.")
        count = F.least(F.size(labels), F.lit(shape.labels))
        suffixes = F.transform(F.sequence(F.lit(1), count), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
        prefixes = F.array(*(F.lit(n) for n in shape.lengths))
        keys = (
            urls.select("__host", "__path", F.explode(suffixes).alias("suffix"))
            .select("__host", "__path", "suffix", F.explode(F.filter(prefixes, lambda n: n <= F.length("__path"))).alias("n"))
            .select("__host", "__path", F.concat("suffix", F.expr("substring(__path, 1, n)")).alias("key"))
        )
        passed = possible_hits(keys.select("key").distinct(), listed.select("key"))
        exact = passed.join(listed, "key")
        rank = F.struct(F.length("key"), F.length("rule_host"), F.col("key").alias("rule"), F.col("verdict").alias("verdict"))
        best = keys.join(exact, "key").groupBy("__host", "__path").agg(F.max(rank).alias("best")).select("__host", "__path", "best.rule", "best.verdict")
    return join_texts(judged, best, ["__host", "__path"]).withColumn("verdict", F.coalesce("verdict", F.lit(default))).withColumnsRenamed({"__host": "host", "__path": "path"})
