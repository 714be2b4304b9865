"""Quality rules judged by host: a host most of whose documents fail a rule loses all of its documents.

Four rules are measured on every whole text. Failures are counted per host, and a host's rate is shrunk towards the rate
of all hosts with a beta prior that is fitted to the hosts themselves, so that a host of two bad documents isn't judged
like one of two thousand. DataFrame functions only: each text is measured in its own row, and what is shuffled are
counts per host.

Null texts count as empty, a null host as the host ''. Rows are judged one by one, so repeated and null ids are no
special case. With no spread between the hosts beyond chance every host has the common rate. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.session import stage

# The bounds of the rules.
LEAST_WORDS = 10
WINDOW = 5  # words
REPEAT_PERCENT = 20  # of a text's words, in windows that occur more than once
SYMBOLS = "[#*$%&|<>]"
SYMBOL_PERCENT = 10  # symbols per word
LINE_PERCENT = 30  # of the lines with a word, equal to an earlier one
WORD_CHARS = (2, 12)  # mean characters of a word

HOST_LIMIT = 0.5  # a host with a higher shrunk rate of failures of a rule is rejected

_SPACE = r"[\x20\x09-\x0D]+"
_NOT_SPACE = r"[^\x20\x09-\x0D]"


def rules() -> dict[str, Column]:
    """Name and failure of each rule, from the columns of ``measures``."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "base": (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * n,
        "lines": 100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"),
        "lengths": (chars < WORD_CHARS[0] * n) | (chars > WORD_CHARS[1] * n),
    }


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, although it is named several times in it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _twins(pairs: Column, field: str) -> Column:
    """The elements of a sorted array of structs that share a field's value with a neighbour."""

    def twin(all_pairs: Column) -> Column:
        return F.filter(
            all_pairs, lambda x, k: F.get(all_pairs, k - 1)[field].eqNullSafe(x[field]) | F.get(all_pairs, k + 1)[field].eqNullSafe(x[field])
        )

    return _let(pairs, twin)


def _covered(windows: str, words: str) -> Column:
    """Words in windows that occur more than once: hashes name the candidates, their words decide."""
    hashed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    spelled = F.transform(
        _twins(hashed, "h"), lambda x: F.struct(F.array_join(F.slice(words, x["i"] + 1, F.lit(WINDOW)), " ").alias("w"), x["i"].alias("i"))
    )
    starts = F.sort_array(F.transform(_twins(F.sort_array(spelled), "w"), lambda x: x["i"]))
    steps = _let(starts, lambda at: F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: its host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines."""
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", "host", F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.array_remove(F.split("text", _SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(_NOT_SPACE)).alias("lines"),
    )
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    window = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW))))
    rows = rows.withColumn("windows", F.when(F.size("words") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    # most texts have no window twice, which takes one pass to see
    repeats = F.when(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(0).cast("long")).otherwise(_covered("windows", "words"))
    n_lines = F.size("lines").cast("long")
    return rows.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (n_lines - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), repeats.alias("n_repeat_words"), n_lines.alias("n_lines"),
    )


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n, one shrunk rate of failures per rule).

    Hosts' failures are taken as beta-binomial. The common rate is that of all documents; the hosts' correlation rho, by
    moments, says how far apart hosts are beyond chance, and a host's rate is (rho k + (1 - rho) rate) / (rho n + 1 - rho).
    """
    names = list(rules())
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(failed.cast("long")).alias(f"k_{name}") for name, failed in rules().items()))
    hosts = stage(hosts, "hosts")
    # one row with a few sums
    sums = [F.sum(f"k_{name}").alias(f"k_{name}") for name in names] + [F.sum(F.col(f"k_{name}").cast("double") * F.col(f"k_{name}") / F.col("n")).alias(f"s_{name}") for name in names]
    n = F.col("n").cast("double")
    total = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), *sums).first()
    if not total["hosts"]:
        return hosts.select("host", "n", *(F.lit(0.0).alias(name) for name in names))

    def shrunk(name: str) -> Column:
        rate = total[f"k_{name}"] / total["n"]
        chance, spread = rate * (1 - rate), total["n"] - total["nn"] / total["n"] - (total["hosts"] - 1)
        between = total[f"s_{name}"] - total[f"k_{name}"] * rate
        rho = min(1.0, max(0.0, (between - (total["hosts"] - 1) * chance) / (chance * spread))) if chance * spread > 0 else 0.0
        return (rho * F.col(f"k_{name}") + (1 - rho) * rate) / (rho * n + (1 - rho))

    return hosts.select("host", "n", *(shrunk(name).alias(name) for name in names))


def judge_documents(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: its measures, base_failed, host_rejected and kept."""
    measured = stage(measures(docs, host), "measures")
    rejected = host_rates(measured).where(F.greatest(*rules()) > host_limit).select(F.col("host").alias("rejected"))
    judged = measured.join(rejected, F.col("host") == F.col("rejected"), "left")
    bad = F.col("rejected").isNotNull()
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rules()["base"].alias("base_failed"),
        (~rules()["base"] & ~bad).alias("kept"), "n_lines", bad.alias("host_rejected"),
    )
