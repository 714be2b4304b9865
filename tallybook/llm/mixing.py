"""Mixing to target weights: soft domain memberships, and document rates fitted by projected gradient steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import original_id
from tallybook.session import stage

# Letters that are counted as features: the basic ones, frequent ones first, and the marked ones of the languages at hand.
LETTERS = "eniatrsodlhucmgbpfvwkzyqjxäöüßéèêçàùâîôñáíóú"
SPREAD = 200  # letters that a text counts as at most when its memberships are found
STEPS = 60  # gradient steps at most
TOLERANCE = 1e-6  # stop when every domain's total is this close to its target, relative to the budget


def _sizes(text: Column) -> Column:
    """Bytes of a text without spaces, then without the first letter too, and so on: each pass reads what the last one left."""
    start = F.struct(F.replace(text, F.lit(" "), F.lit("")).alias("rest"), F.array().cast("array<int>").alias("sizes"))

    def without(so_far: Column, letter: Column) -> Column:
        return F.struct(F.replace(so_far["rest"], letter, F.lit("")).alias("rest"), F.array_append(so_far["sizes"], F.octet_length(so_far["rest"])).alias("sizes"))

    letters = F.array(*(F.lit(letter) for letter in LETTERS))
    return F.aggregate(letters, start, without, lambda done: F.array_append(done["sizes"], F.octet_length(done["rest"])))


def letter_counts(documents: DataFrame, domain: str) -> DataFrame:
    """(doc_id, domain, tokens, counts): words of the whole text and how often each letter occurs."""
    lowered = F.lower(F.col("text"))
    docs = documents.withColumn("domain", F.col(domain).cast("string")).select("doc_id", "domain", "text")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "domain", F.coalesce("text", F.lit("")).alias("text"))
    tokens = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = F.col("sizes")
    counts = (((sizes[i] - sizes[i + 1]) / len(letter.encode())).cast("long") for i, letter in enumerate(LETTERS))
    return docs.select("doc_id", "domain", tokens.alias("tokens"), _sizes(lowered).alias("sizes")).select("doc_id", "domain", "tokens", F.array(*counts).alias("counts"))


def membership_table(counts: DataFrame) -> DataFrame:
    """The classifier: per labelled domain its log share of rows and the log share of every letter in its texts."""
    sums = [F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(len(LETTERS))]
    totals = counts.filter("domain is not null").groupBy("domain").agg(F.count("*").alias("rows"), *sums)
    letters = [F.col(f"c{i}") for i in range(len(LETTERS))]
    whole = reduce(lambda a, b: a + b, letters) + len(LETTERS)
    return totals.select("domain", F.log(F.col("rows").cast("double")).alias("prior"), F.array(*(F.log((c + 1) / whole) for c in letters)).alias("weights"))


def memberships(counts: DataFrame, model: list) -> DataFrame:
    """(doc_id, tokens, p): the posterior of every domain of the model, in its order.

    A text's letters count at most as ``SPREAD`` independent draws, so that long texts keep soft memberships.
    """
    letters = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    damp = F.least(F.lit(1.0), F.lit(SPREAD) / F.greatest(letters, F.lit(1)))
    rows = counts.withColumn("damp", damp)
    score = [
        F.lit(m.prior) + F.col("damp") * reduce(lambda a, b: a + b, (F.col("counts")[i] * F.lit(w) for i, w in enumerate(m.weights)))
        for m in model
    ]
    rows = rows.select("doc_id", "tokens", F.array(*score).alias("score"))
    rows = rows.select("doc_id", "tokens", F.transform("score", lambda s: F.exp(s - F.array_max("score"))).alias("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", "tokens", F.transform("raw", lambda x: x / total).alias("p"))


def dot(a: Column, weights: list[float]) -> Column:
    return reduce(lambda x, y: x + y, (a[i] * F.lit(float(w)) for i, w in enumerate(weights)))


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS) -> tuple[DataFrame, list[float]]:
    """Nonnegative rates whose expected domain totals, the sums of rate x tokens x p, are closest to ``targets``.

    Projected gradient descent on the squared misses, each weighted by one over the domain's tokens. In the metric
    that weighs a document by its tokens, the Hessian's rows sum to one, so a step of length one never overshoots.
    A step adds the same vector of misses, seen through each document's memberships, and cuts at zero. A rate
    therefore follows from the vectors of all steps so far: every step is one pass of sums over (tokens, p), a few
    numbers come back, and nothing per document is kept between steps.
    """
    size = len(targets)
    expected = [F.sum(F.col("tokens") * F.col("p")[d]) for d in range(size)]
    have = [float(x or 0) for x in rows.agg(*expected).first()] if size else []
    budget = sum(targets) or 1.0
    rate = F.lit(1.0)
    totals = have
    for _ in range(steps):
        miss = [t - x for t, x in zip(targets, totals, strict=True)]
        if max((abs(m) for m in miss), default=0.0) <= TOLERANCE * budget:
            break
        move = [m / h if h > 0 else 0.0 for m, h in zip(miss, have, strict=True)]
        rows = rows.withColumn("rate", F.greatest(F.lit(0.0), (F.col("rate") if "rate" in rows.columns else rate) + dot(F.col("p"), move)))
        totals = [float(x or 0) for x in rows.agg(*(F.sum(F.col("tokens") * F.col("p")[d] * F.col("rate")) for d in range(size))).first()]
    if "rate" not in rows.columns:
        rows = rows.withColumn("rate", rate)
    return rows, totals


def mix_sources(documents: DataFrame, weights: dict[str, float] | None = None, domain: str = "lang", steps: int = STEPS) -> DataFrame:
    """Per row of ``documents``: doc_id, tokens, domain (most likely), membership (its posterior), rate, copies.

    ``weights`` maps domains to shares of the tokens of the mixture; without it every labelled domain gets the same.
    The mixture is the smallest in which no domain is thinned out: its budget is the largest ratio of a domain's
    expected tokens to its share. ``domain`` names the column with the known labels; rows where it is null, and all
    others, are placed by their letters alone. copies is the rate rounded up or down by a hash of the id, so that its
    expectation is the rate. A null text counts as empty and has no tokens; a null doc_id is kept; repeated rows get
    the same result. Without labelled rows all rates are 1 and domain is null. Other columns are ignored.
    """
    counts = stage(letter_counts(documents, domain), "letters")
    model = membership_table(counts).orderBy("domain").collect()  # one row per domain
    if weights is not None:
        model = [m for m in model if weights.get(m.domain, 0) > 0]
    if not model:
        bare = counts.select("doc_id", "tokens", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("membership"), F.lit(1.0).alias("rate"))
    else:
        share = [1 / len(model) if weights is None else weights[m.domain] / sum(weights[x.domain] for x in model) for m in model]
        rows = stage(memberships(counts, model), "memberships")
        have = rows.agg(*(F.sum(F.col("tokens") * F.col("p")[d]) for d in range(len(model)))).first()
        budget = max(float(h or 0) / s for h, s in zip(have, share, strict=True))
        fitted, _ = fit_rates(rows, [budget * s for s in share], steps)
        names = F.array(*(F.lit(m.domain) for m in model))
        top = F.array_position("p", F.array_max("p")).cast("int")
        bare = fitted.select("doc_id", "tokens", F.element_at(names, top).alias("domain"), F.array_max("p").alias("membership"), "rate")
    whole = F.floor("rate").cast("long")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    copies = whole + (chance < F.col("rate") - whole).cast("long")
    return bare.select(original_id(), "tokens", "domain", "membership", "rate", copies.alias("copies"))


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """The rows of the mixture: every row of ``mixed`` as often as its ``copies`` says, numbered by ``copy`` from 1."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
