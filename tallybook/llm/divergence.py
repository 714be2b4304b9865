"""How far the sources of a language differ in their words, and by which terms.

Every language keeps the terms of at least ``least_documents`` of its documents. A term's rate in a group (language and
source) or in a language is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), with N the sum of counts of kept terms and V
their number; two rates differ by f = floor((p - q)^2 / (p + q)). Whole numbers throughout.

* Terms of a group by f against their language: f depends on the two counts alone. So terms are counted in cells of
  (group count, language count), f is evaluated once a cell, cells of one value are merged and ranked by cumulative
  multiplicity, and only the cells that reach the first ranks are expanded again, in UTF-8 order.
* Pairs of sources by the sum of f over all kept terms, in neither of them too: terms are dealt into blocks of bounded
  size with the groups' totals, sources into tiles, and a task holds the counts of one block for two tiles. A block gives
  one partial sum a pair.

Null texts, languages and sources count as empty. Every row is a document, repeated ids too; all rows are counted. A
language without kept terms has value 0 for every pair, one with a single source no pair. Ties go by the item's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import LOWER, byte_class, chunks, word_spans
from tallybook.session import stage

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
BLOCK_TERMS = 512  # kept terms in a block of the pair sums
TILE_SOURCES = 256  # sources whose counts a task holds, twice
HELD_ROWS = 1 << 19  # counted terms that a task holds before it hands them on

SCALE = 1_000_000_000
_LETTER = byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_KEYS = ["lang", "source", "term"]
_SUMS = "lang string, source string, item string, value long, summed long, terms long, neither long"


def _chunk_counts(data: np.ndarray, offsets: np.ndarray, lang: pa.Array, source: pa.Array) -> pa.Table:
    """Terms of some texts with their occurrences and documents per language and source."""
    data = LOWER[data]
    starts, ends, text = word_spans(data, offsets, _LETTER)
    ends_of = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=ends_of[1:])
    letters = np.ascontiguousarray(data[_LETTER[data]])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends_of), pa.py_buffer(letters)]).dictionary_encode()
    terms, code = words.dictionary.cast(pa.string()), words.indices.to_numpy()
    size = max(1, len(terms))
    in_text, n = np.unique(text * size + code, return_counts=True)
    seen: dict[tuple[str, str], int] = {}
    group = np.array([seen.setdefault(g, len(seen)) for g in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int64)
    of_group, place = np.unique(group[in_text // size] * size + in_text % size, return_inverse=True)
    names = list(seen)
    return pa.table({
        "lang": pa.array([g[0] for g in names], pa.string()).take(pa.array(of_group // size)),
        "source": pa.array([g[1] for g in names], pa.string()).take(pa.array(of_group // size)),
        "term": terms.take(pa.array(of_group % size)),
        "n": pa.array(np.bincount(place, n, len(of_group)).astype(np.int64)),
        "docs": pa.array(np.bincount(place, minlength=len(of_group)).astype(np.int64)),
    })


def _merged(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for chunk in chunks(batch["text"]):
            lang, source = (batch[c].slice(chunk.rows.start, len(chunk.rows)) for c in ("lang", "source"))
            found = _chunk_counts(chunk.data, chunk.offsets, lang, source)
            held.append(found)
            rows += found.num_rows
            if rows > 2 * HELD_ROWS:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS:
                    yield from held[0].to_batches(max_chunksize=10_000)
                    held, rows = [], 0
    if rows:
        yield from _merged(held).to_batches(max_chunksize=10_000)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, dealt by language and term.

    A task sums what it reads, so that a term comes at most once from each task and source.
    """
    found = _named(docs).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.repartition("lang", "term").groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _rate(count: str, total: str) -> Column:
    return F.expr(f"1 + (cast({SCALE} as decimal(20,0)) * ({count} + 2)) div ({total} + 2 * v)")


def _difference() -> Column:
    return F.expr("((p - q) * (p - q)) div (p + q)")


class Counted:
    """Staged counts of a table: ``terms`` (lang, source, term, n, n_lang) of kept terms with n > 0 and ``groups`` (lang,
    source, place, total, n_lang, v): every group with its place among the language's sources and its sums."""

    def __init__(self, docs: DataFrame, least_documents: int = LEAST_DOCUMENTS):
        of_term = Window.partitionBy("lang", "term")  # a row per source; the rows lie where they were dealt
        found = term_counts(docs).withColumns({"n_lang": F.sum("n").over(of_term), "in_lang": F.sum("docs").over(of_term)})
        self.terms = stage(found.where(F.col("in_lang") >= least_documents).select(*_KEYS, "n", "n_lang"), "kept-terms")
        totals = self.terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        kept = self.terms.groupBy("lang", "term").agg(F.max("n_lang").alias("n_lang"))
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
        found = _named(docs).select("lang", "source").distinct()
        place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
        groups = found.select("lang", "source", place).join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        self.groups = stage(groups.na.fill(0, ["total", "v", "total_lang"]), "groups")


def ranked_terms(counted: Counted, top: int = TOP_TERMS) -> DataFrame:
    """Part ``term``: the first terms of each group that are more frequent there than in its language."""
    group = ["lang", "source"]
    cells = counted.terms.groupBy(*group, "n", "n_lang").agg(F.count("*").alias("many"))
    cells = cells.join(counted.groups, group).withColumns({"p": _rate("n", "total"), "q": _rate("n_lang", "total_lang")}).where("p > q")
    cells = stage(cells.select(*group, "n", "n_lang", "many", _difference().alias("value")), "cells")
    # a value has at least one term, so the first ranks lie in the first values
    falling = Window.partitionBy(*group).orderBy(F.col("value").desc())
    values = cells.groupBy(*group, "value").agg(F.sum("many").alias("many")).withColumn("at", F.row_number().over(falling)).where(F.col("at") <= top)
    before = F.coalesce(F.sum("many").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).where(F.col("before") < top).select(*group, "value", "before")
    terms = counted.terms.join(cells.join(values, [*group, "value"]), [*group, "n", "n_lang"])
    place = F.row_number().over(Window.partitionBy(*group, "value").orderBy("term"))
    terms = terms.withColumn("at", place).where(F.col("at") <= top)  # tasks keep the first of a value before they send them
    rank = (F.col("before") + F.col("at")).cast("int")
    return terms.select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank.alias("rank")).where(F.col("rank") <= top)


def _pair_sums(table: pa.Table, tile_sources: int) -> pa.Table:
    """Sums over one block of terms for the pairs of two tiles of sources; a row without a term names a source.

    Terms that none of these sources has are not among the rows: with each pair comes the number of terms summed, the
    number of all terms and the value of a term in neither source.
    """
    sources = table.filter(pc.is_null(table["term"])).sort_by("place").to_pydict()
    found = table.filter(pc.is_valid(table["term"]))
    place = np.array(sources["place"], np.int64)
    codes = found["term"].combine_chunks().dictionary_encode()
    code = codes.indices.to_numpy()
    kind = object if max(sources["total"], default=0) > (1 << 62) // SCALE else np.int64  # whole numbers of any size, if need be
    counts = np.zeros((len(codes.dictionary), len(place)), kind)
    counts[code, np.searchsorted(place, found["place"].to_numpy())] = found["n"].to_numpy()
    total = np.array([n + 2 * v for n, v in zip(sources["total"], sources["v"], strict=True)], kind)
    rates = 1 + SCALE * (counts + 2) // np.maximum(total, 1)
    absent = 1 + SCALE * 2 // np.maximum(total, 1)
    tile = place // tile_sources
    out: dict[str, list] = {"lang": [], "source": [], "item": [], "value": [], "summed": [], "terms": [], "neither": []}
    for i in range(len(place)):
        others = np.arange(i + 1, len(place))
        if tile[0] != tile[-1]:  # two tiles: pairs within one of them are another task's
            others = others[tile[others] != tile[i]]
        p, q = rates[:, i : i + 1], rates[:, others]
        sums = ((p - q) * (p - q) // (p + q)).sum(axis=0)
        out["lang"] += [sources["lang"][i]] * len(others)
        out["source"] += [sources["source"][i]] * len(others)
        out["item"] += [sources["source"][j] for j in others]
        out["value"] += [int(x) for x in sums]
        out["summed"] += [len(counts)] * len(others)
        out["terms"] += [sources["v"][i]] * len(others)
        out["neither"] += [int(x) for x in (absent[i] - absent[others]) ** 2 // (absent[i] + absent[others])]
    return pa.table(out, pa.schema([(c, pa.string() if c in ("lang", "source", "item") else pa.int64()) for c in out]))


def ranked_pairs(counted: Counted, block_terms: int = BLOCK_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """Part ``pair``: every other source of the language."""
    blocks = F.ceil(F.greatest(F.col("v"), F.lit(1)) / block_terms)
    tiles = F.floor(F.max("place").over(Window.partitionBy("lang")) / tile_sources)
    groups = counted.groups.withColumns({"blocks": blocks, "tiles": tiles})
    fields = ["lang", "source", "place", "total", "v", "tiles"]
    heads = groups.select(*fields, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    counts = counted.terms.select("lang", "source", "term", "n").join(groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    rows = heads.unionByName(counts.select(*heads.columns))
    own = F.floor(F.col("place") / tile_sources)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "tiles")))
    # with several tiles, a tile alone is the pair of the tile with itself
    rows = rows.withColumns({"low": F.least(own, "other"), "high": F.greatest(own, "other")}).drop("tiles", "other")
    sums = rows.groupBy("lang", "block", "low", "high").applyInArrow(lambda table: _pair_sums(table, tile_sources), _SUMS)
    unseen = (F.max("terms") - F.sum("summed")) * F.max("neither")
    pairs = sums.groupBy("lang", "source", "item").agg((F.sum("value") + unseen).alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("pair")
    pairs = pairs.select("lang", both, "value").select("lang", "pair.source", "pair.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    counted = Counted(docs, least_documents)
    return ranked_pairs(counted).unionByName(ranked_terms(counted, top))
