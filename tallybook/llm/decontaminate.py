"""Benchmark decontamination: a set join of documents and item windows on each window's rarest shingle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import LOWER, NO_ID, bitmap, byte_class, chunks, in_bitmap, join_texts, keyed, numbered, original_id, run_hashes, span_hashes, word_spans
from tallybook.session import stage

WORD = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
TEXT = ["doc_id", "copy"]  # the key of a row
SHINGLE = 3  # words in a shingle; a window of fewer words is one shingle
FILTER_BITS = 22  # size of the bitmap of benchmark shingles, fixed


def _shingles(data: np.ndarray, offsets: np.ndarray, longest: int):
    """Words of a chunk and, for every shingle length, the hashes and a flag where the shingle stays in its text."""
    starts, ends, owner = word_spans(data, offsets, WORD)
    words = span_hashes(data, starts, ends)
    sizes = []
    for n in range(1, longest + 1):
        hashes = run_hashes(words, n) + np.uint64(n)
        sizes.append((hashes, owner[: len(hashes)] == owner[n - 1 :]))
    return starts, ends, owner, sizes


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words, n, shingles): each distinct window of an item with its shingles (h, at)."""
    longest = min(SHINGLE, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids = batch.column("item_id").to_pylist()
            for chunk in chunks(batch.column("text")):
                data = LOWER[chunk.data]
                starts, ends, owner, sizes = _shingles(data, chunk.offsets, longest)
                text = data.tobytes()
                first = np.searchsorted(owner, np.arange(len(chunk.rows) + 1)).tolist()
                for row, a, b in zip(chunk.rows, first[:-1], first[1:], strict=True):
                    found = [text[s:e].decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    n = min(window, b - a)
                    size = min(longest, n)
                    for at in range(b - a - n + 1 if n else 0):
                        hashes = sizes[size - 1][0][a + at : a + at + n - size + 1].view(np.int64).tolist()
                        out.append((ids[row], " ".join(found[at : at + n]), n, [{"h": h, "at": i} for i, h in enumerate(hashes)]))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["item_id", "words", "n", "shingles"])

    windows = items.mapInArrow(run, "item_id long, words string, n int, shingles array<struct<h: long, at: int>>")
    return windows.dropDuplicates(["item_id", "words"])


def shingle_counts(docs: DataFrame, known: np.ndarray, longest: int) -> DataFrame:
    """(h, count): how often each shingle that passes the bitmap occurs in all documents."""
    table = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for chunk in chunks(batch.column("text")):
                for hashes, whole in _shingles(LOWER[chunk.data], chunk.offsets, longest)[3]:
                    found.append(hashes[in_bitmap(table.value, hashes) & whole])
            values, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("count"))


def document_hits(docs: DataFrame, known: np.ndarray, longest: int, window: int) -> DataFrame:
    """(doc_id, copy, n_words, hits): where prefix shingles may occur, with the words around that a window can reach."""
    table = docs.sparkSession.sparkContext.broadcast(known)
    hit = pa.struct([("h", pa.int64()), ("at", pa.int32()), ("begin", pa.int32()), ("around", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits = np.zeros(len(batch), np.int64), [[] for _ in range(len(batch))]
            for chunk in chunks(batch.column("text")):
                data = LOWER[chunk.data]
                starts, ends, owner, sizes = _shingles(data, chunk.offsets, longest)
                text = data.tobytes()
                first = np.searchsorted(owner, np.arange(len(chunk.rows) + 1))
                counts[chunk.rows.start : chunk.rows.stop] = np.diff(first)
                for hashes, whole in sizes:
                    for i in np.flatnonzero(in_bitmap(table.value, hashes) & whole).tolist():
                        row = owner[i]
                        a, b = max(first[row], i - window + 1), min(first[row + 1], i + window)
                        around = " ".join(text[s:e].decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))
                        hits[chunk.rows[row]].append({"h": hashes[i].astype(np.int64), "at": i - first[row], "begin": a - first[row], "around": around})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(counts), pa.array(hits, pa.list_(hit))], ["doc_id", "copy", "n_words", "hits"])

    kind = "doc_id long, copy long, n_words long, hits array<struct<h: long, at: int, begin: int, around: string>>"
    return docs.select("doc_id", "copy", "text").mapInArrow(run, kind)


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """Word counts (doc_id, copy, n_words) and all occurrences (doc_id, copy, item_id, start, n) of item windows.

    Containment is exact, so the prefix of a window is one shingle: the one that is rarest in all documents. A window
    with a shingle that no document has is dropped there. Candidates must fit before and behind the shingle within
    the document (position and length), then all words of the window are compared.
    """
    longest = min(SHINGLE, window)
    windows = stage(item_windows(items, window), "windows")
    shingles = windows.select("item_id", "words", "n", F.explode("shingles").alias("s")).select("item_id", "words", "n", "s.h", "s.at")
    known = shingles.select("h").distinct()
    counts = stage(join_texts(shingle_counts(docs, bitmap(known, FILTER_BITS), longest), known, ["h"], "left_semi"), "rarity")
    rated = join_texts(shingles, counts, ["h"]).withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    prefix = rated.groupBy("item_id", "words", F.col("n").alias("size")).agg(F.min(F.struct("count", "h", "at")).alias("rarest")).filter("rarest.count > 0")
    prefix = stage(prefix.select("item_id", "words", "size", "rarest.h", F.col("rarest.at").alias("offset")), "prefix")
    hits = stage(document_hits(docs, bitmap(prefix.select("h").distinct(), FILTER_BITS), longest, window), "hits")
    found = hits.filter(F.size("hits") > 0).select(*TEXT, "n_words", F.explode("hits").alias("hit")).select(*TEXT, "n_words", "hit.*")
    start = F.col("at") - F.col("offset")
    fits = found.join(prefix, "h").withColumn("start", start).filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    text = F.array_join(F.slice(F.split("around", " "), F.col("start") - F.col("begin") + 1, F.col("size")), " ")
    return hits.select(*TEXT, "n_words"), fits.filter(text == F.col("words")).select(*TEXT, "item_id", "start", F.col("size").alias("n"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of 0-9, a-z (A-Z lower-cased) and all characters beyond ASCII. An item window is ``window``
    consecutive words, or all words of a shorter item; a document word inside any occurrence is hit. A null text has
    no words; an item without words has no window. Null ids count as one id of their own and print as an empty
    string in items_sha256. Rows that share an id or have none are judged by their own texts. Other columns are ignored.
    """
    docs, items = numbered(keyed(documents)), keyed(benchmark, "item_id")
    words, found = occurrences(docs, items, window)
    found = stage(found, "occurrences")
    name = F.when(F.col("item_id") == NO_ID, F.lit("")).otherwise(F.col("item_id").cast("string"))
    named = found.groupBy(*TEXT).agg(F.collect_set(name).alias("items"))
    # words hit: each interval counts from where the earlier ones end
    order = Window.partitionBy(*TEXT).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("start") + F.col("n")).over(order), F.lit(0))
    spans = found.select(*TEXT, "start", "n").distinct()
    spans = spans.withColumn("new", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", reach)))
    hit = spans.groupBy(*TEXT).agg(F.sum("new").cast("long").alias("n_hit"))
    per_document = named.join(hit, TEXT)
    joined = words.join(per_document, TEXT, "left")
    listed = F.coalesce(F.array_join(F.array_sort("items"), ","), F.lit(""))
    return joined.select(
        original_id(), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.array_size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
