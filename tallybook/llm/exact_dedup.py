"""Exact duplicates by an extendible-hash index: buckets split by directory doubling, owners compare bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import join_texts, keyed, original_id
from tallybook.session import stage

BUCKET_ROWS = 4096  # distinct hashes that one bucket holds before it splits
COMBINE_BYTES = 16 << 20  # texts that a task remembers while it merges copies before the shuffle

_ENTRY = "h long, digest string, body binary, chars long, doc_id long, copies long"
_CLASS = "bucket long, h long, digest string, chain int, keep_id long, group_size long"


def normalised(text: Column) -> Column:
    """The text without the characters space and U+0009 to U+000D."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def directory(hashes: DataFrame, bucket_rows: int) -> DataFrame:
    """The directory (cell, bucket): doubled until every bucket holds at most ``bucket_rows`` distinct hashes.

    A cell is the hash's first ``bits`` bits, the deepest level. At depth d the directory has 2^d buckets; a cell
    belongs to the bucket of the smallest depth at which its bucket is not overfull. Buckets that are overfull at
    the deepest level stay so; their rows are only more in one task.
    """
    distinct = hashes.distinct()
    bits = max(0, math.ceil(math.log2(max(1, distinct.count()) / bucket_rows))) + 6
    cells = stage(distinct.select(cell(F.col("h"), bits).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")), "cells")
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {bits} - depth)")
    )
    fitting = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("rows")).filter((F.col("rows") <= bucket_rows) | (F.col("depth") == bits))
    chosen = levels.join(fitting, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix")).alias("at"))
    # a bucket's number: its prefix behind a leading one, so that depths don't mix
    return chosen.select("cell", F.expr("shiftleft(1L, at.depth) + at.prefix").alias("bucket"), F.lit(bits).alias("bits"))


def cell(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge copies that a task sees into one row, so that a text copied a million times travels once a task."""
    seen: dict[tuple, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(k[0], k[1], *v) for k, v in seen.items()]
        names = ["h", "digest", "body", "chars", "doc_id", "copies"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("h", "digest", "body", "chars", "doc_id")]
        for h, digest, body, chars, doc_id in zip(*columns, strict=True):
            entry = seen.get((h, digest))
            if entry is None or entry[0] != body:
                if entry is not None or size > COMBINE_BYTES:
                    yield flush()
                    seen, size = {}, 0
                seen[h, digest] = [body, chars, doc_id, 1]
                size += len(body) + 200
            else:
                if (chars, -doc_id) > (entry[1], -entry[2]):
                    entry[1:3] = chars, doc_id
                entry[3] += 1
    if seen:
        yield flush()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's key range in the order of (bucket, h): chains of texts with the same hash, told apart by bytes."""
    key, chain, out = None, [], []

    def close() -> None:
        out.extend((*key, digest, place, doc_id, copies) for place, (_, digest, _, doc_id, copies) in enumerate(chain))

    def written() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        names = ["bucket", "h", "digest", "chain", "keep_id", "group_size"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("bucket", "h", "digest", "body", "chars", "doc_id", "copies")]
        for bucket, h, digest, body, chars, doc_id, copies in zip(*columns, strict=True):
            if (bucket, h) != key:
                if key is not None:
                    close()
                key, chain = (bucket, h), []
            entry = next((e for e in chain if e[0] == body), None)
            if entry is None:
                chain.append([body, digest, chars, doc_id, copies])
            else:
                if (chars, -doc_id) > (entry[2], -entry[3]):
                    entry[2:4] = chars, doc_id
                entry[4] += copies
        if len(out) > 5000:
            yield written()
            out = []
    if key is not None:
        close()
    if out:
        yield written()


def build_index(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The index, written to the shared folder: one row per distinct text with its bucket, chain and kept row."""
    body = normalised(F.col("text"))
    rows = docs.select(
        F.xxhash64(body).alias("h"), F.sha2(body, 256).alias("digest"), body.cast("binary").alias("body"),
        F.length("text").cast("long").alias("chars"), "doc_id",
    )
    where = stage(directory(docs.select(F.xxhash64(body).alias("h")), bucket_rows), "directory")
    bits = where.select("bits").first()
    bits = bits.bits if bits else 0
    entries = rows.mapInArrow(_combine, _ENTRY).withColumn("cell", cell(F.col("h"), bits))
    owned = entries.join(where.drop("bits"), "cell").repartition("bucket").sortWithinPartitions("bucket", "h")
    return stage(owned.select("bucket", "h", "digest", "body", "chars", "doc_id", "copies").mapInArrow(_own, _CLASS), "index")


def exact_dedup(documents: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (space, U+0009 to U+000D). Of equal texts the row with the
    most code points, then the smallest doc_id stays. A null text counts as empty, a null doc_id as the smallest;
    rows that repeat a doc_id count as copies in group_size and share its keep decision. Other columns are ignored.
    """
    docs = keyed(documents)
    index = build_index(docs, bucket_rows).filter("group_size > 1").select("h", "digest", "keep_id", "group_size")
    body = normalised(F.col("text"))
    rows = docs.select("doc_id", F.xxhash64(body).alias("h"), F.sha2(body, 256).alias("digest"))
    found = join_texts(rows, index, ["h", "digest"])
    keep = F.coalesce("keep_id", "doc_id")
    return found.select(
        original_id(), F.when(keep != F.lit(-(1 << 63)), keep).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (keep == F.col("doc_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )
