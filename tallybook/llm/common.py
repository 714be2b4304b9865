"""Helpers shared by the operators: whole texts as byte arrays inside tasks, null-safe joins, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators.prefix import asc, running_totals
from tallybook.session import configure, stage

CHUNK_BYTES = 1 << 20  # texts are handled in groups of about this size, so that arrays stay small
NO_ID = -(1 << 63)  # stands for a null id inside the operators

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = tuple(np.uint64(n) for n in (30, 27, 31))
_FACTORS = tuple(np.uint64(n) for n in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for the operators: small Arrow batches, because rows hold whole documents."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text; a null key becomes the smallest one, a null text the empty one."""
    return frame.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias(key),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text),
    )


def numbered(docs: DataFrame) -> DataFrame:
    """The rows of ``keyed`` and ``copy``: 0 where the id is one row's alone, else the number of the text under its id.

    Rows that repeat an id and its text have the same number. With no repeated id this costs one count per id.
    """
    several = stage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("several")), "repeated-ids")
    none = F.lit(0).cast("long")
    if several.isEmpty():
        return docs.withColumn("copy", none)
    marked = docs.join(several, "doc_id", "left").withColumn("digest", F.when(F.col("several"), F.sha2("text", 256)))
    numbers = running_totals(marked.where("several").select("doc_id", "digest").distinct(), ["doc_id"], [asc("digest")], row_no="copy")
    found = marked.join(numbers, ["doc_id", "digest"], "left")
    return stage(found.select("doc_id", "text", F.coalesce("copy", none).alias("copy")), "numbered")


def original_id(column: str = "doc_id") -> Column:
    """The id as it was before ``keyed``."""
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


class Chunk(NamedTuple):
    """Some texts of an Arrow batch: their rows, all bytes in a row, and where each text starts."""

    rows: range
    data: np.ndarray
    offsets: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts in groups of at most ``limit`` bytes (a longer text alone)."""
    filled = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(filled):
        return
    _, offsets, data = filled.buffers()
    offsets = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(filled):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Chunk(range(at, end), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def byte_class(keep) -> np.ndarray:
    """A table of 256 flags from a test on byte values."""
    return np.fromiter((keep(b) for b in range(256)), bool, 256)


NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes in the class ``table``; no run crosses a text."""
    flag = table[data]
    starts, ends = flag.copy(), flag.copy()
    starts[1:] &= ~flag[:-1]
    ends[:-1] &= ~flag[1:]
    first, last = offsets[:-1], offsets[1:] - 1
    first, last = first[first < len(data)], last[last >= 0]
    starts[first], ends[last] = flag[first], flag[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    values = (values ^ (values >> _SHIFTS[0])) * _FACTORS[0]
    values = (values ^ (values >> _SHIFTS[1])) * _FACTORS[1]
    return values ^ (values >> _SHIFTS[2])


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    have = next((t for n, t in _powers.items() if n >= size), None)
    if have is None:
        size = max(size, CHUNK_BYTES + 4096)
        inverse = pow(int(_MULTIPLIER), -1, 1 << 64)
        tables = []
        for base in (int(_MULTIPLIER), inverse):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            tables.append(np.multiply.accumulate(powers))
        have = (tables[0], tables[1])
        if size <= 8 * CHUNK_BYTES:  # a table for a very long text is not kept
            _powers.clear()
            _powers[size] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULTIPLIER)


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive values, built by doubling."""
    parts, have, size = values, None, 1
    covered = 0
    rest = length
    while rest:
        if rest & 1:
            if have is None:
                have = parts
            else:
                count = len(values) - covered - size + 1
                have = mix(have[: max(count, 0)]) * _MULTIPLIER + parts[covered : covered + max(count, 0)]
            covered += size
        rest >>= 1
        if rest:
            parts = mix(parts[: max(len(parts) - size, 0)]) * _MULTIPLIER + parts[size:]
            size *= 2
    return mix(have)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[: max(len(values) - size, 0)], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: max(len(values) - rest, 0)], values[rest:]) if rest else values


def join_texts(frame: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys, nulls equal to nulls; the keys of ``other`` are dropped."""
    renamed = reduce(lambda f, k: f.withColumnRenamed(k, f"__{k}"), keys, other)
    condition = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    joined = frame.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"__{k}" for k in keys))


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size, 2^bits, with the bit named by the top bits of each value of column h.

    Its size never depends on the data; a fuller map only lets more rows through to the exact step behind it.
    """
    place = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return out


def in_bitmap(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(table).bit_length() + 5
    place = hashes >> np.uint64(64 - bits)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): one row (node, root) per node, root the smallest node.

    Alternates hooking every neighbour to the smallest one nearby (large star) and every smaller neighbour
    (small star). Nothing is collected but a row count and a checksum per round.
    """
    seen = None
    current = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("hub"), F.least("a", "low").alias("low"))
        large = both.join(low, F.col("a") == F.col("hub")).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "hub")
        small = large.join(low, F.col("a") == F.col("hub"))
        current = stage(
            small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b"))).filter("a != b").distinct(),
            "edges",
        )
        state = tuple(current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if state == seen:
            break
        seen = state
    return current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
