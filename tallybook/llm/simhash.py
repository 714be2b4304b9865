"""Near duplicates by SimHash: fingerprints embedded as bit counts of segments, joined on a grid, then verified."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import LOWER, NO_ID, NOT_SPACE, chunks, components, join_texts, keyed, original_id, word_spans
from tallybook.session import stage

SEED = 42
CELL_ROWS = 2048  # a larger grid cell is compared in blocks of about this size
BUFFER_ROWS = 1 << 16


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp): bit k is 1 if it is 1 in over half of the hashes of the text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.zeros(len(batch), np.uint64)
            for chunk in chunks(batch.column("text")):
                data = LOWER[chunk.data]
                starts, ends, owner = word_spans(data, chunk.offsets, NOT_SPACE)
                spaced, at = _spaced(data, starts, ends)
                lengths = ends - starts + 1
                stops = np.cumsum(lengths) - 1
                first = np.searchsorted(owner, np.arange(len(chunk.rows) + 1))
                for row, a, b in zip(chunk.rows, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if a < b:
                        last = max(a + 1, b - words + 1)
                        begin, end = at[a:last].tolist(), stops[np.minimum(np.arange(a, last) + words - 1, b - 1)].tolist()
                        prints[row] = _majority([xxhash.xxh64_intdigest(spaced[i:j], SEED) for i, j in zip(begin, end, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words joined by one space, and where each begins."""
    lengths = ends - starts
    at = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1] + 1, out=at[1:])
    out = np.full(int(lengths.sum()) + len(starts), 0x20, np.uint8)
    shift = np.repeat(at - starts, lengths)
    place = np.arange(len(shift)) + np.repeat(at - np.cumsum(lengths) + lengths, lengths)
    out[place] = data[place - shift]
    return out.tobytes(), at


def _majority(hashes: list[int], block: int = 1 << 16) -> np.uint64:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        values = np.array(hashes[at : at + block], np.dtype("<u8"))
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def segment_counts(fp: Column) -> Column:
    """The embedding: the number of ones in each of the 32 two-bit segments, two bits a count.

    The Manhattan distance of two embeddings never exceeds the number of differing bits: a flipped bit moves one
    count by one.
    """
    even = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


def grid_cells(prints: DataFrame, distance: int, agree: int) -> DataFrame:
    """The range join's grid: the counts form ``distance + agree`` coordinates of neighbouring segments.

    Within Manhattan distance ``distance`` at most that many coordinates differ, so at least ``agree`` are equal:
    a row goes to one cell for every choice of ``agree`` coordinates, and every pair within range shares a cell.
    """
    groups = distance + agree
    edges = [2 * (32 * g // groups) for g in range(groups + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    choices = [sum(c) for c in itertools.combinations(masks, agree)]
    signed = [m - (1 << 64) if m >> 63 else m for m in choices]
    counts = segment_counts(F.col("fp"))
    cells = F.array(*(F.xxhash64(F.lit(i), counts.bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)))
    return prints.select("fp", F.explode(cells).alias("cell"))


def blocks_of_cells(cells: DataFrame, cell_rows: int) -> DataFrame:
    """Split cells above ``cell_rows`` rows: rows fall in k parts, and each pair of parts meets once."""
    large = cells.groupBy("cell").count().filter(F.col("count") > cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("k"))
    part = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    dealt = cells.join(large, "cell", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("part", part)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return dealt.select("fp", F.when(F.col("k") == 1, F.col("cell")).otherwise(F.xxhash64("cell", low, high)).alias("cell"))


def _star_links(rows: list[np.ndarray], distance: int) -> pa.RecordBatch:
    """Links within cells: each row to the first row of its cell that it reaches, so a cell of n rows gives under n."""
    fp, cell = rows
    head = np.arange(len(fp))
    active, step, pairs = head, 1, []
    while len(active):
        active = active[active + step < len(fp)]
        active = active[cell[active] == cell[active + step]]
        near = active[np.bitwise_count(fp[active] ^ fp[active + step]) <= distance]
        if len(near):
            pairs.append((near, near + step))
        step += 1
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:
            before = head
            low = np.minimum(head[a], head[b])
            head = head.copy()
            np.minimum.at(head, a, low)
            np.minimum.at(head, b, low)
            head = head[head]
            if np.array_equal(head, before):
                break
    linked = np.flatnonzero(head != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[head[linked]].view(np.int64))], ["a", "b"])


def links(prints: DataFrame, distance: int = 4, agree: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints within ``distance`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column("fp").to_numpy().view(np.uint64), batch.column("cell").to_numpy()])
            if sum(len(h[0]) for h in held) >= BUFFER_ROWS:
                fp, cell = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = np.searchsorted(cell, cell[-1])  # the last cell may go on
                if whole:
                    yield _star_links([fp[:whole], cell[:whole]], distance)
                held = [[fp[whole:], cell[whole:]]]
        if held:
            yield _star_links([np.concatenate(x) for x in zip(*held, strict=True)], distance)

    cells = blocks_of_cells(grid_cells(prints, distance, agree), cell_rows)
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def simhash_dedup(documents: DataFrame, words: int = 4, distance: int = 4, agree: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per row of ``documents``: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Words are runs of other than white space, A-Z lower-cased; shingles of ``words`` words, repeats included. A text
    of fewer words is one shingle, one without words (also null) has fingerprint zero, linked like any other. Two
    fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest doc_id reachable. A null
    doc_id counts as the smallest; repeated rows get the same result. Equal fingerprints are joined first, so copies
    add no links. ``agree`` trades rows against comparisons and never changes the result.
    """
    prints = stage(fingerprints(keyed(documents), words), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "distinct")
    linked = components(links(distinct.select("fp"), distance, agree, cell_rows))
    grouped = join_texts(distinct, linked.select(F.col("node").alias("fp"), "root"), ["fp"]).withColumn("root", F.coalesce("root", "fp"))
    lowest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("members")).filter("members > 1")
    named = grouped.join(lowest, "root").select("fp", "component_id")
    found = join_texts(prints, named, ["fp"])
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        original_id(), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(component != NO_ID, component).alias("component_id")
    )
