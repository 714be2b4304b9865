"""Repeated byte strings across documents, found in suffix arrays built by induced sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import Chunk, chunks, keyed, mix, numbered, original_id
from tallybook.llm.segments import (
    Bodies, all_spans, covered, merged_spans, occurrences_across, packed_texts, repeated_keys, span_arrays, travelling_runs, unpacked,
)
from tallybook.llm.substring_dedup import same_bytes

GRAM = 16  # bytes in a minimiser
SHARD_BYTES = 2 << 20  # bytes of different strings that one suffix array is built over
BYTE_HASHES = mix(np.arange(1, 257, dtype=np.uint64))


def types_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one, and the starts that are leftmost of such a stretch."""
    n = len(text)
    decided = np.append(np.where(text[:-1] != text[1:], np.arange(n - 1), n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    smaller = np.append(text[:-1] < text[1:], True)[decided]
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, leftmost


def induce(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Place the leftmost-smaller suffixes in the given order and induce all others from them, bucket by bucket.

    Entries of a bucket are handled together: the suffixes one to the left of a batch are dealt to the buckets of their
    first symbols in the batch's order. A batch that adds to its own bucket is followed by one of what it added.
    """
    n, alphabet = len(text), len(edges) - 1
    array = np.full(n, -1, np.int32)
    first = text[leftmost]
    order = np.argsort(first, kind="stable")
    counts = np.bincount(first, minlength=alphabet)
    low = edges[1:] - counts
    array[np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(len(leftmost))] = leftmost[order]
    head, tail = edges[:-1].copy(), edges[1:].copy()

    def deal(batch: np.ndarray, kind: bool) -> None:
        left = batch[batch > 0] - 1
        left = left[smaller[left] == kind]
        if not len(left):
            return
        symbol = text[left]
        if len(left) > 1:
            by = np.argsort(symbol, kind="stable")
            left, symbol = left[by], symbol[by]
        begin = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        size = np.diff(np.append(begin, len(left)))
        rank = np.arange(len(left)) - np.repeat(begin, size)
        groups = symbol[begin]
        if kind:
            array[tail[symbol] - 1 - rank] = left
            tail[groups] -= size
        else:
            array[head[symbol] + rank] = left
            head[groups] += size

    used = np.flatnonzero(np.diff(edges)).tolist()
    for b in used:
        at = edges[b]
        while at < head[b]:
            batch, at = array[at : head[b]], head[b]
            deal(batch, False)
        if low[b] < edges[b + 1]:
            deal(array[low[b] : edges[b + 1]], False)
    for b in reversed(used):
        at = edges[b + 1]
        while tail[b] < at:
            batch, at = array[tail[b] : at][::-1], tail[b]
            deal(batch, True)
        if edges[b] < head[b]:
            deal(array[edges[b] : head[b]][::-1], True)
    return array


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``text`` in the order of their first ``depth`` symbols at least; the last symbol is the only 0.

    Induced sorting once orders the leftmost-smaller substrings. They get names in that order, and the string of
    names, a third as long, is solved by doubling: a round compares twice as many names, each of two symbols or more,
    until all differ or ``depth`` symbols are covered. A second induction from the sorted suffixes gives the array.
    """
    smaller, leftmost = types_of(text)
    edges = np.zeros(int(text.max()) + 2, np.int64)
    np.cumsum(np.bincount(text), out=edges[1:])
    isleft = np.zeros(len(text), bool)
    isleft[leftmost] = True
    sorted_parts = induce(text, smaller, leftmost, edges)
    sorted_parts = sorted_parts[isleft[sorted_parts]].astype(np.int64)
    # equal substrings share a name; each reaches to the next leftmost-smaller start
    length = np.zeros(len(text), np.int64)
    length[leftmost[:-1]] = np.diff(leftmost) + 1
    length[leftmost[-1]] = 1
    a, b = sorted_parts[:-1], sorted_parts[1:]
    differ = length[a] != length[b]
    todo, step = np.flatnonzero(~differ), 0
    while len(todo):
        todo = todo[length[a[todo]] > step]
        unequal = text[a[todo] + step] != text[b[todo] + step]
        differ[todo[unequal]] = True
        todo, step = todo[~unequal], step + 1
    name = np.zeros(len(text), np.int64)
    name[sorted_parts[1:]] = np.cumsum(differ)
    rank, span, covers = name[leftmost], 1, 2
    while rank.max() + 1 < len(rank) and covers < depth:
        following = np.append(rank[span:] + 1, np.zeros(min(span, len(rank)), np.int64))
        pair = rank * (len(rank) + 1) + following
        order = np.argsort(pair)  # equal pairs get one name, whatever their order
        new = np.zeros(len(rank), np.int64)
        new[order[1:]] = np.cumsum(pair[order[1:]] != pair[order[:-1]])
        rank, span, covers = new, 2 * span, 2 * covers
    return induce(text, smaller, leftmost[np.argsort(rank, kind="stable")], edges)


def window_spans(part: Bodies, window: int) -> list[list[tuple[int, int]]]:
    """Per string the spans covered by ``window`` bytes that also start in a string of a smaller doc_id."""
    sizes = np.array([len(b) for b in part.body], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(part.body) + bytes(9), np.uint8)
    text = data[:-7].astype(np.uint16) + 2
    text[(starts + sizes)[:-1]] = 1  # between strings
    text[starts[-1] + sizes[-1]] = 1
    text[-1] = 0
    array = suffix_array(text, window)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    room = (starts + sizes)[owner] - np.arange(len(owner))
    whole = np.append(room >= window, False)
    order = array[whole[array]].astype(np.int64)
    # permuted common prefixes, in text order: does a window agree with the one before it in the array?
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.flatnonzero(before >= 0)
    agrees = np.zeros(len(text), bool)
    agrees[place] = same_bytes(data, place, before[place], np.full(len(place), window))
    found: list[list[tuple[int, int]]] = [[] for _ in part.body]
    if len(order):
        begin = np.flatnonzero(~agrees[order])
        ids = np.array(part.doc_id, np.int64)[owner[order]]
        least = np.repeat(np.minimum.reduceat(ids, begin), np.diff(np.append(begin, len(order))))
        marked = np.sort(order[least < ids])
        if len(marked):
            cut = np.flatnonzero(np.append(True, (np.diff(marked) > 1) | (np.diff(owner[marked]) > 0)))
            for a, b in zip(marked[cut].tolist(), marked[np.append(cut[1:], len(marked)) - 1].tolist(), strict=True):
                found[owner[a]].append((int(a - starts[owner[a]]), int(b - a + window)))
    return found


def byte_tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]:
    text = chunk.data.tobytes()
    return BYTE_HASHES[chunk.data], chunk.offsets, lambda a, b: text[a:b]


def _deferred_spans(rows: DataFrame, window: int) -> DataFrame:
    """Spans of overlarge keys: equal strings become one row with their smallest and largest doc_id, then the
    windows of the different ones find theirs; Spark combines both before the shuffle, and a string's windows go back to
    all its rows."""
    strings = rows.groupBy("body").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    windows = F.transform(F.sequence(F.lit(0), F.octet_length("body") - window), lambda i: F.struct(i.alias("at"), F.substring("body", i + 1, F.lit(window)).alias("bytes")))
    each = strings.select("body", "least", "most", F.explode(windows).alias("w")).select("body", "least", "most", "w.at", "w.bytes")
    shared = each.groupBy("bytes").agg(F.min("least").alias("owner"), F.max("most").alias("last")).filter("owner < last").select("bytes", "owner")
    marked = each.join(shared, "bytes").groupBy("body").agg(F.collect_list(F.struct("at", "owner")).alias("places"))
    spans = rows.join(marked, "body").select("doc_id", "first", F.explode("places").alias("w")).filter("doc_id > w.owner")
    return spans.select("doc_id", (F.col("first") + F.col("w.at")).alias("first"), F.lit(window).cast("long").alias("size"))


def repeated_spans(docs: DataFrame, window: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, first, size): spans of bytes covered by windows that also start in a text of a smaller doc_id."""
    table = repeated_keys(docs, byte_tokens, window, min(GRAM, window), occurrences_across)
    runs = travelling_runs(docs, byte_tokens, window, min(GRAM, window), table)
    return all_spans(
        runs, lambda part: window_spans(part, window), len, F.octet_length("body"), shard_bytes, True, lambda rows: _deferred_spans(rows, window)
    )


def suffix_dedup(documents: DataFrame, window: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``documents``: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256.

    A text is its UTF-8 bytes, null the empty text. Every byte is removed that is covered by a ``window``-byte string
    that also starts in a document with a smaller doc_id; a string may begin or end inside a character. Texts shorter
    than a window keep all. Rows with one doc_id, or with none, are judged one by one; as none of their ids is smaller,
    they keep what only they share. A null doc_id is the smallest. Other columns are ignored.
    """
    docs = numbered(keyed(documents))
    spans = merged_spans(repeated_spans(docs, window, shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spans_of = span_arrays(batch.column("spans"))
            for chunk in chunks(unpacked(batch.column("packed"))):
                for row, a, b in zip(chunk.rows, chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
                    gone = covered(spans_of[row], b - a)
                    kept = chunk.data[a:b][~gone].tobytes()
                    spans_left = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    rows.append((b - a, int(gone.sum()), spans_left, kept, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = packed_texts(docs).join(spans, ["doc_id", "copy"], "left").select("doc_id", "packed", "spans")
    out = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.withColumn("doc_id", original_id())
