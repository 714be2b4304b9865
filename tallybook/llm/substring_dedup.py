"""Repeated word windows: runs that share a minimiser travel as one string to a bucket, where windows are counted."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import NOT_SPACE, Chunk, chunks, keyed, numbered, original_id, run_hashes, span_hashes, word_spans
from tallybook.llm.segments import (
    Bodies, all_spans, covered, merged_spans, occurrences_anywhere, packed_texts, repeated_keys, span_arrays, travelling_runs, unpacked,
)
from tallybook.llm.simhash import _spaced

GRAM = 8  # words in a minimiser
SHARD_BYTES = 1 << 20


def word_tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]:
    """Word hashes, where each text's words begin, and the words of a range joined by one space."""
    starts, ends, owner = word_spans(chunk.data, chunk.offsets, NOT_SPACE)
    spaced, at = _spaced(chunk.data, starts, ends) if len(starts) else (b"", starts)
    stops = at + ends - starts
    offsets = np.searchsorted(owner, np.arange(len(chunk.rows) + 1))
    return span_hashes(chunk.data, starts, ends), offsets, lambda a, b: spaced[at[a] : stops[b - 1]]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at a and at b are equal, eight at a time; ``data`` has eight spare bytes."""
    words = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, 0, (1,))
    equal = np.ones(len(a), bool)
    todo, done = np.arange(len(a)), 0
    while len(todo):
        left = size[todo] - done
        todo = todo[left > 0]
        left = np.minimum(size[todo] - done, 8).astype(np.uint64)
        differs = (words[a[todo] + done] ^ words[b[todo] + done]) << (np.uint64(64) - np.uint64(8) * left) != 0
        equal[todo[differs]] = False
        todo, done = todo[~differs], done + 8
    return equal


def window_spans(part: Bodies, window: int) -> list[list[tuple[int, int]]]:
    """Per string the spans of words covered by windows that occur twice or more in all strings and their copies."""
    offsets = np.zeros(len(part.body) + 1, np.int64)
    np.cumsum([len(b) for b in part.body], out=offsets[1:])
    data = np.frombuffer(b"".join(part.body) + bytes(8), np.uint8)
    starts, ends, owner = word_spans(data[:-8], offsets, NOT_SPACE)
    hashes = run_hashes(span_hashes(data[:-8], starts, ends), window)
    at = np.flatnonzero(owner[: len(hashes)] == owner[window - 1 :])
    order = at[np.argsort(hashes[at], kind="stable")]
    begin, size = starts[order], ends[order + window - 1] - starts[order]
    copies = np.array(part.copies, np.int64)[owner[order]]
    alike = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    equal = (size[alike] == size[alike + 1]) & same_bytes(data, begin[alike], begin[alike + 1], np.minimum(size[alike], size[alike + 1]))
    if equal.all():
        new = np.ones(len(order), bool)
        new[alike + 1] = False
        group = np.cumsum(new) - 1
        often = np.bincount(group, copies)[group] > 1 if len(order) else new
    else:  # two different windows with one hash: count the windows themselves
        texts = [data[b : b + n].tobytes() for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
        count = Counter()
        for text, n in zip(texts, copies.tolist(), strict=True):
            count[text] += n
        often = np.array([count[t] > 1 for t in texts])
    marked = np.sort(order[often])
    found: list[list[tuple[int, int]]] = [[] for _ in part.body]
    if len(marked):
        first = np.searchsorted(owner, np.arange(len(part.body)))
        cut = np.flatnonzero(np.append(True, (np.diff(marked) > 1) | (np.diff(owner[marked]) > 0)))
        for a, b in zip(marked[cut].tolist(), marked[np.append(cut[1:], len(marked)) - 1].tolist(), strict=True):
            found[owner[a]].append((int(a - first[owner[a]]), int(b - a + window)))
    return found


def _deferred_spans(rows: DataFrame, window: int) -> DataFrame:
    """Spans of overlarge keys: equal strings become one row with their number, then the windows of the different
    ones are counted; Spark combines both before the shuffle, and a string's repeated windows go back to all its rows."""
    strings = rows.groupBy("body").agg(F.count("*").alias("copies")).withColumn("words", F.split(F.col("body").cast("string"), " "))
    windows = F.transform(F.sequence(F.lit(0), F.array_size("words") - window), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i + 1, window), " ").alias("text")))
    each = strings.select("body", "copies", F.explode(windows).alias("w")).select("body", "copies", "w.at", "w.text")
    often = each.groupBy("text").agg(F.sum("copies").alias("n")).filter("n > 1").select("text")
    marked = each.join(often, "text", "left_semi").groupBy("body").agg(F.collect_list("at").alias("places"))
    spans = rows.join(marked, "body").select("doc_id", "first", F.explode("places").alias("at"))
    return spans.select("doc_id", (F.col("first") + F.col("at")).alias("first"), F.lit(window).cast("long").alias("size"))


def repeated_spans(docs: DataFrame, window: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, first, size): spans of words covered by windows that also start anywhere else."""
    table = repeated_keys(docs, word_tokens, window, min(GRAM, window), occurrences_anywhere)
    runs = travelling_runs(docs, word_tokens, window, min(GRAM, window), table)
    size = F.size(F.split(F.col("body").cast("string"), " "))
    return all_spans(
        runs, lambda part: window_spans(part, window), lambda body: body.count(b" ") + 1, size, shard_bytes, False, lambda rows: _deferred_spans(rows, window)
    )


def substring_dedup(documents: DataFrame, window: int = 35, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_removed, kept (the kept words joined by one space), kept_sha256.

    Words are runs of other than white space (space, U+0009 to U+000D). Every word is removed that is covered by
    ``window`` consecutive words of one document whose sequence also starts anywhere else, also in the same document.
    A null text has no words; texts shorter than a window keep all. Every row is a text of its own, also where rows
    share an id or have none. Other columns are ignored.
    """
    docs = numbered(keyed(documents))
    spans = merged_spans(repeated_spans(docs, window, shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spans_of = span_arrays(batch.column("spans"))
            for chunk in chunks(unpacked(batch.column("packed"))):
                starts, ends, owner = word_spans(chunk.data, chunk.offsets, NOT_SPACE)
                text = chunk.data.tobytes()
                first = np.searchsorted(owner, np.arange(len(chunk.rows) + 1)).tolist()
                for row, a, b in zip(chunk.rows, first[:-1], first[1:], strict=True):
                    gone = covered(spans_of[row], b - a)
                    left = np.flatnonzero(~gone) + a
                    kept = b" ".join(text[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True))
                    rows.append((b - a, int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    joined = packed_texts(docs).join(spans, ["doc_id", "copy"], "left").select("doc_id", "packed", "spans")
    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.withColumn("doc_id", original_id())
