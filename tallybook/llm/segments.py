"""Runs of windows that share a minimiser, and which minimisers occur more than once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import chunks, mix, run_hashes, sliding_min
from tallybook.session import stage

BUCKET_BITS = 10  # buckets of minimisers that are counted apart
SLICE_BITS = 18  # bits of the bitmap in each bucket
FLUSH_KEYS = 4 << 20
HOT_LEAST = 64  # a minimiser is hot if it makes up 1 / HOT_SHARE of the keys that a task sends, and this many at least
HOT_SHARE = 1024
PLACE_BITS = 31  # a text has fewer tokens
HOT_KEYS = 16  # hot minimisers that a bucket names, the most frequent ones; the others go the ordinary way
SALTS = 1024
COUNTED = np.dtype([("key", "<u4"), ("count", "<u4")])


class Runs(NamedTuple):
    """Maximal runs of consecutive windows with the same minimiser: tokens first to end of text number owner."""

    key: np.ndarray
    first: np.ndarray
    end: np.ndarray
    owner: np.ndarray


def window_runs(tokens: np.ndarray, offsets: np.ndarray, window: int, length: int) -> tuple[Runs, np.ndarray]:
    """Runs over the token hashes of a chunk, and the hash of every ``length`` consecutive tokens.

    A window's minimiser is the smallest such hash in it. Equal windows have the same one, so all windows that are
    equal anywhere meet under one key. Runs are cut by value, not by place: a minimiser repeated nearby stays in
    one run, which only makes the run longer.
    """
    grams = run_hashes(tokens, length)
    lowest = sliding_min(grams, window - length + 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(lowest)]
    inside = np.flatnonzero(np.arange(len(lowest)) + window <= offsets[1:][owner])
    value, owner = lowest[inside], owner[inside]
    cut = np.ones(len(inside), bool)
    cut[1:] = (inside[1:] != inside[:-1] + 1) | (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(cut)
    stop = np.append(begin[1:], len(inside)) - 1 if len(begin) else begin
    return Runs(value[begin], inside[begin], inside[stop] + window if len(begin) else begin, owner[begin]), grams


def occurrences_across(runs: Runs, _grams: np.ndarray, _length: int) -> np.ndarray:
    """Keys to count for matches between texts: each key once a text."""
    order = np.lexsort((runs.key, runs.owner))
    key, owner = runs.key[order], runs.owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new]


def occurrences_anywhere(runs: Runs, grams: np.ndarray, length: int) -> np.ndarray:
    """Keys to count for matches anywhere: once a run, twice if the minimiser occurs again inside its run."""
    sizes = runs.end - runs.first - length + 1
    if not len(sizes):
        return runs.key
    at = np.repeat(runs.first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    hits = np.add.reduceat((grams[at] == np.repeat(runs.key, sizes)).astype(np.int64), np.cumsum(sizes) - sizes)
    return np.concatenate([runs.key, runs.key[hits > 1]])


class Repeated(NamedTuple):
    """The minimisers that occur at least twice, as a bitmap, and those that are hot, as sorted numbers."""

    bits: np.ndarray
    hot: np.ndarray


def repeated_keys(docs: DataFrame, tokens: Callable, window: int, length: int, count: Callable) -> Repeated:
    """A bitmap of fixed size, 2^28 bits, of the minimisers that occur at least twice, and at most 2^14 hot ones.

    Tasks send their keys as sorted numbers of 4 bytes, dealt to 2^BUCKET_BITS buckets, and how often the hot ones
    among them occur; a bucket's owner returns its part of the map. Keys that share their first BUCKET_BITS + 32 bits
    count as one, which lets more through to the exact step and loses nothing. Neither the map nor what an owner holds
    grows with the data: a key whose bit is set is forgotten. The fuller the map is, the more runs travel.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                values, offsets = tokens(chunk)[:2]
                runs, grams = window_runs(values, offsets, window, length)
                held.append(mix(count(runs, grams, length)) >> np.uint64(32 - BUCKET_BITS))
                size += len(held[-1])
            if size > FLUSH_KEYS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        hot = counted_hot(keys)
        third = np.zeros(len(keys), bool)
        third[2:] = keys[2:] == keys[:-2]  # two of each are enough
        keys = keys[~third]
        cuts = np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64)
        edges, hot_edges = np.searchsorted(keys >> np.uint64(32), cuts), np.searchsorted(hot[0] >> np.uint64(32), cuts)
        buckets = np.flatnonzero(np.diff(edges))
        low = keys.astype(np.uint32)
        often = np.empty(len(hot[0]), COUNTED)
        often["key"], often["count"] = hot[0].astype(np.uint32), hot[1]
        parts = [[a[e[b] : e[b + 1]].tobytes() for b in buckets] for a, e in ((low, edges), (often, hot_edges))]
        return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), *(pa.array(x, pa.binary()) for x in parts)], ["bucket", "keys", "hot"])

    def counted_hot(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = max(HOT_LEAST, len(keys) // HOT_SHARE)
        places = np.flatnonzero(keys[least - 1 :] == keys[: max(len(keys) - least + 1, 0)])
        return np.unique(keys[places], return_counts=True)  # counts beyond the least; only their order matters

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size, limit = None, [], 0, FLUSH_KEYS
        bits, hot = np.zeros(1 << SLICE_BITS, bool), Counter()

        def settle() -> None:
            """Set the bits of keys that are held twice; forget the keys whose bits are set."""
            nonlocal held, size, limit
            keys = np.sort(np.concatenate(held))
            place = keys >> np.uint32(32 - SLICE_BITS)
            bits[place[1:][keys[1:] == keys[:-1]]] = True
            held = [keys[~bits[place]]]
            size = len(held[0])
            limit = max(FLUSH_KEYS, 2 * size)

        def close() -> pa.RecordBatch:
            nonlocal held, size, limit
            settle()
            names = np.array([k for k, _ in sorted(hot.items(), key=lambda x: (-x[1], x[0]))[:HOT_KEYS]], np.uint32).tobytes()
            out = [pa.array([bucket], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()]), pa.array([names])]
            bits[:] = False
            hot.clear()
            held, size, limit = [], 0, FLUSH_KEYS
            return pa.RecordBatch.from_arrays(out, ["bucket", "bits", "hot"])

        for batch in batches:
            for key, blob, often in zip(batch.column("bucket").to_pylist(), batch.column("keys"), batch.column("hot").to_pylist(), strict=True):
                if key != bucket and held:
                    yield close()
                bucket = key
                held.append(np.frombuffer(blob.as_buffer(), np.uint32))
                size += len(held[-1])
                hot.update(dict(np.frombuffer(often, COUNTED).tolist()))
                if size > limit:
                    settle()
        if held:
            yield close()

    sent = docs.select("text").mapInArrow(send, "bucket int, keys binary, hot binary")
    owned = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(own, "bucket int, bits binary, hot binary").toArrow()
    out = np.zeros(1 << (BUCKET_BITS + SLICE_BITS - 3), np.uint8)
    width = 1 << (SLICE_BITS - 3)
    hot = [np.empty(0, np.uint64)]
    for bucket, bits, names in zip(*(owned[n].to_pylist() for n in ("bucket", "bits", "hot")), strict=True):
        out[bucket * width : (bucket + 1) * width] = np.frombuffer(bits, np.uint8)
        hot.append(np.frombuffer(names, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
    return Repeated(out, np.sort(np.concatenate(hot)))


def is_repeated(table: Repeated, mixed: np.ndarray) -> np.ndarray:
    place = mixed >> np.uint64(64 - BUCKET_BITS - SLICE_BITS)
    return (table.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 != 0


def is_hot(table: Repeated, mixed: np.ndarray) -> np.ndarray:
    return np.isin(mixed >> np.uint64(32 - BUCKET_BITS), table.hot)


def rarer_runs(tokens: np.ndarray, runs: Runs, window: int) -> Runs:
    """Runs of hot minimisers cut again, by minimisers three quarters as long as a window, which fewer texts share.

    Equal windows still meet. Different texts around a common passage, and most near copies, part here; copies don't.
    """
    sizes = runs.end - runs.first
    offsets = np.append(0, np.cumsum(sizes))
    shift = runs.first - offsets[:-1]
    inside = tokens[np.repeat(shift, sizes) + np.arange(offsets[-1])]
    found, _ = window_runs(inside, offsets, window, max(1, window * 3 // 4))
    return Runs(found.key, found.first + shift[found.owner], found.end + shift[found.owner], runs.owner[found.owner])


def travelling_runs(docs: DataFrame, tokens: Callable, window: int, length: int, table: Repeated) -> DataFrame:
    """(key, salt, body, doc_id, first): each run with a repeated minimiser as one string, for the bucket of its key.

    The key is 4 bytes of the minimiser's hash: minimisers that share them only share a bucket. Windows of a hot
    minimiser go by a longer one and are dealt out by a salt above zero; all others have salt zero. Texts under one id
    keep apart by their places: those of the n-th begin at n times 2^31.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = batch.column("doc_id").to_numpy(), batch.column("copy").to_numpy()
            for chunk in chunks(batch.column("text")):
                values, offsets, body = tokens(chunk)
                runs, _ = window_runs(values, offsets, window, length)
                mixed = mix(runs.key)
                kept = is_repeated(shared.value, mixed)
                hot = kept & is_hot(shared.value, mixed)
                plain = Runs(*(x[kept & ~hot] for x in runs))
                rarer = rarer_runs(values, Runs(*(x[hot] for x in runs)), window)
                salted = np.arange(len(plain.key) + len(rarer.key)) >= len(plain.key)
                runs = Runs(*(np.concatenate(x) for x in zip(plain, rarer, strict=True)))
                rows = np.asarray(chunk.rows)[runs.owner]
                owners = ids[rows]
                first = runs.first - offsets[runs.owner] + (copies[rows] << PLACE_BITS)
                spread = mix(owners.astype(np.uint64) * np.uint64(31) + first.astype(np.uint64)) % np.uint64(SALTS) + np.uint64(1)
                salt = np.where(salted, spread, np.uint64(0)).astype(np.int32)
                bodies = [body(a, b) for a, b in zip(runs.first.tolist(), runs.end.tolist(), strict=True)]
                key = (mix(runs.key) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                columns = [pa.array(key), pa.array(salt), pa.array(bodies, pa.binary()), pa.array(owners), pa.array(first)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "salt", "body", "doc_id", "first"])

    return docs.select("doc_id", "text", "copy").mapInArrow(run, "key int, salt int, body binary, doc_id long, first long")


class Bodies(NamedTuple):
    """Different strings of one or more keys, how often each occurs, and its smallest doc_id."""

    body: list[bytes]
    copies: list[int]
    doc_id: list[int]


SPANS = "kind int, key int, body binary, doc_id long, first long, size long"
_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
SPAN, DEFERRED, HOT = 0, 1, 2


def bucket_spans(runs: DataFrame, decide: Callable[[Bodies], list], size_of: Callable[[bytes], int], shard_bytes: int, across: bool) -> DataFrame:
    """Spans (kind 0) of tokens that ``decide`` finds repeated, and the rows of overlarge (kind 1) and hot keys (2) as they were.

    Rows come sorted by (key, salt, body, doc_id). Rows with a salt are passed on at once. Equal strings need one look: with ``across`` every copy but those of the
    smallest doc_id is a span, else all copies are. Different strings are gathered, keys together, until a shard is
    full; ``decide`` returns for each the list of spans (first, size) in it. The strings of one key that don't fit in a
    shard are passed on, so that a task's memory never follows the number of texts that share a passage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        shard, places, held = Bodies([], [], []), [], 0  # places: rows (doc_id, first) that get the spans of a string
        mark = 0  # where the open key begins in the shard
        key = body = None
        deferring = False

        def emit(limit: int = 0) -> Iterator[pa.RecordBatch]:
            if len(out) > limit:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(_KINDS)], [c.split()[0] for c in SPANS.split(", ")])
                out.clear()

        def settle(upto: int) -> None:
            """Decide the shard's first ``upto`` strings."""
            nonlocal mark, held
            part = Bodies(*(x[:upto] for x in shard))
            for spans, rows in zip(decide(part) if upto else [], places, strict=False):
                out.extend((SPAN, None, None, doc_id, first + at, size) for doc_id, first in rows for at, size in spans)
            for x in (*shard, places):
                del x[:upto]
            held = sum(map(len, shard.body))
            mark = 0

        def spare() -> None:
            """With ``across``, forget the open key's strings if one doc_id is the smallest of each: it keeps them all."""
            nonlocal held
            if across and len(set(shard.doc_id[mark:])) == 1:
                held -= sum(map(len, shard.body[mark:]))
                for x in (*shard, places):
                    del x[mark:]

        for batch in batches:
            salted = batch.column("salt").to_numpy() > 0
            if salted.any():
                hot, batch = batch.filter(pa.array(salted)), batch.filter(pa.array(~salted))
                ends = [pa.array(np.full(len(hot), value, kind)) for value, kind in ((HOT, np.int32), (0, np.int64))]
                yield pa.RecordBatch.from_arrays([ends[0], *(hot.column(n) for n in ("key", "body", "doc_id", "first")), ends[1]], [c.split()[0] for c in SPANS.split(", ")])
            for row in zip(*(batch.column(n).to_numpy(zero_copy_only=False).tolist() for n in ("key", "body", "doc_id", "first")), strict=True):
                new_key, new_body, doc_id, first = row
                if new_key != key:
                    spare()
                    if held > shard_bytes:
                        settle(len(shard.body))
                    key, body, deferring, mark = new_key, None, False, len(shard.body)
                if deferring:
                    out.append((DEFERRED, *row, 0))
                elif new_body == body:
                    shard.copies[-1] += 1
                    if across and doc_id == shard.doc_id[-1]:
                        places[-1].append((doc_id, first))
                        continue
                    size = size_of(body)
                    if not across:
                        out.extend((SPAN, None, None, i, at, size) for i, at in places[-1])
                        del places[-1][1:]  # one stays, for the case that the key is passed on
                    out.append((SPAN, None, None, doc_id, first, size))
                else:
                    if held > shard_bytes:
                        settle(mark)
                    if held > shard_bytes:  # this key alone fills a shard
                        deferring = True
                        for text, rows in zip(shard.body, places, strict=True):
                            out.extend((DEFERRED, key, text, i, at, 0) for i, at in rows)
                        for x in (*shard, places):
                            x.clear()
                        held = mark = 0
                        out.append((DEFERRED, *row, 0))
                    else:
                        body = new_body
                        shard.body.append(body), shard.copies.append(1), shard.doc_id.append(doc_id), places.append([(doc_id, first)])
                        held += len(body)
                yield from emit(20_000)
        spare()
        settle(len(shard.body))
        yield from emit()

    return runs.repartition("key", "salt").sortWithinPartitions("key", "salt", "body", "doc_id").mapInArrow(run, SPANS)


def all_spans(runs: DataFrame, decide: Callable, size_of: Callable, size: Column, shard_bytes: int, across: bool, deferred: Callable) -> DataFrame:
    """(doc_id, first, size): spans of all runs, those of hot and overlarge keys included.

    Equal strings of hot keys are merged by an aggregate, which Spark combines before the shuffle. Copies are spans as
    a whole, as in ``bucket_spans``; one string of each kind (with ``across`` those of the smallest doc_id) goes on to
    the bucket of its key. ``deferred`` finds the spans of overlarge keys; ``size`` is the number of tokens of a body.
    """
    found = stage(bucket_spans(runs, decide, size_of, shard_bytes, across), "spans")
    hot = found.filter(F.col("kind") == HOT).select("key", "body", "doc_id", "first")
    here = F.struct("doc_id", "first")
    strings = hot.groupBy("key", "body").agg(F.min(here).alias("least"), F.count("*").alias("copies"))
    known = stage(hot.join(strings, ["key", "body"]).withColumn("here", here), "hot")
    copy, one = ("doc_id > least.doc_id", "doc_id = least.doc_id") if across else ("copies > 1", "here = least")
    ones = known.filter(one).select("key", F.lit(0).alias("salt"), "body", "doc_id", "first")
    more = stage(bucket_spans(ones, decide, size_of, shard_bytes, across), "spans")
    both = found.unionByName(more)
    parts = [both.filter(F.col("kind") == SPAN), known.filter(copy).withColumn("size", size.cast("long")), deferred(both.filter(F.col("kind") == DEFERRED))]
    return reduce(DataFrame.unionByName, (p.select("doc_id", "first", "size") for p in parts))


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, packed): the texts compressed, for a join that has to send them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [press.compress(t.as_buffer()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(packed, pa.binary())], ["doc_id", "copy", "packed"])

    return docs.select("doc_id", "copy", "text").mapInArrow(run, "doc_id long, copy long, packed binary")


def unpacked(packed: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(p.as_buffer()) for p in packed], pa.large_binary())


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, copy, spans): the sorted spans of each text; a text's spans are no more than its tokens."""
    place = F.col("first").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("first")
    texts = spans.select("doc_id", F.shiftright("first", PLACE_BITS).alias("copy"), place, "size")
    return texts.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set(F.struct("first", "size"))).alias("spans"))


def span_arrays(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row of ``merged_spans`` the firsts and sizes of its spans; a null has none."""
    begin = column.offsets.to_numpy()[:-1].tolist()
    count = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
    first, size = (column.values.field(n).to_numpy(zero_copy_only=False) for n in ("first", "size"))
    return [(first[a : a + n], size[a : a + n]) for a, n in zip(begin, count, strict=True)]


def covered(spans: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """Flags of the tokens in any span."""
    first, sizes = spans
    if not len(first):
        return np.zeros(size, bool)
    begins, ends = (np.bincount(np.minimum(x, size).astype(np.int64), minlength=size + 1) for x in (first, first + sizes))
    return np.cumsum(begins - ends)[:size] > 0
