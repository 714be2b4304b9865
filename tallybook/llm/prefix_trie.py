"""The prefix trie of conversations: which of them begin alike, and what their shared beginnings would save.

A node is a sequence of turns with which at least one conversation begins; the root is the empty one. Nothing walks down
the trie level by level, and no conversation has to fit into one row or task:

1. Turns become digests. A prefix is identified by its depth and the sums of its turns' digests with their places (four
   sums of 31 bits each), which are running totals over (conversation, place). Two different prefixes of one depth agree
   by chance only, once in about 2^124 pairs.
2. A count-min sketch over all prefixes screens them: its estimate is never below the count, so a prefix estimated at one
   belongs to a single conversation. Such tails are answered in place; they have one member, one leaf and save nothing.
3. The other prefixes, shared ones and a few that only look so, are grouped exactly by depth and sums.
4. A conversation stands for the nodes whose smallest member it is. Sums over subtrees are sums over members of what each
   member stands for at that depth and below: running totals from the end of each conversation, then one grouping.
5. The members that end in a node are joined into lists of bounded size and hashed in order by a task that reads them
   as a stream.

Turns are ordered by turn, nulls first, turns of equal number by the SHA-256 of role and text; a repeated row is a further
turn. Null roles and texts are empty. Rows without a conversation id belong to no conversation. An empty table has no node.
Conversations may have up to 2^32 turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.common import mix
from tallybook.operators.prefix import asc, desc, running_totals
from tallybook.session import stage

# How conversations are rebuilt.
FAMILY = 100  # conversations that share a first part
SHARES = 6  # a conversation takes 0 to 5 turns of its family's first one

SKETCH_ROWS = 3
LEAST_BITS, MOST_BITS = 10, 26  # cells of a sketch row: at most 8 MB as a bitmap
BLOCK_BITS = 10  # cells of a row that travel together
FLUSH_ROWS = 1 << 20
LIST_BITS = 10  # ids that are joined into one string

_KEY = ["depth", "g1", "g2"]
_NONE = hashlib.sha256(b"").hexdigest()


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, chars, length) of every rebuilt turn, and (conv_id, length) of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    turns = running_totals(turns.where("conv_id is not null"), ["conv_id"], [asc("turn"), asc("digest")], row_no="at").drop("turn")
    convs = stage(turns.groupBy("conv_id").agg(F.max("at").alias("own")), "conversations")
    taken = F.expr(f"crc32(cast(conv_id as string)) % {SHARES}")
    convs = convs.withColumns({"taken": taken, "base": F.expr(f"conv_id - conv_id % {FAMILY}")})
    first = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("first"))
    given = F.least("taken", F.coalesce("first", F.lit(0).cast("long")))
    convs = convs.join(first, "base", "left").withColumn("given", given)
    convs = stage(convs.withColumn("length", F.col("given") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))), "lengths")
    kept = turns.join(convs, "conv_id").where("at > taken").select("conv_id", (F.col("given") + F.col("at") - F.col("taken")).alias("depth"), "digest", "chars", "length")
    heads = turns.where(F.col("at") < SHARES).withColumnRenamed("conv_id", "base")
    given = heads.join(convs.where("given > 0"), "base").where("at <= given").select("conv_id", F.col("at").alias("depth"), "digest", "chars", "length")
    return kept.unionByName(given), convs.select("conv_id", "length")


def _packed(sums: list[Column]) -> list[Column]:
    return [F.xxhash64(*sums), F.xxhash64(F.lit("second"), *reversed(sums))]


def prefixes(conversations: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, length, depth, chars of its last turn, its identity g1, g2 and that of
    the prefix before it, h1, h2."""
    turns, convs = rebuilt_turns(conversations)
    wide = [F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth")]
    parts = [half.bitwiseAND(F.lit((1 << 31) - 1)) for x in wide for half in (x, F.shiftrightunsigned(x, 32))]
    turns = turns.select("conv_id", "length", "depth", "chars", *(p.alias(f"x{k}") for k, p in enumerate(parts)))
    summed = running_totals(turns, ["conv_id"], [asc("depth")], sums={f"s{k}": f"x{k}" for k in range(4)})
    here, before = _packed([F.col(f"s{k}") for k in range(4)]), _packed([F.col(f"s{k}") - F.col(f"x{k}") for k in range(4)])
    fields = dict(zip(("g1", "g2", "h1", "h2"), [*here, *before], strict=True))
    found = summed.select("conv_id", "length", "depth", "chars", *(c.alias(n) for n, c in fields.items()))
    zero = F.lit(0).cast("long")
    empty = _packed([zero] * 4)
    root = convs.select("conv_id", "length", zero.alias("depth"), zero.alias("chars"), *(c.alias(n) for n, c in zip(("g1", "g2", "h1", "h2"), empty * 2, strict=True)))
    return found.unionByName(root)


def _cells(g1: np.ndarray, g2: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each prefix in every row of the sketch."""
    return [(mix(g1 + np.uint64(r) * (g2 | np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64) for r in range(SKETCH_ROWS)]


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _by_block(kept: list[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """A task's own counts, up to two: cells met once and cells met again, in blocks."""
    g1, g2 = (np.concatenate(parts) for parts in zip(*kept, strict=True))
    width = min(BLOCK_BITS, bits)
    out: dict[str, list] = {"r": [], "block": [], "once": [], "more": []}
    for r, cells in enumerate(_cells(g1, g2, bits)):
        cells, n = np.unique(cells, return_counts=True)
        blocks = cells >> width
        starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        within = (cells & ((1 << width) - 1)).astype(np.uint16)
        for a, b in zip(starts, [*starts[1:], len(cells)], strict=True):
            out["r"].append(r)
            out["block"].append(int(blocks[a]))
            out["once"].append(within[a:b][n[a:b] == 1].tobytes())
            out["more"].append(within[a:b][n[a:b] > 1].tobytes())
    yield from pa.table(out, pa.schema([("r", pa.int32()), ("block", pa.int64()), ("once", pa.binary()), ("more", pa.binary())])).to_batches(max_chunksize=2000)


def _often(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of all tasks, sorted, to one bitmap a block of the cells that were met more than once."""
    names, key, count = ["r", "block", "often"], None, np.zeros(1 << BLOCK_BITS, np.uint8)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], names)

    for batch in rows:
        for r, block, once, more in zip(*(batch[c].to_pylist() for c in ("r", "block", "once", "more")), strict=True):
            if key != (r, block):
                if key is not None:
                    yield done()
                key = (r, block)
                count[:] = 0
            count[np.frombuffer(more, np.uint16)] = 2
            met = np.frombuffer(once, np.uint16)
            count[met] = np.minimum(count[met] + 1, 2)
    if key is not None:
        yield done()


def count_min(found: DataFrame, bits: int) -> list[np.ndarray]:
    """Per row of the sketch, a bitmap of the cells with more than one prefix: 2^bits bits, whatever the input."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for batch in batches:
            kept.append((_unsigned(batch["g1"]), _unsigned(batch["g2"])))
            rows += batch.num_rows
            if rows > FLUSH_ROWS:
                yield from _by_block(kept, bits)
                kept, rows = [], 0
        if rows:
            yield from _by_block(kept, bits)

    counted = found.where("depth > 0").select("g1", "g2").mapInArrow(gather, "r int, block long, once binary, more binary")
    blocks = counted.repartition("r", "block").sortWithinPartitions("r", "block").mapInArrow(_often, "r int, block long, often binary").toArrow()
    width = min(BLOCK_BITS, bits)
    out = [np.zeros(1 << bits, bool) for _ in range(SKETCH_ROWS)]
    for r, block, often in zip(*(blocks[c].to_pylist() for c in ("r", "block", "often")), strict=True):
        out[r][block << width : (block + 1) << width] = np.unpackbits(np.frombuffer(often, np.uint8))[: 1 << width]
    return [np.packbits(row) for row in out]


def screened(found: DataFrame, bits: int | None = None) -> DataFrame:
    """The prefixes with ``shared``, whether the sketch doesn't prove that a prefix is a single conversation's, and
    ``after_shared``, the same of the prefix before it. The root is shared."""
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (4 * found.count()).bit_length()))
    sketch = found.sparkSession.sparkContext.broadcast(count_min(found, bits))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often(a: pa.Array, b: pa.Array) -> np.ndarray:
            cells = zip(sketch.value, _cells(_unsigned(a), _unsigned(b), bits), strict=True)
            return np.logical_and.reduce([(row[cell >> 3] >> (7 - (cell & 7))) & 1 == 1 for row, cell in cells])

        for batch in batches:
            depth = batch["depth"].to_numpy()
            shared = often(batch["g1"], batch["g2"]) | (depth == 0)
            after = often(batch["h1"], batch["h2"]) | (depth <= 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared), pa.array(after)], [*batch.schema.names, "shared", "after_shared"])

    flags = [T.StructField(name, T.BooleanType()) for name in ("shared", "after_shared")]
    return found.mapInArrow(flag, T.StructType([*found.schema, *flags]))


def _hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of ids of a node, in order, to one digest of all of them joined."""
    names, key, digest = [*_KEY, "ends"], None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([digest.hexdigest()])], names)

    for batch in rows:
        for *own, ids in zip(*(batch[c].to_pylist() for c in (*_KEY, "ids")), strict=True):
            if own != key:
                if key is not None:
                    yield done()
                key, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if key is not None:
        yield done()


def _ends(shared: DataFrame) -> DataFrame:
    """(key, digest of the ids that end there), for nodes in which conversations end."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    lists = shared.where("depth = length").groupBy(*_KEY, F.shiftright("conv_id", LIST_BITS).alias("part")).agg(ids.alias("ids"))
    return lists.repartition(*_KEY).sortWithinPartitions(*_KEY, "part").mapInArrow(_hashed, "depth long, g1 long, g2 long, ends string")


def _nodes(shared: DataFrame, tails: DataFrame) -> DataFrame:
    """Exact nodes: members, smallest member, what the node saves itself, and its children."""
    nodes = shared.groupBy(*_KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    before = [(F.col("depth") - 1).alias("depth"), F.col("h1").alias("g1"), F.col("h2").alias("g2")]
    below = nodes.where("depth > 0").select(*before).unionByName(tails.where("after_shared").select(*before))
    children = below.groupBy(*_KEY).agg(F.count("*").alias("n_children"))
    return nodes.join(children, _KEY, "left").na.fill(0, ["n_children"])


def conversation_trie(conversations: DataFrame, sketch_bits: int | None = None) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = stage(screened(stage(prefixes(conversations), "prefixes"), sketch_bits), "screened")
    shared, tails = rows.where("shared"), rows.where("not shared")
    nodes = stage(_nodes(shared, tails), "nodes")
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    stands = shared.select("conv_id", *_KEY).join(own, ["conv_id", "depth"], "left").na.fill(0, ["leaf", "saved"])
    last = tails.where("depth = length").select("conv_id", "depth", F.lit(1).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    below = running_totals(stands.unionByName(last, allowMissingColumns=True), ["conv_id"], [desc("depth")], sums={"leaves": "leaf", "saves": "saved"})
    totals = below.where("g1 is not null").groupBy(*_KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saves").alias("saved_tokens"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("conv_id").alias("parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    exact = nodes.join(totals, _KEY).join(_ends(shared), _KEY, "left").join(parents, ["depth", "h1", "h2"], "left")
    exact = exact.withColumns({"parent_conv_id": parent, "ends_sha256": F.coalesce("ends", F.lit(_NONE))}).select(*columns)
    # a tail has one member; only its first prefix has a parent with others
    ends = F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_NONE)
    one, many = F.lit(1).cast("long"), (F.col("depth") < F.col("length")).cast("long")
    figures = {"n_convs": one, "n_children": many, "n_leaves": one, "saved_tokens": F.lit(0).cast("long"), "ends_sha256": ends}
    first = tails.where("after_shared").join(parents, ["depth", "h1", "h2"], "left").withColumn("parent_conv_id", parent)
    rest = tails.where("not after_shared").withColumn("parent_conv_id", F.col("conv_id"))
    return exact.unionByName(first.withColumns(figures).select(*columns)).unionByName(rest.withColumns(figures).select(*columns))
