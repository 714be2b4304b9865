"""Running totals per key in which a heavy key is spread over many tasks.

A running window puts all rows of a key into one task. Here rows are dealt out by ranges of (key, order) instead, so that
every task gets about as many rows whatever the keys are, and a key may span any number of tasks:

1. the rows are written once, and cut into ranges at sampled rows;
2. each task walks its sorted range and gives every row its total within the range (its *piece*);
3. the last row of a piece holds what its key brings into the next one. These few rows, two a piece, are summed per key
   and added to the first key of the pieces that follow.

Nothing is counted beforehand, and no key and no order value has to fit into one task. The result is exact wherever the
cuts fall; sampling only decides how even the pieces are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.session import stage


@dataclass(frozen=True)
class Key:
    """A column of a total order and its direction."""

    name: str
    descending: bool = False

    def column(self) -> Column:
        return F.col(self.name).desc() if self.descending else F.col(self.name).asc()


def asc(name: str) -> Key:
    return Key(name)


def desc(name: str) -> Key:
    return Key(name, True)


def running_totals(
    rows: DataFrame, keys: list[str], order: list[Key], sums: dict[str, str] | None = None, row_no: str | None = None, pieces: int | None = None,
    kept: list[str] | None = None, written: bool = False,
) -> DataFrame:
    """Add running sums and a row number per key.

    ``order`` must be a total order inside a key. ``sums`` maps result column to summed column, a decimal or whole number
    whose running sum, in units of its last place, fits into 64 bits (beyond that it wraps); nulls count as 0. ``pieces``
    is the number of ranges, by default that of the session's shuffle partitions. Rows with a null key form one key.
    ``kept`` names the columns of the result besides the totals, the keys among them, by default all. ``written`` says that
    the rows are cheap to read twice, as those of ``write_rows`` are, and need not be written again.
    """
    sums = sums or {}
    kinds = {target: rows.schema[source].dataType for target, source in sums.items()}
    units = {f"_units_{target}": _units(F.col(source), kinds[target]) for target, source in sums.items()}
    source = rows.withColumns(units) if units else rows
    if kept is not None:  # a summed column goes on as its units alone
        source = source.drop(*(set(sums.values()) - {*kept, *keys, *(k.name for k in order)}))
    source = source if written else write_rows(source)  # the cuts are sampled from these
    sort = [*(F.col(k).asc() for k in keys), *(k.column() for k in order)]
    ranged = source.repartitionByRange(pieces, *sort) if pieces else source.repartitionByRange(*sort)
    counted = {name: f"_upto{name}" for name in [*units, *(["_row"] if row_no else [])]}
    schema = T.StructType([f for f in source.schema if (f.name not in units if kept is None else f.name in kept)])
    kept = list(schema.names)
    for name in counted.values():
        schema = schema.add(name, T.LongType())
    schema = schema.add("_piece", T.IntegerType())
    for name in ("_first", "_begins", "_ends"):
        schema = schema.add(name, T.BooleanType())
    # written down, so that the numbers of the pieces stay what they are when an executor is lost
    local = stage(ranged.sortWithinPartitions(*sort).mapInArrow(_walk(keys, counted, schema.names), schema), "scan-pieces")
    whole = local.join(F.broadcast(_carried(local, keys, counted)), "_piece", "left")  # one row a piece at most

    def total(name: str) -> Column:
        return F.col(counted[name]) + F.when(F.col("_first"), F.coalesce(f"_before{name}", F.lit(0))).otherwise(0)

    out = [_scaled(total(f"_units_{target}"), kind).alias(target) for target, kind in kinds.items()]
    if row_no:
        out.append(total("_row").alias(row_no))
    return whole.select(*kept, *out)


def write_rows(rows: DataFrame) -> DataFrame:
    """Rows that are read more than once, as for sampled cuts."""
    return stage(rows, "scan-rows")


def _units(value: Column, kind: T.DataType) -> Column:
    """A decimal in units of its last place, as a whole number."""
    whole = value * F.lit(10**kind.scale) if isinstance(kind, T.DecimalType) else value
    return F.coalesce(whole.cast("bigint"), F.lit(0).cast("bigint"))


def _scaled(units: Column, kind: T.DataType) -> Column:
    """The way back; a sum has ten more digits, as Spark's own sums have."""
    if not isinstance(kind, T.DecimalType):
        return units
    return (units.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-kind.scale))).cast(T.DecimalType(min(38, kind.precision + 10), kind.scale))


def _carried(local: DataFrame, keys: list[str], counted: dict[str, str]) -> DataFrame:
    """(_piece, what the first key of the piece has before it), from the last rows of earlier pieces."""
    sides = F.filter(F.array(F.when(F.col("_begins"), 0), F.when(F.col("_ends"), 1)), lambda side: side.isNotNull())
    edges = local.where("_begins or _ends").select(*keys, "_piece", *counted.values(), F.explode(sides).alias("_side"))
    earlier = Window.partitionBy(*keys).orderBy("_piece", "_side").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.sum(F.when(F.col("_side") == 1, F.col(upto))).over(earlier).alias(f"_before{name}") for name, upto in counted.items()]
    return edges.select("_piece", "_side", *before).where("_side = 0").drop("_side")


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(here, before), False)
    return pc.or_(differ, pc.xor(pc.is_null(here), pc.is_null(before))).to_numpy(zero_copy_only=False)


def _walk(keys: list[str], counted: dict[str, str], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Totals within a sorted range, batch by batch. A batch is handed on when it is known whether it is the last."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, waiting = TaskContext.get().partitionId(), None
        key, first, so_far = None, True, dict.fromkeys(counted, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = waiting is None
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= _changes(batch[k])
            new[0] = not begins and key != tuple(batch[k][0].as_py() for k in keys)
            run = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))  # the row with which each row's key begins
            goes_on = ~np.logical_or.accumulate(new)
            columns = {name: batch[name] for name in names if name in batch.schema.names}
            for name, target in counted.items():
                values = np.ones(len(new), np.int64) if name == "_row" else batch[name].to_numpy()
                upto = np.cumsum(values)
                upto = upto - (upto - values)[run] + np.where(goes_on, so_far[name], 0)
                so_far[name] = upto[-1]
                columns[target] = pa.array(upto)
            in_first = goes_on & first
            first = bool(in_first[-1])
            key = tuple(batch[k][-1].as_py() for k in keys)
            columns |= {"_piece": pa.array(np.full(len(new), piece, np.int32)), "_first": pa.array(in_first)}
            columns |= {"_begins": pa.array(np.arange(len(new)) == (0 if begins else -1)), "_ends": pa.array(np.zeros(len(new), bool))}
            if waiting is not None:
                yield pa.RecordBatch.from_arrays([waiting[n] for n in names], names)
            waiting = columns
        if waiting is not None:
            last = len(waiting["_ends"]) - 1
            waiting["_ends"] = pa.array(np.arange(last + 1) == last)
            yield pa.RecordBatch.from_arrays([waiting[n] for n in names], names)

    return walk


def parts(rows: DataFrame, keys: list[str], position: str, fields: list[str], size: int) -> DataFrame:
    """Ordered nested lists of bounded size: (keys, part_no, items).

    The concatenation of the parts of a key in order is its whole list. A list of any length is
    thereby stored in rows of at most ``size`` items, never in one value.
    """
    part = F.floor((F.col(position) - 1) / size).cast("int")
    gathered = F.array_sort(F.collect_list(F.struct(position, *fields)))
    return rows.groupBy(*keys, part.alias("part_no")).agg(gathered.alias("items"))
