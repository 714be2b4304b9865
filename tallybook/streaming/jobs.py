"""Streams whose results equal their batch twins, after every micro-batch.

Every job works in a folder that the caller names, ``home``. Running it again on the same folder goes on where the last
run ended: offsets and, for replayed rows, the ids seen are the engine's own, kept in the checkpoint there. Each
micro-batch is worked through with the batch operators, so that one member's rows are spread over tasks; what it leaves
behind is a folder named by its number, which a repeated attempt overwrites. Batches arrive in order; inside a batch the
movement order (time, kind, id) applies. State is one small row per key, so there are no watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tallybook.functions.money import AMOUNT, TOTAL, or_zero
from tallybook.operators.changes import Toggled
from tallybook.operators.community import newest_authors, unread_flags
from tallybook.operators.movements import MOVEMENT_ORDER, low_balance_warning
from tallybook.operators.prefix import running_totals
from tallybook.session import delete, folders, stage

MOVEMENT = ["id", "user_id", "created_at", "kind", "amount"]
WHOLE_EVERY = 16  # batches after which a kept table is put together again


def run_to_end(writer: DataStreamWriter, home: str) -> None:
    """Process everything that is there now and was not processed before."""
    writer.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_rows(rows: DataFrame, home: str) -> DataFrame:
    """All rows of a stream without aggregates so far, for example the rejected ones, each written once."""
    run_to_end(rows.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out"), home)
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{home}/out")


def each_batch(rows: DataFrame, home: str, step: Callable[[DataFrame, int], None]) -> None:
    """``step`` for the rows and the number of every micro-batch. The rows are written down first: a step reads them
    several times, in the caller's session."""
    spark = rows.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        path = f"{home}/in/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        step(spark.read.schema(batch.schema).parquet(path), number)
        delete(spark, path)

    run_to_end(rows.writeStream.outputMode("append").foreachBatch(run), home)


class Kept:
    """A keyed table that a stream keeps: per micro-batch a folder with the rows that changed.

    After ``WHOLE_EVERY`` batches the whole table is written next to the changes, so that reading it takes one whole and
    the few changes after it. A batch that is tried again overwrites its own folder and reads only earlier ones.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys

    def _read(self, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/{name}" for name in names]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self, before: int | None = None, whole_before: int | None = None) -> DataFrame:
        """The last row of every key, of all batches or of those before a number (``whole_before``: by whole tables before it)."""
        numbers = {kind: [] for kind in ("whole", "change")}
        for name in folders(self.spark, self.path):
            kind, number = name.split("=")
            if before is None or int(number) < before:
                numbers[kind].append(int(number))
        start = max((n for n in numbers["whole"] if whole_before is None or n < whole_before), default=-1)
        later = sorted(n for n in numbers["change"] if n > start)
        parts = [self._read([f"whole={start}"] if start >= 0 else []).withColumn("_batch", F.lit(start))]
        parts += [self._read([f"change={n}"]).withColumn("_batch", F.lit(n)) for n in later]
        if len(parts) == 1:
            return parts[0].drop("_batch")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), "_batch").alias("_last"))
        return last.select("_last.*")

    def put(self, changed: DataFrame, number: int) -> None:
        changed.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/change={number}")
        if number % WHOLE_EVERY == WHOLE_EVERY - 1:
            self.rows(number + 1, number).write.mode("overwrite").parquet(f"{self.path}/whole={number}")


def stream_bookings(movements: DataFrame, balances: DataFrame, home: str) -> DataFrame:
    """Balance and low-balance warning after each movement of a stream.

    ``movements`` is a stream of MOVEMENT with any kinds: priced bookings, payments, corrections and the reversals of
    deletions, as one union. ``balances`` are the balances before the stream; they count once, when a member first
    appears. A movement (kind, id) that comes again, in the same batch or a later one, counts once. A batch is summed by
    ranges of (member, order), so that a member's movements of a batch may be of any number.
    """
    spark = balances.sparkSession
    schema = T.StructType([movements.schema[c] for c in MOVEMENT])
    kept = Kept(spark, f"{home}/balances", T.StructType([schema["user_id"], T.StructField("before", T.DecimalType(28, 2))]), ["user_id"])
    opening = balances.select("user_id", F.col("balance").cast(TOTAL).alias("opening"))
    columns = [*MOVEMENT, "balance", "warning"]
    whole = T.StructType([*schema, T.StructField("balance", T.DecimalType(28, 2)), T.StructField("warning", T.StringType())])

    def step(rows: DataFrame, number: int) -> None:
        summed = running_totals(rows.withColumn("amount", F.col("amount").cast(AMOUNT)), ["user_id"], MOVEMENT_ORDER, sums={"inside": "amount"})
        members = rows.select("user_id").distinct().join(kept.rows(number), "user_id", "left").join(opening, "user_id", "left")
        members = members.select("user_id", or_zero(F.coalesce("before", "opening")).alias("before"))
        after = summed.join(members, "user_id").withColumn("balance", (F.col("before") + F.col("inside")).cast(TOTAL))
        path = f"{home}/out/batch={number}"
        after.withColumn("warning", low_balance_warning()).select(*columns).write.mode("overwrite").parquet(path)
        added = rows.groupBy("user_id").agg(F.sum(F.col("amount").cast(AMOUNT)).alias("added"))
        kept.put(members.join(added, "user_id").select("user_id", (F.col("before") + F.col("added")).cast(TOTAL).alias("before")), number)

    each_batch(movements.select(*MOVEMENT).dropDuplicates(["kind", "id"]), home, step)
    return _written(spark, home, whole)


def _written(spark: SparkSession, home: str, schema: T.StructType) -> DataFrame:
    """All that the batches wrote, one after the other."""
    paths = [f"{home}/out/{name}" for name in folders(spark, f"{home}/out")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_toggles(source: DataFrame, item: str, parents: DataFrame, home: str) -> Toggled:
    """Set of (item, user) pairs after a stream of toggles (item, user_id, created_at), those of unknown items, and the
    number of pairs in the set per item.

    A batch's toggles are counted per pair; a pair that changes sides changes its item's number by one, so the numbers
    are never counted from the whole set again.
    """
    spark = parents.sparkSession
    pair = T.StructType([source.schema[item], source.schema["user_id"]])
    pairs = Kept(spark, f"{home}/pairs", T.StructType([*pair, T.StructField("toggles", T.LongType()), source.schema["created_at"]]), [item, "user_id"])
    numbers = Kept(spark, f"{home}/numbers", T.StructType([source.schema[item], T.StructField("n", T.LongType())]), [item])

    def step(rows: DataFrame, number: int) -> None:
        zero = F.lit(0).cast("long")
        now = rows.groupBy(item, "user_id").agg(F.count("*").alias("more"), F.max("created_at").alias("at"))
        known = pairs.rows(number).select(item, "user_id", "toggles", F.col("created_at").alias("last"))
        moved = now.join(known, [item, "user_id"], "left").withColumn("before", F.coalesce("toggles", zero))
        moved = moved.select(item, "user_id", "before", (F.col("before") + F.col("more")).alias("toggles"), F.greatest("at", "last").alias("created_at"))
        moved = stage(moved, "toggled")
        pairs.put(moved, number)
        steps = moved.groupBy(item).agg(F.sum(F.col("toggles") % 2 - F.col("before") % 2).alias("step")).where("step <> 0")
        changed = steps.join(numbers.rows(number), item, "left")
        numbers.put(changed.select(item, (F.coalesce("n", zero) + F.col("step")).alias("n")), number)

    each_batch(source.select(item, "user_id", "created_at"), home, step)
    known, ids = pairs.rows(), parents.select(F.col("id").alias(item))
    state = known.where("toggles % 2 = 1").select(item, "user_id", "created_at").join(ids, item, "left_semi")
    counts = numbers.rows().where("n > 0").join(ids, item, "left_semi")
    return Toggled(state, known.join(ids, item, "left_anti").select(item, "user_id", "toggles"), counts)


def stream_unread(source: DataFrame, members: DataFrame, home: str) -> DataFrame:
    """Unread flag per member after a stream of posts and read marks; each batch writes the flags that change in it.

    The source has (kind, user_id, created_at) with kind 'news' or 'read'. Kept are the latest read mark per member, the
    latest post of the two authors who posted last, and the flags. A batch without a new post looks at the members who
    read in it; one with a post at all of them, as it may change any flag.
    """
    spark = members.sparkSession
    user, time = source.schema["user_id"], source.schema["created_at"]
    marks = Kept(spark, f"{home}/reads", T.StructType([user, T.StructField("last_seen_at", time.dataType)]), ["user_id"])
    posts = Kept(spark, f"{home}/authors", T.StructType([T.StructField("created_by", user.dataType), time]), ["created_by"])
    flags = Kept(spark, f"{home}/out", T.StructType([members.schema["user_id"], T.StructField("unread", T.BooleanType())]), ["user_id"])

    def step(rows: DataFrame, number: int) -> None:
        latest = rows.groupBy("kind", "user_id").agg(F.max("created_at").alias("created_at"))
        latest = stage(latest, "latest")
        read = latest.where("kind = 'read'").select("user_id", F.col("created_at").alias("last_seen_at"))
        read = read.unionByName(marks.rows(number).join(read.select("user_id"), "user_id", "left_semi"))
        marks.put(read.groupBy("user_id").agg(F.max("last_seen_at").alias("last_seen_at")), number)
        news = latest.where("kind = 'news'").select(F.col("user_id").alias("created_by"), "created_at")
        posted = not news.isEmpty()
        newest = newest_authors(news.unionByName(posts.rows(number))).select("created_by", F.col("last_post").alias("created_at"))
        posts.put(newest, number)
        newest = posts.rows(number + 1)
        asked = members if posted else members.join(latest.where("kind = 'read'").select("user_id"), "user_id", "left_semi")
        seen = marks.rows(number + 1)
        now = unread_flags(asked, seen, newest_authors(newest))
        before = flags.rows(number).select("user_id", F.col("unread").alias("before"))
        changed = now.join(before, "user_id", "left").where(F.col("unread") != F.coalesce("before", F.lit(False)))
        flags.put(changed.select("user_id", "unread"), number)

    each_batch(source.select("kind", "user_id", "created_at"), home, step)
    last = flags.rows()
    return members.select("user_id").join(last, "user_id", "left").select("user_id", F.coalesce("unread", F.lit(False)).alias("unread"))
