"""Streams end where their batch twins end, for any number of micro-batches and when they are run again."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.operators import balance, changes, community, movements
from tallybook.session import folders, fresh_dir
from tallybook.streaming import jobs
from tallybook.streaming.jobs import stream_bookings, stream_rows, stream_toggles, stream_unread


class Source:
    """The rows as files in time order, one file per micro-batch; ``add`` brings the next files."""

    def __init__(self, spark, frame, time, files):
        self.spark, self.frame, self.path, self.at = spark, frame, fresh_dir(spark, "source"), 0
        self.sliced = frame.select(F.expr(f"ntile({files}) over (order by {time}, hash(*))").alias("_slice"), "*").cache()

    def add(self, files):
        for number in range(self.at + 1, self.at + files + 1):
            self.sliced.where(F.col("_slice") == number).drop("_slice").coalesce(1).write.mode("append").parquet(self.path)
        self.at += files
        return self.stream()

    def stream(self):
        return self.spark.readStream.schema(self.frame.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def runs(source, files, job):
    """First part of the files, the rest, then nothing new: the result of the last run."""
    first = max(1, files // 2)
    job(source.add(first))
    if files > first:
        job(source.add(files - first))
    return job(source.stream())


@pytest.mark.parametrize("files", [1, 4])
def test_bookings(spark, bound, files):
    log = movements.booked_movements(bound)
    zero = bound.users.select(F.col("id").alias("user_id"), F.lit(0).cast("decimal(28,2)").alias("balance"))
    home = fresh_dir(spark, "bookings")
    result = runs(Source(spark, log, "created_at, kind, id", files), files, lambda s: stream_bookings(s, zero, home))
    expected = movements.running_balance(bound, "as_booked")
    columns = ["id", "user_id", "created_at", "kind", "amount", "balance", "warning"]
    assert result.count() == expected.count()
    assert {r.kind for r in result.select("kind").distinct().collect()} == {"entry", "reversal", "payment", "adjustment"}
    ends = result.groupBy("user_id").agg(F.max_by("balance", F.struct("created_at", "kind", "id")).alias("balance"))
    assert ends.exceptAll(balance.account_balance(bound).select("user_id", "balance")).isEmpty()
    assert result.select(*columns).exceptAll(expected.select(*columns)).isEmpty()


def test_opening_balances_count_once(spark, bound):
    log = movements.booked_movements(bound).where("user_id % 7 = 1")
    opening = bound.users.select(F.col("id").alias("user_id"), F.lit(10).cast("decimal(28,2)").alias("balance"))
    home = fresh_dir(spark, "bookings")
    result = runs(Source(spark, log, "created_at, kind, id", 3), 3, lambda s: stream_bookings(s, opening, home))
    expected = movements.running_balance(bound, "as_booked").where("user_id % 7 = 1").withColumn("balance", (F.col("balance") + 10).cast("decimal(28,2)"))
    assert result.select("id", "balance").exceptAll(expected.select("id", "balance")).isEmpty()


def test_rejected_bookings_are_kept(spark, bound):
    home = fresh_dir(spark, "rejected")
    source = Source(spark, bound.booking_requests, "created_at", 3)
    result = runs(source, 3, lambda s: stream_rows(changes.priced_bookings(s, bound.products).rejected, home))
    expected = changes.priced_bookings(bound.booking_requests, bound.products).rejected
    assert result.count() == expected.count() > 0
    assert result.select(*expected.columns).exceptAll(expected).isEmpty()


@pytest.mark.parametrize("files", [1, 4])
def test_toggles(spark, bound, files):
    home = fresh_dir(spark, "toggles")
    known = bound.suggestions.where("id % 2 = 0")
    result = runs(Source(spark, bound.vote_toggles, "created_at", files), files, lambda s: stream_toggles(s, "suggestion_id", known, home))
    expected = changes.toggle_state(bound.vote_toggles, "suggestion_id", known)
    for got, want in ((result.state, expected.state), (result.rejected, expected.rejected)):
        assert want.count() == got.count() > 0
        assert got.exceptAll(want.select(*got.columns)).isEmpty()


def test_replayed_bookings_count_once(spark, bound):
    """The same movements again, in their own batch and in a later one; one member has all rows of a batch."""
    log = movements.booked_movements(bound).where("user_id % 5 = 2").withColumn("user_id", F.lit(2).cast(bound.users.schema["id"].dataType))
    zero = bound.users.select(F.col("id").alias("user_id"), F.lit(0).cast("decimal(28,2)").alias("balance"))
    home = fresh_dir(spark, "bookings")
    source = Source(spark, log, "created_at, kind, id", 2)
    stream_bookings(source.add(1), zero, home)
    source.sliced.where("_slice = 1").drop("_slice").unionByName(source.sliced.drop("_slice")).coalesce(1).write.mode("append").parquet(source.path)
    stream_bookings(source.stream(), zero, home)
    source.sliced.drop("_slice").coalesce(1).write.mode("append").parquet(source.path)
    result = stream_bookings(source.stream(), zero, home)
    assert result.count() == result.select("kind", "id").distinct().count() == log.count() > 500
    last = result.agg(F.max_by("balance", F.struct("created_at", "kind", "id"))).first()[0]
    assert last == log.agg(F.sum("amount")).first()[0]


def test_kept_tables_are_put_together(spark, monkeypatch):
    """Whole tables every few batches, and a batch that is tried again, give the last row of every key."""
    monkeypatch.setattr(jobs, "WHOLE_EVERY", 3)
    kept = jobs.Kept(spark, fresh_dir(spark, "kept"), T.StructType().add("k", "long").add("v", "long"), ["k"])
    assert kept.rows().isEmpty()
    for n in range(8):
        for _ in range(2):
            assert {r.k: r.v for r in kept.rows(n).collect()} == {k: max(m for m in range(n) if k in (m % 3, 7)) for k in (0, 1, 2, 7) if any(k in (m % 3, 7) for m in range(n))}
            kept.put(spark.createDataFrame([(n % 3, n), (7, n)], kept.schema), n)
    assert {name for name in folders(spark, kept.path) if name.startswith("whole")} == {"whole=2", "whole=5"}


def test_numbers_after_every_batch(spark, bound):
    home = fresh_dir(spark, "toggles")
    source = Source(spark, bound.like_toggles, "created_at", 3)
    for _ in range(3):
        got = stream_toggles(source.add(1), "news_id", bound.news, home)
        so_far = source.sliced.where(F.col("_slice") <= source.at).drop("_slice")
        expected = changes.toggle_state(so_far, "news_id", bound.news)
        counted = expected.state.groupBy("news_id").agg(F.count("*").alias("n"))
        assert got.counts.exceptAll(counted).isEmpty() and counted.count() == got.counts.count() > 0
        assert got.state.exceptAll(expected.state.select(*got.state.columns)).isEmpty() and got.state.count() == expected.state.count()


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_flags_after_every_batch(spark, bound, batches):
    reads = bound.read_marks.select(F.lit("read").alias("kind"), "user_id", F.col("last_seen_at").alias("created_at"))
    posts = bound.news.select(F.lit("news").alias("kind"), F.col("created_by").alias("user_id"), "created_at")
    members = bound.users.select(F.col("id").alias("user_id"))
    home = fresh_dir(spark, "unread")
    source = Source(spark, reads.unionByName(posts), "created_at", batches)
    steps = range(batches) if batches < 7 else [0, 2, 6]
    for step in steps:
        got = stream_unread(source.add(step + 1 - source.at), members, home)
        so_far = source.sliced.where(F.col("_slice") <= source.at)
        marks = so_far.where("kind = 'read'").groupBy("user_id").agg(F.max("created_at").alias("last_seen_at"))
        newest = community.newest_authors(so_far.where("kind = 'news'").select(F.col("user_id").alias("created_by"), "created_at"))
        expected = community.unread_flags(members, marks, newest)
        written = spark.read.parquet(f"{home}/out").count()
        assert got.count() == expected.count() and got.exceptAll(expected).isEmpty()
    assert written < members.count() * batches or batches == 1


@pytest.mark.parametrize("files", [1, 4])
def test_unread(spark, bound, files):
    reads = bound.read_marks.select(F.lit("read").alias("kind"), "user_id", F.col("last_seen_at").alias("created_at"))
    posts = bound.news.select(F.lit("news").alias("kind"), F.col("created_by").alias("user_id"), "created_at")
    members = bound.users.select(F.col("id").alias("user_id"))
    home = fresh_dir(spark, "unread")
    source = Source(spark, reads.unionByName(posts), "created_at", files)
    result = runs(source, files, lambda s: stream_unread(s, members, home))
    expected = community.news_unread(bound)
    assert result.count() == expected.count()
    assert result.exceptAll(expected).isEmpty()


def test_a_stream_without_rows(spark, bound):
    source = Source(spark, bound.vote_toggles.limit(0), "created_at", 1)
    source.spark.createDataFrame([], bound.vote_toggles.schema).write.parquet(source.path)
    result = stream_toggles(source.stream(), "suggestion_id", bound.suggestions, fresh_dir(spark, "none"))
    assert result.state.isEmpty() and result.rejected.isEmpty()
