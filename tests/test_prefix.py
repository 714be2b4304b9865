"""Running totals: every way of cutting a key gives the result of a plain window."""

import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallybook import session
from tallybook.operators.prefix import asc, desc, parts, running_totals


def make(spark, seed, hot_share=0.5, days=3):
    """Half of all rows belong to one key, and half of those to one day with equal times."""
    random.seed(seed)
    rows = []
    for number in range(600):
        key = "hot" if random.random() < hot_share else random.choice("abcdefgh")
        day = 1 if random.random() < 0.5 else random.randrange(days)
        rows.append((key, day, day * 10 + random.choice([0, 0, 5]), f"id{number:04}", random.randrange(-500, 500)))
    random.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, day int, at int, id string, amount bigint").repartition(7)


def expected(rows, order):
    result = {}
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], *order(r))), key=lambda r: r[0]):
        total = 0
        for position, row in enumerate(group, 1):
            total += row[4]
            result[row[3]] = (total, position)
    return result


@pytest.mark.parametrize("pieces", [None, 1, 3, 40, 300])
@pytest.mark.parametrize("descending", [False, True])
def test_same_as_plain_window(spark, pieces, descending):
    rows, frame = make(spark, pieces or 0)
    sign = -1 if descending else 1
    way = desc if descending else asc
    result = running_totals(
        frame, ["key"], [way("day"), way("at"), asc("id")], sums={"total": "amount"}, row_no="position", pieces=pieces,
    )
    got = {r.id: (r.total, r.position) for r in result.collect()}
    assert got == expected(rows, lambda r: (sign * r[1], sign * r[2], r[3]))


def test_a_key_that_spans_pieces_and_batches(spark):
    """One key's rows reach over several tasks and Arrow batches; decimals, nulls among keys and amounts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    frame = spark.range(3000).selectExpr(
        "if(id % 3 = 0, null, if(id % 3 = 1, 'hot', concat('k', id % 101))) as key", "id", "if(id % 7 = 0, null, cast(id as decimal(10,2)) / 4) as amount"
    ).withColumn("amount", F.col("amount").cast("decimal(10,2)")).repartition(5)
    result = running_totals(frame, ["key"], [asc("id")], sums={"total": "amount"}, row_no="n", pieces=13)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    inside = Window.partitionBy("key").orderBy("id")
    plain = frame.select("*", F.coalesce(F.sum("amount").over(inside), F.lit(0)).cast("decimal(20,2)").alias("total"), F.row_number().over(inside).cast("bigint").alias("n"))
    assert result.schema["total"].dataType.simpleString() == "decimal(20,2)"
    assert result.count() == 3000 and result.exceptAll(plain.select(*result.columns)).isEmpty()


def test_tasks_are_even_with_a_third_of_the_rows_under_one_key(spark):
    """No task of the walk gets more than three times the median, and the source is read once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = spark.range(60_000).selectExpr("if(id % 3 = 0, -1, id) as key", "id", "1L as amount")
    source = source.mapInArrow(count, source.schema)
    walked = running_totals(source, ["key"], [asc("id")], sums={"total": "amount"}, row_no="n", pieces=12)
    assert walked.where("key = -1").agg(F.max("total"), F.max("n")).first() == (20_000, 20_000)
    assert seen.value == 60_000
    pieces = spark.read.parquet([p for p in session._staged if "scan-pieces" in p][-1]).groupBy("_piece").count()
    sizes = sorted(r["count"] for r in pieces.collect())
    assert len(sizes) >= 10 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "key string, day int, id string, amount bigint")
    assert running_totals(empty, ["key"], [asc("day"), asc("id")], sums={"t": "amount"}, row_no="n").count() == 0


def test_parts_keep_order_and_bound(spark):
    frame = spark.range(1, 2501).selectExpr("'k' as key", "id as position", "id * 2 as value").repartition(5)
    rows = parts(frame, ["key"], "position", ["value"], 1000).orderBy("part_no").collect()
    assert [len(r["items"]) for r in rows] == [1000, 1000, 500]
    assert [i.value for r in rows for i in r["items"]] == [n * 2 for n in range(1, 2501)]
