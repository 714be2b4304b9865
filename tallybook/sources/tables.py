"""Reading and writing table snapshots."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.months import in_month, month_bounds
from tallybook.operators.evolve import evolve_products
from tallybook.session import stage
from tallybook.sources.rollups import close_months, closed_months, month_of, touched_months
from tallybook.sources.schemas import MONTHLY, SCHEMAS


class Tables:
    """The tables as DataFrames: ``Tables(users=..., entries=...)``."""

    def __init__(self, **frames: DataFrame):
        self.__dict__.update(frames)

    def replace(self, **frames: DataFrame) -> "Tables":
        return Tables(**{**self.__dict__, **frames})


def read_tables(spark: SparkSession, root: str) -> Tables:
    """All tables under ``root`` with their declared schemas; nothing is inferred."""
    frames = {}
    for name, schema in SCHEMAS.items():
        frames[name] = _read(spark, root, name, schema)
    return Tables(**frames)


def _read(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A table with its declared schema; a ledger's month is a column, its batches are not."""
    if name not in MONTHLY:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    stored = T.StructType([*schema.fields, T.StructField("month", T.DateType()), T.StructField("batch", T.StringType())])
    return spark.read.schema(stored).parquet(f"{root}/{name}").drop("batch")


def read_products(spark: SparkSession, root: str) -> DataFrame:
    """Stored products of every version: files without the later columns get them when they are read, filled as new products are."""
    categories = _read(spark, root, "categories", SCHEMAS["categories"])
    return evolve_products(_read(spark, root, "products", SCHEMAS["products"]), categories).select(*SCHEMAS["products"].names)


def append_ledger(rows: DataFrame, root: str, table: str, batch: str | None = None) -> None:
    """Append ledger rows, stored by month and batch and sorted by member inside each file.

    ``batch`` names the rows: appending under a name again replaces what the name stands for in the months of the rows,
    so that a retried job leaves them once. Without a name each call is a batch of its own. The rebalance hint lets AQE
    cut a large month into several files and put small ones together, so neither a month in one task nor a file per task
    and month results. Closed months that get rows are closed again.
    """
    spark, columns = rows.sparkSession, SCHEMAS[table].names
    named = F.lit(batch or uuid.uuid4().hex)
    stored = rows.select(*columns, month_of().alias("month"), named.alias("batch"))
    (
        stored.hint("rebalance", "month").sortWithinPartitions("month", "user_id", "created_at")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(f"{root}/{table}")
    )
    closed = closed_months(spark, root)
    if closed:
        close_months(read_tables(spark, root), root, [m for m in touched_months(rows) if m in set(closed)])


def write_snapshot(rows: DataFrame, root: str, table: str) -> None:
    """Write a non-ledger table into a fresh directory."""
    rows.select(*SCHEMAS[table].names).write.mode("errorifexists").parquet(f"{root}/{table}")


def month_rows(ledger: DataFrame, as_of: dt.date) -> DataFrame:
    """Rows of one stored month: prunes directories as well as row groups."""
    rows = ledger.where(in_month("created_at", as_of))
    return rows.where(F.col("month") == F.lit(month_bounds(as_of)[0])) if "month" in ledger.columns else rows


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per row; missing values stay visible as nulls."""
    body = F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"})
    documents.select(body.alias("value")).write.mode("errorifexists").text(path)


def write_statements(lines: DataFrame, path: str, lines_per_bucket: int = 2_000_000) -> None:
    """Statement lines as text, a directory per member bucket, each file sorted by member and line.

    A directory per member would mean one file per member; a bucket holds many members and each
    line starts with the member and its number, so a member's lines can be read back in order. The
    number of buckets follows from the number of lines. The rebalance hint gives a bucket few files and
    lets AQE cut one with a very heavy member into several.
    """
    ready = stage(lines.select("user_id", "line_no", "line"), "statement-lines")
    buckets = max(1, -(-ready.count() // lines_per_bucket))
    text = F.concat_ws("\t", F.col("user_id").cast("string"), F.col("line_no").cast("string"), "line")
    (
        ready.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets))).hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "user_id", "line_no").select("bucket", text.alias("value"))
        .write.mode("errorifexists").partitionBy("bucket").text(path)
    )
