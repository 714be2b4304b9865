"""Closed months: sums per member and per product, stored beside the ledgers, month by month.

A closed month is read as one row a member (or product) instead of its bookings; only months that are not closed are read
from the ledgers. Closing a month again replaces its sums, so a retried job and late bookings or deletions in a closed
month leave what a first closing would have. Every closed month holds a row without a key, so that a month whose last
booking was deleted stays closed, and empty.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.money import AMOUNT, money_sum, unit_sum
from tallybook.session import folders

_SUM = T.DecimalType(28, 2)
MEMBER_SUMS = ["spent", "paid_in", "corrected"]
ROLLUPS = {"member_months": "user_id", "product_months": "product_id"}


def month_of(column: str = "created_at") -> Column:
    return F.trunc(column, "MM")


def _in(ledger: DataFrame, months: list[dt.date], inside: bool = True) -> DataFrame:
    """Rows of some months, or of all others; stored ledgers are pruned by folder."""
    month = F.col("month") if "month" in ledger.columns else month_of()
    found = month.isin(months) if months else F.lit(False)
    return ledger.where(found if inside else ~found)


def _member_rows(t, months: list[dt.date], inside: bool) -> DataFrame:
    parts = []
    for name, ledger, amount in (("spent", t.entries.where("deleted_at is null"), "total"), ("paid_in", t.payments, "amount"), ("corrected", t.adjustments, "amount")):
        own = {s: F.col(amount) if s == name else F.lit(None) for s in MEMBER_SUMS}
        entry = F.lit(1) if name == "spent" else F.lit(0)
        parts.append(_in(ledger, months, inside).select("user_id", "created_at", *(v.cast(AMOUNT).alias(s) for s, v in own.items()), entry.alias("entries")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _product_rows(t, months: list[dt.date], inside: bool) -> DataFrame:
    bought = _in(t.entries.where("deleted_at is null"), months, inside)
    return bought.select("product_id", "created_at", F.col("quantity").alias("units"), F.col("total").alias("revenue"))


_ROWS = {"member_months": _member_rows, "product_months": _product_rows}


def _sums(table: str) -> list[Column]:
    if table == "member_months":
        return [*(money_sum(s).alias(s) for s in MEMBER_SUMS), unit_sum("entries").alias("entries")]
    return [unit_sum("units").alias("units"), money_sum("revenue").alias("revenue")]


def _schema(t, table: str) -> T.StructType:
    key = T.StructField(ROLLUPS[table], t.entries.schema[ROLLUPS[table]].dataType)
    money, units = [T.StructField(s, _SUM) for s in MEMBER_SUMS], T.LongType()
    figures = [*money, T.StructField("entries", units)] if table == "member_months" else [T.StructField("units", units), T.StructField("revenue", _SUM)]
    return T.StructType([key, *figures, T.StructField("month", T.DateType())])


def closed_months(spark: SparkSession, root: str) -> list[dt.date]:
    """Months with stored sums of both kinds."""
    stored = [{dt.date.fromisoformat(n.split("=")[1]) for n in folders(spark, f"{root}/{table}") if n.startswith("month=")} for table in ROLLUPS]
    return sorted(set.intersection(*stored))


def touched_months(rows: DataFrame) -> list[dt.date]:
    """The months of a batch of ledger rows."""
    return sorted(r[0] for r in rows.where("created_at is not null").select(month_of()).distinct().collect())


def close_months(t, root: str, months: list[dt.date]) -> None:
    """Store the sums of some months of the ledgers of ``t``, in place of what was stored for them."""
    if not months:
        return
    spark = t.entries.sparkSession
    for table, key in ROLLUPS.items():
        schema = _schema(t, table)
        sums = _ROWS[table](t, months, True).groupBy(month_of().alias("month"), key).agg(*_sums(table))
        marks = spark.createDataFrame([(month,) for month in months], "month date")
        rows = sums.unionByName(marks, allowMissingColumns=True).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        rows.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{root}/{table}")


def rolled(t, root: str, table: str) -> DataFrame:
    """(key, month, sums) of all months: closed ones as stored, the others summed from their rows."""
    spark = t.entries.sparkSession
    closed, key, schema = closed_months(spark, root), ROLLUPS[table], _schema(t, table)
    now = _ROWS[table](t, closed, False).groupBy(month_of().alias("month"), key).agg(*_sums(table)).select(*schema.names)
    if not closed:
        return now
    stored = spark.read.schema(schema).parquet(f"{root}/{table}").where(F.col("month").isin(closed) & F.col(key).isNotNull())
    return stored.unionByName(now)
