"""Balances, the member overview and revenue from closed months: the same rows as from the ledgers, from far fewer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import money_sum, or_zero, unit_sum
from tallybook.functions.months import month_bounds, month_label
from tallybook.operators.catalog import setting
from tallybook.operators.profile import PAY_INFO
from tallybook.sources.rollups import rolled


def _this_month(as_of: dt.date) -> Column:
    return F.col("month") == F.lit(month_bounds(as_of)[0])


def _balance() -> Column:
    credit = F.col("paid_in") + F.col("corrected") - F.col("spent")
    return or_zero(F.sum(credit)).alias("balance")


def _per_member(t, root: str, *figures: Column) -> DataFrame:
    members = t.users.select(F.col("id").alias("user_id"))
    return members.join(rolled(t, root, "member_months").groupBy("user_id").agg(*figures), "user_id", "left")


def account_balance(t, root: str) -> DataFrame:
    """Balance of every member; members without movements have 0."""
    return _per_member(t, root, _balance()).select("user_id", or_zero("balance").alias("balance"))


def account_month_dashboard(t, root: str, as_of: dt.date) -> DataFrame:
    """Balance and one month's spending, payments and corrections of every member."""
    here = _this_month(as_of)
    sums = {"month_spent": "spent", "month_payments": "paid_in", "month_adjustments": "corrected"}
    rows = _per_member(t, root, _balance(), *(F.sum(F.when(here, F.col(s))).alias(name) for name, s in sums.items()))
    return rows.select(
        "user_id", or_zero("balance").alias("balance"), month_label(as_of).alias("month_label"), F.lit(PAY_INFO).alias("pay_info"),
        setting(t).alias("paypal_me"), *(or_zero(name).alias(name) for name in sums),
    )


def purchase_counts(t, root: str, as_of: dt.date) -> DataFrame:
    """Balance, spending of the month and number of live purchases of every member."""
    spent = F.sum(F.when(_this_month(as_of), F.col("spent"))).alias("month_spent")
    rows = _per_member(t, root, _balance(), spent, unit_sum("entries").alias("entries_count"))
    return rows.select("user_id", or_zero("balance").alias("balance"), or_zero("month_spent").alias("month_spent"), F.coalesce("entries_count", F.lit(0).cast("long")).alias("entries_count"))


def revenue_summary(t, root: str, as_of: dt.date) -> DataFrame:
    """Month revenue and all-time revenue without left-out products; month units with them."""
    here = _this_month(as_of)
    sales = rolled(t, root, "product_months").groupBy("product_id").agg(
        money_sum("revenue", here).alias("month_revenue"), unit_sum("units", here).alias("month_units"), money_sum("revenue").alias("all_revenue"),
    )
    excluded = t.products.select(F.col("id").alias("product_id"), F.coalesce("excluded_from_revenue", F.lit(False)).alias("excluded"))
    sales = sales.join(excluded, "product_id", "left")

    def counted(name: str) -> Column:
        return or_zero(F.sum(F.when(~F.col("excluded"), F.col(name)))).alias(name)

    return sales.agg(counted("month_revenue"), F.coalesce(F.sum("month_units"), F.lit(0).cast("long")).alias("month_units"), counted("all_revenue"))
