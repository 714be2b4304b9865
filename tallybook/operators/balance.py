"""Account balances and the member lists built on them.

Credit is positive, debt negative: payments + corrections − live purchases. Products left out of
revenue still debit the account, and the old ``paid`` flag plays no part.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import TOTAL, amount_due, money_sum, or_zero
from tallybook.functions.months import in_month
from tallybook.functions.text import pay_link
from tallybook.operators.catalog import setting
from tallybook.operators.movements import LOW_BALANCE, live, signed_amounts


def member_totals(t, corrections: bool = True) -> DataFrame:
    """Balance of every member that has movements: one union, one partial aggregate, one shuffle."""
    return signed_amounts(t, corrections).groupBy("user_id").agg(money_sum("amount").alias("balance"))


def account_balance(t, corrections: bool = True) -> DataFrame:
    """Balance of every member; members without movements have 0.

    The second version knew no corrections: ``corrections=False``.
    """
    members = t.users.select(F.col("id").alias("user_id"))
    totals = member_totals(t, corrections)
    return members.join(totals, "user_id", "left").select("user_id", or_zero("balance").alias("balance"))


def users_with_balance(t, ordered: bool = True) -> DataFrame:
    """Member list with balance, active members first."""
    members = t.users.select("id", "user_key", "name", "role", "active", "created_at")
    totals = member_totals(t).withColumnRenamed("user_id", "id")
    listed = members.join(totals, "id", "left").withColumn("balance", or_zero("balance"))
    return listed.orderBy(F.col("active").desc(), "name", "id") if ordered else listed


def account_overview(t, as_of: dt.date, ordered: bool = True) -> DataFrame:
    """Active members with balance, spending of the month and number of live purchases; lowest first.

    Balance, spending and count come from one aggregate per member over all movements.
    """
    bought = t.entries.where(live()).select(
        "user_id", (-F.col("total")).alias("amount"),
        F.when(in_month("created_at", as_of), F.col("total")).alias("spent"), F.lit(1).alias("entry"),
    )
    blank = [F.lit(None).cast("decimal(10,2)").alias("spent"), F.lit(None).cast("int").alias("entry")]
    rows = bought
    for ledger in (t.payments, t.adjustments):
        rows = rows.unionByName(ledger.select("user_id", "amount", *blank))
    totals = rows.groupBy("user_id").agg(
        money_sum("amount").alias("balance"), money_sum("spent").alias("month_spent"),
        F.count("entry").alias("entries_count"),
    )
    members = t.users.where("active").select(F.col("id").alias("user_id"), "user_key", "name", "role")
    overview = members.join(totals, "user_id", "left").select(
        "user_id", "user_key", "name", "role", or_zero("balance").alias("balance"),
        or_zero("month_spent").alias("month_spent"),
        F.coalesce("entries_count", F.lit(0).cast("bigint")).alias("entries_count"),
    )
    return overview.orderBy("balance", "name", "user_id") if ordered else overview


def open_paid_totals(t, ordered: bool = True) -> DataFrame:
    """First-version overview: open and paid sums by the paid flag, deleted purchases included."""
    totals = t.entries.groupBy("user_id").agg(
        money_sum("total", ~F.col("paid")).alias("open_total"),
        money_sum("total", F.col("paid")).alias("paid_total"),
        F.count("*").alias("entries_count"),
    )
    members = t.users.where("active").select(F.col("id").alias("user_id"), "name", "role")
    overview = members.join(totals, "user_id", "left").select(
        "user_id", "name", "role", or_zero("open_total").alias("open_total"),
        or_zero("paid_total").alias("paid_total"),
        F.coalesce("entries_count", F.lit(0).cast("bigint")).alias("entries_count"),
    )
    return overview.orderBy(F.col("open_total").desc(), "name", "user_id") if ordered else overview


def low_balance_accounts(t) -> DataFrame:
    """Accounts at or below the limit, with the amount due and a pay link."""
    low = account_balance(t).where(F.col("balance") <= LOW_BALANCE).withColumn("due", amount_due("balance"))
    return low.withColumn("pay_link", pay_link(setting(t), "due"))


def balance_class(t) -> DataFrame:
    """Number of accounts in debt (bad), in credit (good) and at zero (neutral)."""
    label = F.when(F.col("balance") < 0, "bad").when(F.col("balance") > 0, "good").otherwise("neutral")
    return account_balance(t).groupBy(label.alias("balance_class")).agg(F.count("*").alias("accounts"))


def deletable_users(t) -> DataFrame:
    """Members that may be deactivated: balance 0, and another active admin remains.

    An inactive member also qualifies; the rule does not look at the member's own state.
    """
    active_admin = (F.col("role") == "admin") & F.col("active")
    admins = t.users.agg(F.count(F.when(active_admin, 1)).alias("n")).scalar()
    members = t.users.select(F.col("id").alias("user_id"), "role", "active")
    others = admins - F.when(active_admin, 1).otherwise(0)
    return (
        members.join(member_totals(t), "user_id", "left")
        .withColumn("other_admins", others.cast("bigint"))
        .where((or_zero("balance") == 0) & ((F.col("role") != "admin") | (F.col("other_admins") >= 1)))
        .select("user_id", "role", "active", or_zero("balance").alias("balance"))
    )


def balance_check(t) -> DataFrame:
    """Ledger invariant as one row: the balances add up to the three ledgers."""
    ledgers = signed_amounts(t).agg(money_sum("amount").alias("ledger_total"))
    accounts = account_balance(t).agg(F.sum("balance").cast(TOTAL).alias("balance_total"))
    return accounts.select("balance_total", ledgers.scalar().alias("ledger_total"))
