"""Bookings with their product, the account movements, recent rows and running balances."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.money import AMOUNT, TOTAL
from tallybook.functions.text import NO_CATEGORY
from tallybook.operators.prefix import asc, desc, running_totals
from tallybook.sources.tables import month_rows

EARLY_CUT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold
SPREAD = 4096  # places among which rows without a product are dealt in a join
LOW_BALANCE = -50  # inclusive
# Texts shown to members.
WARNING = "Dein Konto ist über 50 € im Minus. Bitte bezahlen."

# The one order of movements; ties on time are broken by kind and id.
MOVEMENT_ORDER = [asc("created_at"), asc("kind"), asc("id")]


def live() -> Column:
    """Not soft-deleted."""
    return F.col("deleted_at").isNull()


def product_labels(t) -> DataFrame:
    """Product id, name and category title (null without a category)."""
    categories = t.categories.select(F.col("id").alias("category_id"), F.col("title").alias("category_title"))
    products = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "category_id")
    return products.join(categories, "category_id", "left").drop("category_id")


def with_product(rows: DataFrame, t) -> DataFrame:
    """Left join with the product labels. Rows without a product (null) find none.

    They would all have the same key, so they get one of many places in a second key that is 0 for products.
    """
    place = F.when(F.col("product_id").isNull(), 1 + F.pmod(F.xxhash64("user_id", "created_at"), F.lit(SPREAD))).otherwise(0)
    labels = product_labels(t)
    return rows.withColumn("_place", place).join(labels.withColumn("_place", F.when(F.col("product_id").isNull(), 1).otherwise(0).cast("bigint")), ["product_id", "_place"], "left").drop("_place")


def entries_enriched(t, rows: DataFrame | None = None) -> DataFrame:
    """Every purchase (of ``rows`` if given) with product name and category title; deleted ones stay, flagged."""
    entries = (t.entries if rows is None else rows).select(
        "id", "user_id", "product_id", "quantity", "total", "paid", "deleted_at", "deleted_reason", "created_at"
    )
    return entries.join(product_labels(t), "product_id").drop("product_id")


def month_entries(t, as_of: dt.date) -> DataFrame:
    """Live purchases of one calendar month."""
    return month_rows(t.entries, as_of).where(live()).select(
        "id", "user_id", "product_id", "quantity", "unit_price", "total", "created_at"
    )


def signed_amounts(t, corrections: bool = True) -> DataFrame:
    """All movements reduced to (user_id, created_at, amount): no product join, nothing but numbers."""
    rows = t.entries.where(live()).select("user_id", "created_at", (-F.col("total")).cast(AMOUNT).alias("amount"))
    for ledger in (t.payments, t.adjustments) if corrections else (t.payments,):
        rows = rows.unionByName(ledger.select("user_id", "created_at", F.col("amount").cast(AMOUNT).alias("amount")))
    return rows


_MOVEMENT = ["id", "user_id", "created_at", "kind", "type_label", "title", "note", "amount"]


def narrow_movements(t) -> DataFrame:
    """All movements without product names: live purchases, payments, corrections.

    Operators that sort or cut movements do so on these rows and label what is left.
    """
    bought = t.entries.where(live()).select(
        F.col("id").cast("string").alias("id"), "user_id", "created_at", F.lit("entry").alias("kind"), "product_id",
        F.lit(None).cast("string").alias("note"), (-F.col("total")).cast(AMOUNT).alias("amount"),
    )
    return bought.unionByName(_credits(t, bought.schema["product_id"].dataType))


def _credits(t, product_type) -> DataFrame:
    """Payments and corrections in the columns of ``narrow_movements``."""
    def rows(frame: DataFrame, kind: str) -> DataFrame:
        return frame.select(
            F.col("id").cast("string").alias("id"), "user_id", "created_at", F.lit(kind).alias("kind"),
            F.lit(None).cast(product_type).alias("product_id"), "note", F.col("amount").cast(AMOUNT).alias("amount"),
        )

    return rows(t.payments, "payment").unionByName(rows(t.adjustments, "adjustment"))


def type_label(kind: Column | None = None) -> Column:
    """A movement's kind in words (fixed values)."""
    kind = F.col("kind") if kind is None else kind
    return F.when(kind == "entry", "Kauf").when(kind == "payment", "Zahlung").otherwise("Korrektur")


def label_movements(rows: DataFrame, t) -> DataFrame:
    """Add type, title and note; a purchase shows its product and category. Further columns stay."""
    bought = F.col("kind") == "entry"
    labelled = with_product(rows, t).withColumns({
        "type_label": type_label(),
        "title": F.when(bought, F.col("product_name")).otherwise(type_label()),
        "note": F.when(bought, F.coalesce("category_title", F.lit(NO_CATEGORY))).otherwise(F.col("note")),
    })
    return labelled.select(*_MOVEMENT, *(c for c in rows.columns if c not in (*_MOVEMENT, "product_id")))


def other_movements(t) -> DataFrame:
    """Movements that are not purchases: payments and corrections."""
    return _credits(t, "string").withColumns({"type_label": type_label(), "title": type_label()}).select(*_MOVEMENT)


def movements(t) -> DataFrame:
    """All account movements: live purchases as debits, payments as credits, corrections as signed."""
    return label_movements(narrow_movements(t), t)


def booked_movements(t) -> DataFrame:
    """Movements as they happened: a purchase deleted later counts until its reversal."""
    def step(time: str, kind: str, amount: Column) -> Column:
        return F.struct(F.col(time).alias("created_at"), F.lit(kind).alias("kind"), amount.cast(AMOUNT).alias("amount"))

    booked, reversed_ = step("created_at", "entry", -F.col("total")), step("deleted_at", "reversal", F.col("total"))
    steps = F.when(live(), F.array(booked)).otherwise(F.array(booked, reversed_))
    bought = t.entries.select(F.col("id").cast("string").alias("id"), "user_id", F.inline(steps))
    return bought.unionByName(other_movements(t).select(*bought.columns))


def low_balance_warning(balance: str = "balance") -> Column:
    return F.when(F.col(balance) <= LOW_BALANCE, WARNING)


def running_balance(t, mode: str = "current", pieces: int | None = None) -> DataFrame:
    """Balance after each movement and the low-balance warning.

    ``current`` leaves deleted purchases out; ``as_booked`` counts them until a reversing movement
    at deletion time. Both end at the account balance.
    """
    rows = {"current": narrow_movements, "as_booked": booked_movements}[mode](t)
    rows = rows.select("id", "user_id", "created_at", "kind", "amount")
    result = running_totals(rows, ["user_id"], MOVEMENT_ORDER, sums={"balance": "amount"}, pieces=pieces)
    return result.withColumn("balance", F.col("balance").cast(TOTAL)).withColumn("warning", low_balance_warning())


def _newest(rows: DataFrame, n: int | None, ties: list[str], pieces: int | None = None) -> DataFrame:
    """The newest n rows per member with their ``row_no``; ``None`` keeps and numbers the full history.

    Spark keeps at most n rows per member and task before the shuffle, up to a limit on n; beyond it
    rows are numbered by ranges, so that a heavy member never has to fit into one task.
    """
    if n is not None and n <= EARLY_CUT:
        order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), *ties)
        return rows.withColumn("row_no", F.row_number().over(order)).where(F.col("row_no") <= n)
    order = [desc("created_at"), *(asc(name) for name in ties)]
    numbered = running_totals(rows, ["user_id"], order, row_no="row_no", pieces=pieces)
    kept = numbered if n is None else numbered.where(F.col("row_no") <= n)
    return kept.withColumn("row_no", F.col("row_no").cast("int"))


def recent_entries(t, n: int | None = 80, pieces: int | None = None) -> DataFrame:
    """Newest purchases per member; labels are joined after the cut."""
    entries = t.entries.select(
        F.col("id").cast("string").alias("id"), "user_id", "product_id", "quantity", "total", "paid",
        "deleted_at", "created_at",
    )
    return _newest(entries, n, ["id"], pieces).join(product_labels(t), "product_id").drop("product_id")


def _recent_amounts(rows: DataFrame, n: int | None, pieces: int | None) -> DataFrame:
    rows = rows.select(F.col("id").cast("string").alias("id"), "user_id", "created_at", "amount", "note")
    return _newest(rows, n, ["id"], pieces)


def recent_payments(t, n: int | None = 30, pieces: int | None = None) -> DataFrame:
    return _recent_amounts(t.payments, n, pieces)


def recent_adjustments(t, n: int | None = 30, pieces: int | None = None) -> DataFrame:
    return _recent_amounts(t.adjustments, n, pieces)


def recent_movements(t, n: int | None = 250, pieces: int | None = None) -> DataFrame:
    """Newest movements per member, labelled after the cut."""
    return label_movements(_newest(narrow_movements(t), n, ["kind", "id"], pieces), t)
