"""Documents per member: month dashboard, month detail and the full profile.

The nested lists of a document come in parts of bounded size (see ``prefix.parts``): part 0 holds
the member's figures and the first items, further parts continue the lists. No list is cut off and
none has to fit into one value.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import AMOUNT, TOTAL, money_sum, or_zero
from tallybook.functions.months import in_month, month_label
from tallybook.functions.text import NO_CATEGORY
from tallybook.operators.catalog import setting
from tallybook.operators.movements import entries_enriched, live, other_movements, product_labels, type_label, with_product
from tallybook.operators.prefix import asc, desc, parts, running_totals
from tallybook.sources.tables import month_rows

# Fixed value: the text below the dashboard.
PAY_INFO = "Bitte offene Beträge immer zum 1. eines Monats bezahlen."
PART_SIZE = 1000

ENTRY_FIELDS = ["id", "created_at", "product_name", "category_title", "quantity", "total", "deleted_at"]
LEDGER_FIELDS = ["id", "created_at", "amount", "note"]
MOVEMENT_FIELDS = ["id", "created_at", "kind", "type_label", "title", "note", "amount"]
LISTS = {"entries": ENTRY_FIELDS, "payments": LEDGER_FIELDS, "adjustments": LEDGER_FIELDS, "movements": MOVEMENT_FIELDS}
KIND_LISTS = {"entry": "entries", "payment": "payments", "adjustment": "adjustments"}
ITEM_FIELDS = ["id", "created_at", "product_name", "category_title", "quantity", "total", "icon_data_url"]


def account_month_dashboard(t, as_of: dt.date) -> DataFrame:
    """Balance and this month's spending, payments and corrections of every member.

    All four figures come from one aggregate over the union of the ledgers.
    """
    def rows(frame: DataFrame, column: str, sign: int, name: str) -> DataFrame:
        amount = F.col(column).cast(AMOUNT)
        month = F.when(in_month("created_at", as_of), amount)
        empty = F.lit(None).cast(AMOUNT)
        return frame.select(
            "user_id", (amount * sign).cast(AMOUNT).alias("amount"),
            *((month if name == field else empty).alias(field) for field in ("spent", "paid_in", "corrected")),
        )

    ledger = (
        rows(t.entries.where(live()), "total", -1, "spent")
        .unionByName(rows(t.payments, "amount", 1, "paid_in"))
        .unionByName(rows(t.adjustments, "amount", 1, "corrected"))
    )
    sums = ledger.groupBy("user_id").agg(
        money_sum("amount").alias("balance"), money_sum("spent").alias("month_spent"),
        money_sum("paid_in").alias("month_payments"), money_sum("corrected").alias("month_adjustments"),
    )
    members = t.users.select(F.col("id").alias("user_id"))
    return members.join(sums, "user_id", "left").select(
        "user_id", or_zero("balance").alias("balance"), month_label(as_of).alias("month_label"),
        F.lit(PAY_INFO).alias("pay_info"), setting(t).alias("paypal_me"),
        or_zero("month_spent").alias("month_spent"), or_zero("month_payments").alias("month_payments"),
        or_zero("month_adjustments").alias("month_adjustments"),
    )


def _positions(rows: DataFrame, keys: list[str], ties: list[str], pieces: int | None) -> DataFrame:
    """Newest-first position per key."""
    order = [desc("created_at"), *(asc(name) for name in ties)]
    return running_totals(rows, keys, order, row_no="position", pieces=pieces)


def account_month_items(t, as_of: dt.date, part_size: int = PART_SIZE, pieces: int | None = None) -> DataFrame:
    """The month's live purchases per member, newest first, as nested parts; names and icons are joined after sorting."""
    rows = month_rows(t.entries, as_of).where(live()).select(
        "id", "user_id", "product_id", "quantity", "total", "created_at"
    )
    icons = t.products.select(F.col("id").alias("product_id"), "icon_data_url")
    labels = product_labels(t).join(icons, "product_id")
    labelled = _positions(rows, ["user_id"], ["id"], pieces).join(labels, "product_id")
    return parts(labelled, ["user_id"], "position", ITEM_FIELDS, part_size)


def user_month_detail(t, as_of: dt.date) -> DataFrame:
    """One month's purchases, deleted ones with their reason, and payments, as flat rows."""
    bought = entries_enriched(t, month_rows(t.entries, as_of)).select(
        "user_id", F.lit("entry").alias("kind"), F.col("id").cast("string").alias("id"), "created_at",
        F.col("product_name").alias("title"), F.col("category_title").alias("note"), "quantity",
        F.col("total").alias("amount"), "deleted_at", "deleted_reason",
    )
    paid = month_rows(t.payments, as_of).select(
        "user_id", F.lit("payment").alias("kind"), F.col("id").cast("string").alias("id"), "created_at",
        F.lit("Zahlung").alias("title"), "note", F.lit(None).cast("int").alias("quantity"), "amount",
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"), F.lit(None).cast("string").alias("deleted_reason"),
    )
    return bought.unionByName(paid)


def _ledger_totals(t) -> DataFrame:
    """Balance of every member over all three ledgers, from one aggregate."""
    rows = t.entries.select("user_id", F.when(live(), -F.col("total")).cast(AMOUNT).alias("amount"))
    for ledger in (t.payments, t.adjustments):
        rows = rows.unionByName(ledger.select("user_id", F.col("amount").cast(AMOUNT).alias("amount")))
    return rows.groupBy("user_id").agg(money_sum("amount").alias("balance"))


def _booked_rows(t) -> DataFrame:
    """Purchases, payments and corrections, unlabelled, one row each, with what they add to the lists' positions."""
    bought = t.entries.select(
        F.col("id").cast("string").alias("id"), "user_id", "created_at", F.lit("entry").alias("kind"), "product_id", "quantity",
        "deleted_at", F.lit(None).cast("string").alias("note"), F.col("total").cast(AMOUNT).alias("amount"),
    )
    kinds = bought.schema
    others = other_movements(t).select(
        "id", "user_id", "created_at", "kind",
        *(F.lit(None).cast(kinds[name].dataType).alias(name) for name in ("product_id", "quantity", "deleted_at")), "note", "amount",
    )
    one = {f"_{kind}": (F.col("kind") == kind).cast("int") for kind in KIND_LISTS} | {"_moves": live().cast("int")}
    return bought.unionByName(others).withColumns(one)


def account_document(t, part_size: int = PART_SIZE, pieces: int | None = None) -> DataFrame:
    """One document per member with the full history, in parts.

    Purchases include deleted ones, flagged; movements leave them out. Missing lists are empty. A booking is numbered and
    gathered once, with its positions in the list of its kind and in the movements, as both have the same order; the lists
    are taken from what was gathered. Only where the positions fall into different parts it is two rows. The member's head
    is a further row.
    """
    booked = _booked_rows(t)
    order = [desc("created_at"), asc("kind"), asc("id")]
    counts = {f"{name}_no": name for name in booked.columns if name.startswith("_")}
    kept = [name for name in booked.columns if not name.startswith("_")]
    numbered = running_totals(booked, ["user_id"], order, sums=counts, pieces=pieces, kept=kept)
    own = F.coalesce(*(F.when(F.col("kind") == kind, F.col(f"_{kind}_no")) for kind in KIND_LISTS))
    numbered = numbered.select(*kept, own.alias("_own"), F.when(live(), F.col("_moves_no")).alias("_moved"))
    # payments and corrections have no product to be joined, purchases need neither kind nor note on the way to it
    bought = with_product(numbered.where("kind = 'entry'").drop("kind", "note"), t).drop("product_id")
    # as in every list of purchases, one whose product is unknown is left out; its movement stays
    bought = bought.withColumns({"_own": F.when(F.col("product_name").isNotNull(), F.col("_own")), "kind": F.lit("entry")})
    placed = bought.unionByName(numbered.where("kind <> 'entry'").drop("product_id"), allowMissingColumns=True)

    def part(position: str) -> Column:
        return F.floor((F.col(position) - 1) / part_size).cast("int")

    dealt = placed.withColumns({"_own_part": part("_own"), "_moved_part": part("_moved")}).withColumn(
        "part_no", F.explode(F.array_distinct(F.array_compact(F.array("_own_part", "_moved_part"))))
    )
    positions = (F.when(F.col(f"{p}_part") == F.col("part_no"), F.col(p)).alias(p) for p in ("_own", "_moved"))
    fields = ["kind", "id", "created_at", "product_name", "category_title", "quantity", "amount", "deleted_at", "note"]
    # dealt out as plain rows, which are smaller than lists of structs
    items = dealt.select("user_id", "part_no", *positions, *fields)
    members = t.users.select(F.col("id").alias("user_id"), "user_key", "name", "role", "active")
    head = members.join(_ledger_totals(t), "user_id", "left").select(
        "user_id", F.lit(0).alias("part_no"),
        F.struct("user_key", "name", "role", "active", or_zero("balance").alias("balance")).alias("user"),
    )
    rows = items.unionByName(head, allowMissingColumns=True).repartition("user_id", "part_no")
    item = F.when(F.col("kind").isNotNull(), F.struct("_own", "_moved", *fields))
    gathered = rows.groupBy("user_id", "part_no").agg(F.max("user").alias("user"), F.collect_list(item).alias("_items"))
    return gathered.select("user_id", "part_no", "user", *(_list(name, kind) for kind, name in KIND_LISTS.items()), _list("movements"))


def _list(name: str, kind: str | None = None) -> Column:
    """A list of a document in order, from the bookings gathered for its part: those of one kind, or all movements."""
    def fields(item: Column) -> list[Column]:
        bought = item["kind"] == "entry"
        label = F.coalesce(item["category_title"], F.lit(NO_CATEGORY))
        own = {"total": item["amount"], "position": item["_own" if kind else "_moved"]}
        if not kind:
            own |= {
                "type_label": type_label(item["kind"]), "title": F.when(bought, item["product_name"]).otherwise(type_label(item["kind"])),
                "note": F.when(bought, label).otherwise(item["note"]), "amount": F.when(bought, -item["amount"]).otherwise(item["amount"]).cast(AMOUNT),
            }
        return [(own[field] if field in own else item[field]).alias(field) for field in ("position", *LISTS[name])]

    mine = F.filter("_items", lambda item: item["_own"].isNotNull() & (item["kind"] == kind) if kind else item["_moved"].isNotNull())
    return F.array_sort(F.transform(mine, lambda item: F.struct(*fields(item)))).alias(name)


def document_items(document: DataFrame) -> DataFrame:
    """A document's head and lists flattened to one row per item, with all fields that the lists have.

    The head is the list ``user``: key, name, role, active flag and balance in id, title, kind, note and amount.
    """
    kinds = {
        "position": "bigint", "id": "string", "amount": TOTAL, "created_at": "timestamp_ntz", "kind": "string", "type_label": "string",
        "title": "string", "note": "string", "quantity": "int", "deleted_at": "timestamp_ntz",
    }

    def flat(name: str, values: dict[str, Column]) -> Column:
        return F.struct(F.lit(name).alias("list"), *(values.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()))

    def items(name: str, fields: list[str], **renamed: str) -> Column:
        own = {k: k for k in ("position", *fields)} | renamed
        return F.transform(name, lambda item: flat(name, {k: item[v] for k, v in own.items() if k in kinds}))

    head = {
        "position": F.lit(0), "id": F.col("user.user_key"), "title": F.col("user.name"), "kind": F.col("user.role"),
        "note": F.col("user.active"), "amount": F.col("user.balance"),
    }
    user = F.array(flat("user", head))
    lists = F.concat(
        F.when(F.col("user").isNotNull(), user).otherwise(F.slice(user, 1, 0)),
        items("entries", ENTRY_FIELDS, amount="total", title="product_name", note="category_title"),
        *(items(name, LISTS[name]) for name in ("payments", "adjustments", "movements")),
    )
    return document.select("user_id", F.inline(lists))
