"""Applying batches of change records to table snapshots.

Each function takes a snapshot and a batch and returns the new snapshot (or the rows to append) and
the rejected records with the first rule they break. Nothing is updated in place: the caller writes
the new snapshot to a fresh directory.

Several changes to one key in a batch: the last valid one wins, found with a partial aggregate, so
a key that appears in a third of the batch is no hot task.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.money import AMOUNT, money_sum
from tallybook.functions.text import pay_handle
from tallybook.operators import rules as R
from tallybook.operators.claims import settle
from tallybook.session import stage

# Fixed values.
PAYMENT_NOTE = "Zahlung"
ADJUSTMENT_NOTE = "Konto-Korrektur"
DELETE_REASON = "Fehlbuchung"
MIGRATION_NOTE = "Migration: vorher als bezahlt markierte Entnahmen"


@dataclass(frozen=True)
class Applied:
    """Result of a batch: what was accepted and what was not, with the reason."""

    accepted: DataFrame
    rejected: DataFrame


@dataclass(frozen=True)
class Toggled:
    """Set after a batch of toggles, toggles of unknown items, and where a stream keeps them the set's numbers per item."""

    state: DataFrame
    rejected: DataFrame
    counts: DataFrame | None = None


def split(batch: DataFrame, reason: Column) -> Applied:
    """Split a batch by the reason for rejection, null for valid records."""
    checked = batch.withColumn("reason", reason)
    return Applied(checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull()))


def known(batch: DataFrame, column: str, parents: DataFrame, flag: str, parent_id: str = "id") -> DataFrame:
    """Add a flag: does the reference exist? The parents' ids are unique."""
    ids = parents.select(F.col(parent_id).alias(column), F.lit(True).alias(flag))
    return batch.join(ids, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _per_key(rows: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    """One row per key: the extreme of the whole row with the order columns in front.

    Rows that tie on the order are told apart by their other columns, so a re-run picks the same.
    """
    others = [c for c in rows.columns if c not in keys and c not in order]
    picked = rows.groupBy(*keys).agg(pick(F.struct(*(c for c in order if c not in keys), *others)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*rows.columns)


def latest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key."""
    return _per_key(rows, keys, order, F.max)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key."""
    return _per_key(rows, keys, order, F.min)


def upsert_latest(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or overwrite by key; a changed row replaces the stored one whole."""
    latest = latest_wins(changes, keys, order).select(*base.columns)
    return base.join(latest, keys, "left_anti").unionByName(latest)


def apply_changes(base: DataFrame, changes: DataFrame, key: str, order: list[str], merge: dict[str, Column]) -> DataFrame:
    """Insert or update by key with the last change per key.

    ``merge`` gives each column of the snapshot as an expression over ``old`` and ``new``; columns
    without one keep the old value. Changes are the right side of both joins with the snapshot, so a
    small batch is broadcast and a large snapshot is not shuffled for it.
    """
    latest = latest_wins(changes, [key], order)
    new = latest.select(F.col(key), F.struct(*latest.columns).alias("new"))
    old = base.select(F.col(key), F.struct(*base.columns).alias("old"))
    present = base.select(key).join(latest.select(key), key, "left_semi")
    no_row = F.lit(None).cast(old.schema["old"].dataType)
    inserted = new.join(present, key, "left_anti").select(key, no_row.alias("old"), "new")
    joined = old.join(new, key, "left").unionByName(inserted)
    columns = [F.col(key)]
    for name in base.columns:
        if name != key:
            kept = F.when(F.col("new").isNull(), F.col("old")[name])
            changed = merge.get(name, F.col("old")[name])
            columns.append(kept.otherwise(changed).cast(base.schema[name].dataType).alias(name))
    return joined.select(*columns).select(*base.columns)


def _new(name: str) -> Column:
    return F.col("new")[name]


def _old(name: str) -> Column:
    return F.col("old")[name]


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def _stamps(order: list[str]) -> dict[str, Column]:
    """Creation time of a new row and time of the last change."""
    return {"created_at": F.coalesce(_old("created_at"), _new(order[0])), "updated_at": _new(order[0])}


# members, categories, products ------------------------------------------------------------------


def apply_user_changes(users: DataFrame, changes: DataFrame, order: list[str], strict: bool = False) -> Applied:
    """Insert or overwrite members by id, as if the changes came one after the other.

    Keys are unique ignoring case: a change is rejected if another member holds its key at that moment. Of several
    valid changes to one member the last one shows in the snapshot; every other change is among the rejected.
    """
    checked = split(changes, R.first_broken(R.user_rules(strict)))
    key = F.trim("user_key")
    claims = checked.accepted.withColumn("user_key", F.lower(key) if strict else key).withColumn("_key", F.lower("user_key"))
    settled = _settle_keys(users, claims, order)
    names = changes.columns
    snapshot = apply_changes(
        users, settled.where("_ok").select(*names), "id", order,
        {
            "user_key": _new("user_key"), "name": F.trim(_new("name")), "role": _new("role"),
            "active": _or(_new("active"), True), **_stamps(order),
        },
    )
    taken = settled.where(~F.col("_ok")).select(*names, F.lit("user_key_taken").alias("reason"))
    return Applied(snapshot, checked.rejected.unionByName(taken))


def _settle_keys(users: DataFrame, claims: DataFrame, order: list[str]) -> DataFrame:
    """The claims with a flag ``_ok``: did nobody else hold the key when the claim was made?"""
    claims = claims.withColumn("_at", F.struct(*order))
    keys, members = claims.select("_key").distinct(), claims.select("id").distinct()
    stored = users.select("id", F.lower("user_key").alias("_key"))
    stored = stored.join(keys, "_key", "left_semi").unionByName(stored.join(members, "id", "left_semi")).distinct()
    return claims.join(settle(stored, claims), ["id", "_key", "_at"])


def deactivate_users(users: DataFrame, requests: DataFrame, balances: DataFrame, order: list[str]) -> Applied:
    """Deactivate the requested members; a balance other than 0 or being the last active admin prevents it.

    Requests count in their order, several for one member as the first. Admins go until one active one is left: only
    if all active admins could go, the last of them stays.
    """
    first = first_wins(requests.select("id", *order), ["id"], order)
    known_users = users.select("id", "role", "active")
    amounts = balances.select(F.col("user_id").alias("id"), "balance")
    asked = first.join(known_users, "id", "left").join(amounts, "id", "left")
    admin = (F.col("role") == "admin") & F.col("active")
    reason = (
        F.when(F.col("role").isNull(), "user_unknown")
        .when(F.coalesce("balance", F.lit(0)) != 0, "balance_not_zero")
    )
    asked = asked.withColumn("reason", reason)
    going = asked.where(admin & F.col("reason").isNull()).agg(F.count("*").alias("n"), F.max_by("id", F.struct(*order, "id")).alias("last"))
    admins = users.agg(F.count(F.when(admin, 1)).alias("n")).scalar()
    stays = F.coalesce(going.select((F.col("n") >= admins).alias("all")).scalar() & admin & (F.col("id") == going.select("last").scalar()), F.lit(False))
    idle_admin = (F.col("role") == "admin") & ~F.col("active") & (admins == 0)
    asked = asked.withColumn("reason", F.when(F.col("reason").isNull() & (stays | idle_admin), "last_admin").otherwise(F.col("reason")))
    gone = asked.where("reason is null").select("id", F.col(order[0]).alias("_at"))
    changed = {"active": F.col("active") & F.col("_at").isNull(), "updated_at": F.coalesce("_at", "updated_at")}
    snapshot = users.join(gone, "id", "left").withColumns(changed).select(*users.columns)
    return Applied(snapshot, asked.where("reason is not null").select("id", *order, "reason"))


def deactivate_products(products: DataFrame, requests: DataFrame, order: list[str]) -> DataFrame:
    """Products with the requested ones inactive, whether they were bought or not."""
    first = first_wins(requests.select("id", *order), ["id"], order).select("id", F.col(order[0]).alias("_at"))
    changed = {"active": F.col("active") & F.col("_at").isNull(), "updated_at": F.coalesce("_at", "updated_at")}
    return products.join(first, "id", "left").withColumns(changed).select(*products.columns)


def apply_category_changes(categories: DataFrame, changes: DataFrame, order: list[str]) -> Applied:
    """Insert or update categories by id; a missing icon keeps the old one."""
    checked = split(changes, R.first_broken(R.category_rules()))
    snapshot = _apply_sequence(
        categories, checked.accepted, order, kept=["icon_data_url"],
        merge={"title": F.trim(_new("title")), "active": _or(_new("active"), True)},
    )
    return Applied(snapshot, checked.rejected)


def apply_product_changes(products: DataFrame, changes: DataFrame, order: list[str]) -> Applied:
    """Insert or update products by id; a missing icon keeps the old one, a missing text empties it."""
    checked = split(changes, R.first_broken(R.product_rules()))
    snapshot = _apply_sequence(
        products, checked.accepted, order, kept=["icon_data_url"],
        merge={
            "name": F.trim(_new("name")), "description": _or(_new("description"), ""),
            "price": F.round(_new("price"), 2).cast(AMOUNT), "category_id": _new("category_id"),
            "active": _or(_new("active"), True),
            "excluded_from_revenue": _or(_new("excluded_from_revenue"), False),
        },
    )
    return Applied(snapshot, checked.rejected)


def _apply_sequence(base, changes, order, kept: list[str], merge: dict[str, Column]) -> DataFrame:
    """Apply changes where some columns keep their value unless a change gives one.

    Such a column ends at the last non-null value in the batch, else the stored one, else ''.
    """
    rank = F.struct(*order)
    for name in kept:
        given = F.max_by(name, F.when(F.col(name).isNotNull(), rank))
        values = changes.groupBy("id").agg(given.alias(f"_kept_{name}"))
        changes = changes.join(values, "id")
        merge[name] = F.coalesce(_new(f"_kept_{name}"), _old(name), F.lit(""))
    return apply_changes(base, changes, "id", order, {**merge, **_stamps(order)})


# ledger -----------------------------------------------------------------------------------------


def priced_bookings(requests: DataFrame, products: DataFrame) -> Applied:
    """Bookings at the current price of an active product; the quantity is at least 1."""
    prices = products.where("active").select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), F.col("price").alias("unit_price")
    )
    priced = requests.join(prices, "product_id", "left").withColumn("quantity", F.greatest("quantity", F.lit(1)))
    checked = split(priced, F.when(F.col("unit_price").isNull(), "product_unknown_or_inactive"))
    total = (F.col("quantity") * F.col("unit_price")).cast(AMOUNT)
    return Applied(checked.accepted.withColumn("total", total), checked.rejected.drop("product_name", "unit_price"))


def soft_delete_entries(entries: DataFrame, requests: DataFrame, trim_reason: bool = False) -> DataFrame:
    """Mark purchases as deleted; a purchase already deleted keeps its first deletion."""
    reason = F.trim("reason") if trim_reason else F.col("reason")
    asked = requests.select(
        "id", F.col("deleted_at").alias("_at"), F.col("deleted_by").alias("_by"),
        F.coalesce(reason, F.lit(DELETE_REASON)).alias("_reason"),
    )
    first = first_wins(asked, ["id"], ["_at", "_by", "_reason"])
    hit = F.col("deleted_at").isNull() & F.col("_at").isNotNull()
    changed = {
        "deleted_at": F.when(hit, F.col("_at")).otherwise(F.col("deleted_at")),
        "deleted_by": F.when(hit, F.col("_by")).otherwise(F.col("deleted_by")),
        "deleted_reason": F.when(hit, F.col("_reason")).otherwise(F.col("deleted_reason")),
    }
    return entries.join(first, "id", "left").withColumns(changed).select(*entries.columns)


def mark_paid(entries: DataFrame, members: DataFrame, paid_at: dt.datetime) -> DataFrame:
    """Set all unpaid purchases of the given members paid."""
    chosen = members.select("user_id").distinct().withColumn("_chosen", F.lit(True))
    hit = F.col("_chosen").isNotNull() & ~F.col("paid")
    time = F.lit(paid_at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    changed = {
        "paid": F.col("paid") | F.col("_chosen").isNotNull(),
        "paid_at": F.when(hit, time).otherwise(F.col("paid_at")),
    }
    return entries.join(chosen, "user_id", "left").withColumns(changed).select(*entries.columns)


def mark_paid_counts(entries: DataFrame, members: DataFrame) -> DataFrame:
    """How many purchases ``mark_paid`` would change per given member."""
    unpaid = entries.where(~F.col("paid")).groupBy("user_id").agg(F.count("*").alias("n"))
    chosen = members.select("user_id").distinct()
    return chosen.join(unpaid, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("marked"))


def post_payments(posts: DataFrame, users: DataFrame, default_note: str = PAYMENT_NOTE) -> Applied:
    """Payments to append; the amount must be positive before and after rounding.

    The second version stored an empty note instead of the default one.
    """
    return _post(posts, users, R.payment_rules(), default_note)


def post_adjustments(posts: DataFrame, users: DataFrame) -> Applied:
    """Corrections to append; the amount must not be 0 before rounding."""
    return _post(posts, users, R.adjustment_rules(), ADJUSTMENT_NOTE)


def _post(posts: DataFrame, users: DataFrame, rules: list[R.Rule], note: str) -> Applied:
    flagged = known(posts, "user_id", users, "_member")
    checked = split(flagged, R.first_broken([*rules, ("user_unknown", ~F.col("_member"))]))
    stored = {"amount": F.round("amount", 2).cast(AMOUNT), "note": F.coalesce("note", F.lit(note))}
    return Applied(
        checked.accepted.withColumns(stored).select(*posts.columns), checked.rejected.select(*posts.columns, "reason")
    )


def balances_after(balances: DataFrame, accepted: DataFrame, amount: str = "amount") -> DataFrame:
    """New balance of each member the accepted records touch."""
    added = accepted.groupBy("user_id").agg(money_sum(amount).alias("_added"))
    joined = balances.join(added, "user_id")
    return joined.select("user_id", (F.col("balance") + F.col("_added")).cast("decimal(28,2)").alias("balance"))


def paid_flag_migration(t) -> DataFrame:
    """Opening payments from the old paid flag, one per member.

    Deleted purchases count too. If any payment already has the marker note, nobody is migrated.
    """
    done = t.payments.where(F.col("note") == MIGRATION_NOTE).agg(F.count("*").alias("n")).scalar()
    return (
        t.entries.where("paid").groupBy("user_id").agg(money_sum("total").alias("amount"))
        .where(done == 0)
        .select("user_id", "amount", F.lit(MIGRATION_NOTE).alias("note"))
    )


# settings, read marks, toggles ------------------------------------------------------------------


def clean_setting_changes(changes: DataFrame) -> Applied:
    """Pay handles reduced to the bare name; invalid ones rejected, an empty one clears the setting."""
    cleaned = changes.withColumn("value", pay_handle("value"))
    return split(cleaned, R.first_broken(R.setting_rules()))


def toggle_state(toggles: DataFrame, item: str, parents: DataFrame, base: DataFrame | None = None) -> Toggled:
    """Set of (item, user) pairs after toggles: a pair is in it iff it was switched an odd number of times.

    Toggles are counted per pair before the items are looked up. ``base`` is the set before the
    batch; ``created_at`` is the time of the last toggle.
    """
    rows = toggles.select(item, "user_id", "created_at")
    if base is not None:
        rows = rows.unionByName(base.select(*rows.columns))
    pairs = rows.groupBy(item, "user_id").agg(F.count("*").alias("_n"), F.max("created_at").alias("created_at"))
    ids = parents.select(F.col("id").alias(item))
    state = pairs.where("_n % 2 = 1").drop("_n").join(ids, item, "left_semi")
    rejected = pairs.join(ids, item, "left_anti").select(item, "user_id", F.col("_n").alias("toggles"))
    return Toggled(state, rejected)


def set_status(suggestions: DataFrame, changes: DataFrame, order: list[str]) -> Applied:
    """Last valid status per suggestion; unknown suggestions and unknown states are rejected."""
    bad = ~F.coalesce(F.col("status"), F.lit("")).isin(*R.STATUSES)
    flagged = known(changes, "id", suggestions, "_found")
    checked = split(flagged, R.first_broken([("status_invalid", bad), ("suggestion_unknown", ~F.col("_found"))]))
    latest = latest_wins(checked.accepted.select("id", "status", *order), ["id"], order)
    latest = latest.select("id", F.col("status").alias("_status"), F.col(order[0]).alias("_at"))
    changed = {"status": F.coalesce("_status", "status"), "updated_at": F.coalesce("_at", "updated_at")}
    snapshot = suggestions.join(latest, "id", "left").withColumns(changed).select(*suggestions.columns)
    return Applied(snapshot, checked.rejected.select(*changes.columns, "reason"))


# community --------------------------------------------------------------------------------------


def add_suggestions(posts: DataFrame) -> Applied:
    """New suggestions: title and text trimmed, state open."""
    checked = split(posts.withColumn("status", F.lit("open")), R.first_broken(R.suggestion_rules()))
    texts = {"title": F.trim("title"), "description": F.trim(F.coalesce("description", F.lit("")))}
    return Applied(checked.accepted.withColumns(texts), checked.rejected)


def add_news(posts: DataFrame) -> Applied:
    """New posts: lengths are checked on the raw text, the stored text is trimmed."""
    checked = split(posts, R.first_broken(R.news_rules()))
    texts = {
        "title": F.trim("title"), "body": F.trim("body"),
        "image_data_url": F.coalesce("image_data_url", F.lit("")),
    }
    return Applied(checked.accepted.withColumns(texts), checked.rejected)


def author_read_marks(reads: DataFrame, accepted: DataFrame) -> DataFrame:
    """Read marks after publishing: an author has seen everything up to the last own post.

    A post overwrites the mark even if the stored one is later, as the last write wins.
    """
    own = accepted.groupBy(F.col("created_by").alias("user_id")).agg(F.max("created_at").alias("last_seen_at"))
    return reads.join(own, "user_id", "left_anti").unionByName(own.select(*reads.columns))


def add_comments(posts: DataFrame, news: DataFrame) -> Applied:
    """New comments on existing posts, trimmed."""
    flagged = known(posts, "news_id", news, "_found")
    checked = split(flagged, R.first_broken([("news_unknown", ~F.col("_found")), *R.comment_rules()]))
    return Applied(
        checked.accepted.withColumn("body", F.trim("body")).select(*posts.columns),
        checked.rejected.select(*posts.columns, "reason"),
    )


def moderate_comments(comments: DataFrame, requests: DataFrame, users: DataFrame) -> Applied:
    """Delete requests allowed to the comment's author and to active admins.

    Returns the remaining comments and the refused requests.
    """
    owners = comments.select(F.col("id").alias("comment_id"), F.col("user_id").alias("owner"))
    roles = users.where("active").select(F.col("id").alias("requested_by"), "role")
    judged = requests.join(roles, "requested_by", "left").join(owners, "comment_id", "left")
    checked = split(
        judged,
        R.first_broken([
            ("requester_unknown", F.col("role").isNull()),
            ("comment_unknown", F.col("owner").isNull()),
            ("not_allowed", (F.col("owner") != F.col("requested_by")) & (F.col("role") != "admin")),
        ]),
    )
    granted = checked.accepted.select(F.col("comment_id").alias("id")).distinct()
    return Applied(comments.join(granted, "id", "left_anti"), checked.rejected.select(*requests.columns, "reason"))


def cascade_delete(children: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    """Children that remain after their parents were deleted."""
    gone = deleted.select(F.col("id").alias(column)).distinct()
    return children.join(gone, column, "left_anti")


# schema -----------------------------------------------------------------------------------------


def insert_if_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the table yet, one per key."""
    wanted = rows.dropDuplicates(keys)
    present = base.select(*keys).join(wanted.select(*keys), keys, "left_semi").distinct()
    return wanted.join(present, keys, "left_anti")
