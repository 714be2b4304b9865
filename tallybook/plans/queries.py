"""Registered queries: a name and a function from the bound tables to a DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.operators import (
    balance, catalog, changes, community, members, movements, profile, revenue, rules, statement,
)
from tallybook.operators import rolled
from tallybook.operators.evolve import evolve_products
from tallybook.session import fresh_dir
from tallybook.sources.bind import AS_OF, BoundTables, post_time
from tallybook.sources.rollups import close_months, touched_months
from tallybook.sources.schemas import SCHEMAS
from tallybook.streaming import jobs

PRINTED_AT = dt.datetime(2000, 6, 15, 12, 30)
VIEWER = 7
EVENT_ORDER = ["changed_at", "event_id"]

Query = Callable[[BoundTables], DataFrame]


def _scan(table: str) -> Query:
    return lambda t: getattr(t, table).select(*SCHEMAS[table].names)


def _columns(frame: DataFrame, *names: str) -> DataFrame:
    return frame.select(*names)


def _booked(t: BoundTables) -> changes.Applied:
    return changes.priced_bookings(t.booking_requests, t.products)


def _balances_after_payments(t: BoundTables) -> DataFrame:
    posted = changes.post_payments(t.payment_posts, t.users).accepted
    return changes.balances_after(balance.account_balance(t), posted)


def _deleted_entries(t: BoundTables) -> DataFrame:
    return changes.soft_delete_entries(t.entries, t.deletion_requests).select(
        "id", "user_id", "deleted_at", "deleted_by", "deleted_reason"
    )


def _user_changes(t: BoundTables) -> changes.Applied:
    return changes.apply_user_changes(t.users, t.user_changes, EVENT_ORDER)


def _category_changes(t: BoundTables) -> changes.Applied:
    return changes.apply_category_changes(t.categories, t.category_changes, EVENT_ORDER)


def _product_changes(t: BoundTables) -> changes.Applied:
    return changes.apply_product_changes(t.products, t.product_changes, EVENT_ORDER)


def _status(t: BoundTables) -> changes.Applied:
    return changes.set_status(t.suggestions, t.status_changes, EVENT_ORDER)


def _moderated(t: BoundTables) -> changes.Applied:
    return changes.moderate_comments(t.news_comments, t.moderation_requests, t.users)


def _comment_posts(t: BoundTables) -> changes.Applied:
    return changes.add_comments(t.news_comments.drop("turn"), t.news)


def _comment_items(t: BoundTables) -> DataFrame:
    items = community.comment_threads(t).select("news_id", F.inline("items"))
    return items.select("news_id", "position", "id", "user_id", "author_name", "body", "created_at")


def _month_items(t: BoundTables) -> DataFrame:
    items = profile.account_month_items(t, AS_OF).select("user_id", F.inline("items"))
    return items.select("user_id", "position", *profile.ITEM_FIELDS)


def _booking_stream(t: BoundTables) -> changes.Applied:
    return changes.priced_bookings(t.bookings(t.events("purchase", stream=True)), t.products)


def _stream_bookings(t: BoundTables) -> DataFrame:
    movement = _booking_stream(t).accepted.select(
        "id", "user_id", "created_at", F.lit("entry").alias("kind"), (-F.col("total")).cast("decimal(10,2)").alias("amount")
    )
    return jobs.stream_bookings(movement, balance.account_balance(t), fresh_dir(t.spark, "stream-bookings"))


def _with_strays(toggles: DataFrame, t: BoundTables, stream: bool = False) -> DataFrame:
    """Toggles and, from other events, some of items that were never posted (negative ids)."""
    strays = t.events("view", stream=stream).selectExpr("-1 - k as item", "user_id", "ts as created_at")
    return toggles.unionByName(strays.withColumnRenamed("item", toggles.columns[0]))


def _stream_toggles(t: BoundTables, strays: bool = False) -> changes.Toggled:
    source = t.events("click", stream=True).selectExpr("k as news_id", "user_id", "ts as created_at")
    source = _with_strays(source, t, stream=True) if strays else source
    return jobs.stream_toggles(source, "news_id", t.news, fresh_dir(t.spark, "stream-toggles"))


def _stream_unread(t: BoundTables) -> DataFrame:
    reads = t.events("view", stream=True).selectExpr("'read' as kind", "user_id", "ts as created_at")
    posts = t.stream("documents").selectExpr("'news' as kind", "doc_id", f"{post_time('doc_id')} as created_at")
    posts = posts.select("kind", t.member_number("doc_id").alias("user_id"), "created_at")
    members = t.users.select(F.col("id").alias("user_id"))
    return jobs.stream_unread(reads.unionByName(posts), members, fresh_dir(t.spark, "stream-unread"))


def _deactivated(t: BoundTables) -> changes.Applied:
    requests = t.user_changes.select("id", *EVENT_ORDER).unionByName(
        t.users.where("role = 'admin'").select("id", F.col("updated_at").alias("changed_at"), F.col("id").alias("event_id"))
    )
    return changes.deactivate_users(t.users, requests, balance.account_balance(t), EVENT_ORDER)


def _closed(t: BoundTables) -> str:
    """A folder in which every month of the ledgers before the current one is closed."""
    times = t.entries.select("created_at").unionByName(t.payments.select("created_at")).unionByName(t.adjustments.select("created_at"))
    root = fresh_dir(t.spark, "closed")
    close_months(t, root, [month for month in touched_months(times) if month < AS_OF.replace(day=1)])
    return root


QUERIES: dict[str, Query] = {
    **{f"scan_{table}": _scan(table) for table in SCHEMAS},
    "setting_value": catalog.setting_value,
    "active_categories": catalog.active_categories,
    "active_catalog": catalog.active_catalog,
    "catalog_admin": catalog.catalog_admin,
    "categories_admin": catalog.categories_admin,
    "month_entries": lambda t: movements.month_entries(t, AS_OF),
    "category_products": catalog.category_products,
    "category_tiles": catalog.category_tiles,
    "category_product_count": catalog.category_product_count,
    "product_delete_plan": catalog.product_delete_plan,
    "detach_category": lambda t: _columns(
        catalog.detach_category(t, t.deleted_categories)[0], "id", "name", "category_id", "active"
    ),
    "detach_category_categories": lambda t: _columns(
        catalog.detach_category(t, t.deleted_categories)[1], "id", "title", "active"
    ),
    "account_balance": balance.account_balance,
    "account_balance_legacy": lambda t: balance.account_balance(t, corrections=False),
    "users_with_balance": balance.users_with_balance,
    "detach_category_removed": lambda t: _columns(
        catalog.detach_category(t, t.deleted_categories, remove=True)[1], "id", "title", "active"
    ),
    "account_overview": lambda t: balance.account_overview(t, AS_OF),
    "open_paid_totals": balance.open_paid_totals,
    "low_balance_accounts": balance.low_balance_accounts,
    "balance_class": balance.balance_class,
    "deletable_users": balance.deletable_users,
    "balance_check": balance.balance_check,
    "revenue_summary": lambda t: revenue.revenue_summary(t, AS_OF),
    "product_analysis": lambda t: revenue.product_analysis(t, AS_OF),
    "category_analysis": lambda t: revenue.category_analysis(t, AS_OF),
    "analysis_legacy": lambda t: revenue.legacy_products(t, AS_OF),
    "analysis_legacy_categories": lambda t: revenue.legacy_categories(t, AS_OF),
    "analysis_legacy_totals": lambda t: revenue.legacy_totals(t, AS_OF),
    "product_bar_share": lambda t: revenue.product_bar_share(t, AS_OF),
    "entries_enriched": movements.entries_enriched,
    "movements": movements.movements,
    "other_movements": movements.other_movements,
    "recent_entries": movements.recent_entries,
    "recent_entries_first_version": lambda t: movements.recent_entries(t, 20),
    "recent_payments": movements.recent_payments,
    "recent_adjustments": movements.recent_adjustments,
    "recent_movements": movements.recent_movements,
    "running_balance": movements.running_balance,
    "running_balance_as_booked": lambda t: movements.running_balance(t, "as_booked"),
    "account_month_dashboard": lambda t: profile.account_month_dashboard(t, AS_OF),
    "account_month_items": _month_items,
    "user_month_detail": lambda t: profile.user_month_detail(t, AS_OF),
    "account_document": lambda t: profile.document_items(profile.account_document(t)),
    "statement_lines": lambda t: statement.statement_lines(t, PRINTED_AT),
    "statement_pages": lambda t: statement.statement_pages(t, PRINTED_AT),
    "user_keys_generated": lambda t: members.user_keys_generated(t.named_users),
    "duplicate_user_keys": lambda t: members.duplicate_user_keys(
        t.named_users.withColumn("user_key", F.col("name"))
    ),
    "suggestion_board": lambda t: community.suggestion_board(t, VIEWER),
    "suggestions_open": lambda t: community.suggestions_open(t, VIEWER),
    "suggestions_decided": lambda t: community.suggestions_decided(t, VIEWER),
    "user_voted": community.user_voted,
    "user_liked": community.user_liked,
    "vote_counts": community.vote_counts,
    "like_counts": community.like_counts,
    "news_feed": lambda t: community.news_feed(t, VIEWER),
    "news_feed_comments": _comment_items,
    "news_unread": community.news_unread,
    "rule_violations": rules.rule_violations,
    "rule_violation_counts": rules.rule_violation_counts,
    "insert_if_absent": lambda t: changes.insert_if_absent(t.categories, t.found_titles, ["title"]),
    "priced_bookings": lambda t: _booked(t).accepted,
    "priced_bookings_rejected": lambda t: _booked(t).rejected,
    "cascade_delete": lambda t: changes.cascade_delete(t.news_likes, "news_id", t.deleted_news),
    "cascade_delete_comments": lambda t: changes.cascade_delete(
        t.news_comments.drop("turn"), "news_id", t.deleted_news
    ),
    "apply_user_changes": lambda t: _user_changes(t).accepted,
    "apply_user_changes_rejected": lambda t: _columns(_user_changes(t).rejected, "id", "event_id", "reason"),
    "apply_category_changes": lambda t: _category_changes(t).accepted,
    "apply_category_changes_rejected": lambda t: _columns(_category_changes(t).rejected, "id", "event_id", "reason"),
    "apply_product_changes": lambda t: _product_changes(t).accepted,
    "apply_product_changes_rejected": lambda t: _columns(_product_changes(t).rejected, "id", "event_id", "reason"),
    "soft_delete_entries": _deleted_entries,
    "mark_paid": lambda t: changes.mark_paid_counts(t.entries, t.paid_members),
    "mark_paid_entries": lambda t: changes.mark_paid(t.entries, t.paid_members, PRINTED_AT).select(
        "id", "user_id", "paid", "paid_at"
    ),
    "paid_flag_migration": changes.paid_flag_migration,
    "post_payments": lambda t: changes.post_payments(t.payment_posts, t.users).accepted,
    "post_payments_rejected": lambda t: changes.post_payments(t.payment_posts, t.users).rejected.select("id", "reason"),
    "post_payments_balances": _balances_after_payments,
    "post_adjustments": lambda t: changes.post_adjustments(t.adjustment_posts, t.users).accepted,
    "post_adjustments_rejected": lambda t: changes.post_adjustments(t.adjustment_posts, t.users).rejected.select(
        "id", "reason"
    ),
    "latest_wins": lambda t: changes.latest_wins(t.read_marks, ["user_id"], ["last_seen_at"]),
    "clean_setting_changes": lambda t: changes.clean_setting_changes(t.setting_changes).accepted,
    "clean_setting_changes_rejected": lambda t: changes.clean_setting_changes(t.setting_changes).rejected,
    "toggle_state": lambda t: t.news_likes,
    "toggle_state_rejected": lambda t: changes.toggle_state(
        _with_strays(t.vote_toggles, t), "suggestion_id", t.suggestions
    ).rejected,
    "set_status": lambda t: _columns(_status(t).accepted, "id", "title", "status", "updated_at"),
    "set_status_rejected": lambda t: _columns(_status(t).rejected, "id", "event_id", "status", "reason"),
    "add_suggestions": lambda t: changes.add_suggestions(t.suggestion_posts).accepted,
    "add_news": lambda t: changes.add_news(t.news).accepted.select("id", "title", "body", "created_by", "created_at"),
    "add_news_rejected": lambda t: changes.add_news(t.news).rejected.select("id", "reason"),
    "add_news_read_marks": lambda t: changes.author_read_marks(t.news_reads, changes.add_news(t.news).accepted),
    "add_comments": lambda t: _comment_posts(t).accepted,
    "add_comments_rejected": lambda t: _columns(_comment_posts(t).rejected, "id", "news_id", "reason"),
    "moderate_comments": lambda t: _columns(_moderated(t).accepted, "id", "news_id", "user_id", "created_at"),
    "moderate_comments_rejected": lambda t: _moderated(t).rejected,
    "schema_evolution": lambda t: evolve_products(t.first_version_products, t.categories),
    "stream_bookings": _stream_bookings,
    "stream_bookings_rejected": lambda t: jobs.stream_rows(_booking_stream(t).rejected, fresh_dir(t.spark, "stream-rejected")),
    "stream_toggles": lambda t: _stream_toggles(t).state,
    "stream_toggles_rejected": lambda t: _stream_toggles(t, strays=True).rejected,
    "stream_toggles_counts": lambda t: _stream_toggles(t).counts,
    "deactivate_users": lambda t: _columns(_deactivated(t).accepted, "id", "role", "active", "updated_at"),
    "deactivate_users_rejected": lambda t: _columns(_deactivated(t).rejected, "id", "event_id", "reason"),
    "deactivate_products": lambda t: _columns(
        changes.deactivate_products(t.products, t.product_changes, EVENT_ORDER), "id", "active", "updated_at"
    ),
    "post_adjustments_balances": lambda t: changes.balances_after(
        balance.account_balance(t), changes.post_adjustments(t.adjustment_posts, t.users).accepted
    ),
    "add_suggestions_rejected": lambda t: _columns(changes.add_suggestions(t.suggestion_posts).rejected, "id", "reason"),
    "cascade_delete_votes": lambda t: changes.cascade_delete(
        t.suggestion_votes, "suggestion_id", t.suggestions.where("status = 'rejected'")
    ),
    "cascade_delete_reads": lambda t: changes.cascade_delete(t.news_reads, "user_id", t.users.where("not active")),
    "recent_entries_last5": lambda t: movements.recent_entries(t, 5),
    "recent_payments_last2": lambda t: movements.recent_payments(t, 2),
    "recent_movements_last10": lambda t: movements.recent_movements(t, 10),
    "stream_unread": _stream_unread,
    "account_balance_closed": lambda t: rolled.account_balance(t, _closed(t)),
    "revenue_summary_closed": lambda t: rolled.revenue_summary(t, _closed(t), AS_OF),
}
