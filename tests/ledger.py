"""Hand-checked micro ledger: five members, five products, eight purchases, each with its trap."""

import datetime as dt
from decimal import Decimal

from tallybook.sources.schemas import SCHEMAS
from tallybook.sources.tables import Tables

AS_OF = dt.date(2024, 3, 15)


def at(text):
    return dt.datetime.fromisoformat(text)


def money(text):
    return Decimal(text)


START = at("2023-01-01")


def frame(spark, table, rows):
    schema = SCHEMAS[table]
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)


def user(id, name, role="user", active=True, key=None):
    return dict(id=id, user_key=key or id, name=name, role=role, active=active, created_at=START, updated_at=START)


def product(id, name, price, category, excluded=False, active=True):
    return dict(
        id=id, name=name, description="", price=money(price), category_id=category, icon_data_url="",
        excluded_from_revenue=excluded, active=active, created_at=START, updated_at=START,
    )


def entry(id, user_id, product_id, quantity, price, created, deleted=None, paid=False):
    return dict(
        id=id, user_id=user_id, product_id=product_id, quantity=quantity, unit_price=money(price),
        total=quantity * money(price), paid=paid, created_at=at(created), deleted_at=deleted and at(deleted),
        deleted_reason="Fehlbuchung" if deleted else None,
    )


def amount(id, user_id, value, created, note="x"):
    return dict(id=id, user_id=user_id, amount=money(value), note=note, created_at=at(created))


def micro_ledger(spark):
    users = [
        user("u001", "Ada"), user("u002", "Ben B."), user("u003", "Cem", "admin"),
        user("u004", "benb!", active=False), user("u005", "!!"),
    ]
    categories = [
        dict(id=i, title=t, icon_data_url="", active=a, created_at=START, updated_at=START)
        for i, t, a in (("c1", "Drinks", True), ("c2", "Snacks", True), ("c3", "Empty", False))
    ]
    products = [
        product("p1", "Cola", "1.20", "c1"), product("p2", "Water", "0.80", "c1", excluded=True),
        product("p3", "Bar", "1.00", "c2"), product("p4", "Gum", "0.50", None),
        product("p5", "Tea", "2.00", "c1", active=False),
    ]
    entries = [
        entry("e1", "u001", "p1", 2, "1.20", "2024-03-01 00:00:00"),
        entry("e2", "u001", "p2", 5, "0.80", "2024-03-31 23:59:59"),
        entry("e3", "u001", "p3", 1, "1.00", "2024-04-01 00:00:00"),
        entry("e4", "u001", "p1", 3, "1.10", "2024-02-29 12:00:00"),
        entry("e5", "u002", "p4", 4, "0.50", "2024-03-10 09:00:00"),
        entry("e6", "u002", "p1", 1, "1.20", "2024-03-10 09:00:00", "2024-03-11 08:00:00"),
        entry("e7", "u003", "p3", 60, "1.00", "2024-03-05 10:00:00"),
        entry("e8", "u004", "p1", 1, "1.20", "2024-03-02 09:00:00", "2024-03-02 10:00:00", paid=True),
    ]
    payments = [
        amount("y1", "u001", "10.00", "2024-03-02 00:00:00", "bar"),
        amount("y2", "u003", "5.00", "2024-01-05 00:00:00", "bar"),
    ]
    adjustments = [
        amount("a1", "u002", "2.00", "2024-03-12 00:00:00"), amount("a2", "u003", "-1.00", "2024-03-06 00:00:00"),
    ]
    settings = [dict(key="paypal_me", value="shop.name", updated_at=START)]
    suggestions = [
        dict(id=i, title=t, description="", status=s, created_by="u001", created_at=at(c), updated_at=at(c))
        for i, t, s, c in (
            ("s1", "Tea", "open", "2024-01-01"), ("s2", "Nuts", "added", "2024-01-02"),
            ("s3", "Soup", "open", "2024-01-03"),
        )
    ]
    votes = [dict(suggestion_id="s1", user_id=u, created_at=START) for u in ("u001", "u002")]
    news = [
        dict(id="n1", title="News one", body="text", image_data_url="", created_by="u003",
             created_at=at("2024-03-01"), updated_at=at("2024-03-01")),
        dict(id="n2", title="News two", body="text", image_data_url="", created_by="u001",
             created_at=at("2024-03-03"), updated_at=at("2024-03-03")),
    ]
    likes = [dict(news_id="n1", user_id="u001", created_at=START)]
    comments = [
        dict(id="k1", news_id="n1", user_id="u002", body="first", created_at=at("2024-03-02")),
        dict(id="k2", news_id="n1", user_id="u001", body="second", created_at=at("2024-03-04")),
    ]
    reads = [
        dict(user_id=u, last_seen_at=at(d))
        for u, d in (("u001", "2024-03-01"), ("u002", "2024-03-02"), ("u003", "2024-03-05"))
    ]
    rows = dict(
        users=users, categories=categories, products=products, entries=entries, payments=payments,
        adjustments=adjustments, settings=settings, suggestions=suggestions, suggestion_votes=votes, news=news,
        news_likes=likes, news_comments=comments, news_reads=reads,
    )
    return Tables(**{name: frame(spark, name, value) for name, value in rows.items()})


def by_key(frame, *columns):
    """First column → tuple of the others (or the single other)."""
    rows = frame.select(*columns).collect()
    return {r[0]: tuple(r[1:]) if len(columns) > 2 else r[1] for r in rows}
