"""Random small ledgers: every operator against the per-row SQL in DuckDB."""

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pytest

import check
from tallybook.plans.oracle import BODIES, with_tables
from tallybook.plans.queries import QUERIES
from tallybook.sources.schemas import SCHEMAS
from tests.ledger import START, amount, entry, frame, product, user

CHECKED = [
    "account_balance", "account_overview", "users_with_balance", "open_paid_totals", "low_balance_accounts", "balance_class",
    "deletable_users", "balance_check", "revenue_summary", "product_analysis", "category_analysis", "analysis_legacy",
    "analysis_legacy_categories", "analysis_legacy_totals", "product_bar_share", "movements", "recent_entries",
    "recent_movements", "running_balance", "running_balance_as_booked", "account_month_dashboard", "account_month_items",
    "user_month_detail", "account_document", "statement_lines", "statement_pages", "active_catalog", "catalog_admin",
    "category_tiles", "category_product_count", "product_delete_plan", "suggestion_board", "news_feed",
    "news_feed_comments", "news_unread", "vote_counts", "like_counts", "paid_flag_migration",
]
TIMES = [
    "2000-05-31 23:59:59.999999", "2000-06-01 00:00:00", "2000-06-15 12:00:00", "2000-06-30 23:59:59", "2000-07-01 00:00:00",
    "2000-02-29 10:00:00", "1999-12-31 23:59:59", "2000-01-01 00:00:00",
]


def random_rows(seed):
    """Tables with ties in time, month edges, missing categories, deleted rows; seed 0 is empty."""
    pick = random.Random(seed)
    size = lambda most: 0 if seed == 0 else pick.randint(0, most)
    when = lambda: pick.choice(TIMES)
    users = [
        user(str(n), pick.choice(["Ada", "Ärmel", "!!", "Ben B."]), pick.choice(["user", "user", "admin"]), pick.random() < 0.7, f"k{n}")
        for n in range(1, 10)
    ]
    categories = [
        dict(id=f"c{n}", title=pick.choice(["Äpfel", "Zebra", "Tee"]), icon_data_url="i", active=pick.random() < 0.7, created_at=START, updated_at=START)
        for n in range(size(4))
    ]
    products = [
        product(
            f"p{n}", pick.choice(["Cola", "Tee"]), pick.choice(["0.01", "1.20", "99999999.99"]),
            pick.choice([None, *(c["id"] for c in categories)]), pick.random() < 0.3, pick.random() < 0.7,
        )
        for n in range(1 + size(5))
    ]
    member = lambda: pick.choice(users[:7])["id"]  # noqa: E731  the last two have no rows
    entries = [
        entry(
            f"e{n}", member(), pick.choice(products)["id"], pick.randint(1, 5), pick.choice(["0.01", "1.10", "19999999.99"]),
            when(), pick.choice([None, None, "2000-07-02 01:00:00"]), pick.random() < 0.5,
        )
        for n in range(size(120))
    ]
    payments = [amount(f"y{n}", member(), pick.choice(["0.01", "10.00", "99999999.99"]), when(), pick.choice([None, "bar"])) for n in range(size(50))]
    adjustments = [amount(f"a{n}", member(), pick.choice(["-0.01", "5.00", "-99999999.99"]), when()) for n in range(size(50))]
    posts = [
        dict(id=f"n{n}", title="News", body="text", image_data_url="", created_by=member(), created_at=dt.datetime.fromisoformat(when()))
        for n in range(size(12))
    ]
    suggestions = [
        dict(id=f"s{n}", title="T", description="", status=pick.choice(["open", "added", "rejected"]), created_by=member(),
             created_at=dt.datetime.fromisoformat(when()))
        for n in range(size(12))
    ]
    pairs = lambda items: {(i["id"], member()) for i in items for _ in range(3)}
    return dict(
        users=users, categories=categories, products=products, entries=entries, payments=payments, adjustments=adjustments,
        settings=[dict(key="paypal_me", value="shop.name")] if seed % 2 else [], suggestions=suggestions, news=posts,
        suggestion_votes=[dict(suggestion_id=i, user_id=u, created_at=START) for i, u in pairs(suggestions)],
        news_likes=[dict(news_id=i, user_id=u, created_at=START) for i, u in pairs(posts)],
        news_comments=[
            dict(id=f"k{n}", news_id=pick.choice(posts)["id"], user_id=member(), body="b", created_at=dt.datetime.fromisoformat(when()))
            for n in range(size(20) if posts else 0)
        ],
        news_reads=[dict(user_id=u["id"], last_seen_at=dt.datetime.fromisoformat(when())) for u in users[1:6]],
    )


DUCK = {"string": "varchar", "boolean": "boolean", "int": "integer", "timestamp_ntz": "timestamp", "decimal(10,2)": "decimal(10,2)"}


def duck_tables(rows):
    connection = duckdb.connect()
    for table, schema in SCHEMAS.items():
        columns = ", ".join(f"{f.name} {DUCK[f.dataType.simpleString()]}" for f in schema)
        connection.execute(f"create table {table} ({columns})")
        values = [[row.get(name) for name in schema.names] for row in rows[table]]
        if values:
            connection.executemany(f"insert into {table} values ({', '.join('?' * len(schema.names))})", values)
    return connection


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_against_per_row_sql(spark, seed):
    rows = random_rows(seed)
    from tallybook.sources.tables import Tables

    tables = Tables(**{name: frame(spark, name, rows[name]) for name in SCHEMAS})
    connection = duck_tables(rows)
    for name in CHECKED:
        result = QUERIES[name](tables)
        wanted = connection.sql(with_tables(BODIES[name], frozenset(SCHEMAS)))
        got = check.rows_of(result.columns, result.collect())
        assert got == check.rows_of(list(wanted.columns), wanted.fetchall()), name


def test_generator_reaches_the_edges():
    rows = random_rows(1)
    assert any(e["deleted_at"] for e in rows["entries"])
    assert any(e["total"] > Decimal(1000000) for e in rows["entries"])
