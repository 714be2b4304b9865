"""Every operator on the micro ledger, against values worked out by hand."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallybook.functions.text import pay_handle
from tallybook.operators import balance, catalog, community, members, movements, profile, revenue, statement
from tests.ledger import AS_OF, at, by_key


def test_balance_counts_excluded_products_and_skips_deleted(ledger):
    assert by_key(balance.account_balance(ledger), "user_id", "balance") == {
        "u001": D("-0.70"), "u002": D(0), "u003": D("-56.00"), "u004": D(0), "u005": D(0),
    }


def test_overview_lists_active_members_lowest_balance_first(ledger):
    rows = balance.account_overview(ledger, AS_OF).select("user_id", "balance", "month_spent", "entries_count")
    assert [tuple(r) for r in rows.collect()] == [
        ("u003", D("-56.00"), D("60.00"), 1), ("u001", D("-0.70"), D("6.40"), 4),
        ("u005", D("0.00"), D("0.00"), 0), ("u002", D("0.00"), D("2.00"), 1),
    ]


def test_summary_counts_excluded_units_but_not_their_revenue(ledger):
    assert tuple(revenue.revenue_summary(ledger, AS_OF).first()) == (D("64.40"), 71, D("68.70"))


def test_product_analysis(ledger):
    columns = ("product_id", "month_units", "month_revenue", "all_units", "all_revenue")
    report = revenue.product_analysis(ledger, AS_OF)
    assert by_key(report, *columns) == {
        "p1": (2, D("2.40"), 5, D("5.70")), "p2": (5, D(0), 5, D(0)), "p3": (60, D("60.00"), 61, D("61.00")),
        "p4": (4, D("2.00"), 4, D("2.00")), "p5": (0, D(0), 0, D(0)),
    }
    assert [r.product_id for r in report.collect()] == ["p3", "p1", "p4", "p2", "p5"]


def test_category_analysis_leaves_uncategorised_out(ledger):
    assert by_key(
        revenue.category_analysis(ledger, AS_OF), "category_id", "month_units", "month_revenue", "all_revenue"
    ) == {"c1": (7, D("2.40"), D("5.70")), "c2": (60, D("60.00"), D("61.00")), "c3": (0, D(0), D(0))}


def test_legacy_reports_have_no_exclusion(ledger):
    assert by_key(revenue.legacy_products(ledger, AS_OF), "product_id", "all_revenue")["p2"] == D("4.00")
    assert by_key(revenue.legacy_categories(ledger, AS_OF), "category_id", "month_revenue", "all_units")["c1"] == (D("6.40"), 10)
    assert tuple(revenue.legacy_totals(ledger, AS_OF).first()) == ("March 2024", D("72.70"), D("68.40"))


def test_bar_share_has_a_floor(ledger):
    shares = by_key(revenue.product_bar_share(ledger, AS_OF), "product_id", "bar_percent")
    assert shares["p3"] == 100 and shares["p1"] == pytest.approx(4.0) and shares["p2"] == 3


def test_unread(ledger):
    assert by_key(community.news_unread(ledger), "user_id", "unread") == {
        "u001": False, "u002": True, "u003": False, "u004": True, "u005": True,
    }


def test_unread_without_news(ledger):
    empty = ledger.replace(news=ledger.news.limit(0))
    assert set(by_key(community.news_unread(empty), "user_id", "unread").values()) == {False}


def test_generated_keys_suffix_every_member_of_a_group(ledger):
    assert by_key(members.user_keys_generated(ledger.users), "id", "user_key") == {
        "u001": "ada", "u002": "benb-u002", "u003": "admin", "u004": "benb-u004", "u005": "",
    }


def test_duplicate_keys_exact_and_ignoring_case(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "A"), ("3", "a"), ("4", "b")], "id string, user_key string")
    assert set(by_key(members.duplicate_user_keys(rows), "id", "holders")) == {"1", "2", "3"}
    assert set(by_key(members.duplicate_user_keys(rows, ignore_case=False), "id", "holders")) == {"1", "3"}


def test_low_balance_is_inclusive(ledger):
    rows = balance.low_balance_accounts(ledger).collect()
    assert [(r.user_id, r.due, r.pay_link) for r in rows] == [("u003", D("56.00"), "https://paypal.me/shop.name/56.00")]
    edge = ledger.replace(adjustments=ledger.adjustments.withColumn(
        "amount", F.when(F.col("id") == "a2", 5).otherwise(F.col("amount")).cast("decimal(10,2)")
    ))
    assert [r.balance for r in balance.low_balance_accounts(edge).collect()] == [D("-50.00")]


def test_class_counts(ledger):
    assert by_key(balance.balance_class(ledger), "balance_class", "accounts") == {"bad": 2, "neutral": 3}


def test_deletable_members(ledger):
    assert set(by_key(balance.deletable_users(ledger), "user_id", "role")) == {"u002", "u004", "u005"}


def test_last_active_admin_is_not_deletable(ledger):
    paid = ledger.replace(entries=ledger.entries.limit(0), payments=ledger.payments.limit(0), adjustments=ledger.adjustments.limit(0))
    assert "u003" not in by_key(balance.deletable_users(paid), "user_id", "role")
    second = paid.users.withColumn("role", F.when(F.col("id") == "u001", "admin").otherwise(F.col("role")))
    assert {"u003", "u001"} <= set(by_key(balance.deletable_users(paid.replace(users=second)), "user_id", "role"))


@pytest.mark.parametrize("pieces", [None, 40])
def test_running_balance_modes(ledger, pieces):
    def of(mode):
        rows = movements.running_balance(ledger, mode, pieces).where("user_id = 'u002'")
        return [(r.id, r.kind, r.balance) for r in rows.orderBy("created_at", "kind", "id").collect()]

    assert of("current") == [("e5", "entry", D("-2.00")), ("a1", "adjustment", D("0.00"))]
    assert of("as_booked") == [
        ("e5", "entry", D("-2.00")), ("e6", "entry", D("-3.20")), ("e6", "reversal", D("-2.00")),
        ("a1", "adjustment", D("0.00")),
    ]


def test_warning_text(ledger):
    rows = movements.running_balance(ledger).where("user_id = 'u003'").orderBy("created_at").collect()
    assert [r.warning is not None for r in rows] == [False, True, True]


def test_movements_leave_deleted_out(ledger):
    rows = movements.movements(ledger).where("user_id = 'u002'").orderBy("id").collect()
    assert [(r.id, r.type_label, r.title, r.note, r.amount) for r in rows] == [
        ("a1", "Korrektur", "Korrektur", "x", D("2.00")), ("e5", "Kauf", "Gum", "Ohne Kategorie", D("-2.00")),
    ]


def test_recent_rows(ledger):
    rows = movements.recent_movements(ledger, 2).where("user_id = 'u001'").orderBy("row_no").collect()
    assert [r.id for r in rows] == ["e3", "e2"]
    assert movements.recent_entries(ledger, None).count() == 8
    assert [r.id for r in movements.recent_payments(ledger, 1).orderBy("id").collect()] == ["y1", "y2"]


def test_dashboard(ledger):
    row = profile.account_month_dashboard(ledger, AS_OF).where("user_id = 'u003'").first()
    assert (row.balance, row.month_label, row.month_spent, row.month_payments, row.month_adjustments) == (
        D("-56.00"), "March 2024", D("60.00"), D("0.00"), D("-1.00"),
    )
    assert row.paypal_me == "shop.name"


def test_month_items_in_parts(ledger):
    rows = profile.account_month_items(ledger, AS_OF, part_size=1).where("user_id = 'u001'").orderBy("part_no").collect()
    assert [[i.id for i in r["items"]] for r in rows] == [["e2"], ["e1"]]


def test_month_detail_keeps_deleted_with_reason(ledger):
    rows = profile.user_month_detail(ledger, AS_OF).where("user_id = 'u002'").orderBy("id").collect()
    assert [(r.id, r.deleted_reason) for r in rows] == [("e5", None), ("e6", "Fehlbuchung")]


@pytest.mark.parametrize(("part_size", "pieces"), [(2, None), (1000, None), (2, 40)])
def test_document_has_whole_lists(ledger, part_size, pieces):
    rows = profile.account_document(ledger, part_size, pieces).where("user_id = 'u001'").orderBy("part_no").collect()
    joined = {name: [i.id for r in rows for i in r[name]] for name in ("entries", "payments", "adjustments", "movements")}
    assert joined == {
        "entries": ["e3", "e2", "e1", "e4"], "payments": ["y1"], "adjustments": [],
        "movements": ["e3", "e2", "y1", "e1", "e4"],
    }
    assert rows[0].user.balance == D("-0.70") and all(r.user is None for r in rows[1:])


def test_document_of_a_member_without_rows(ledger):
    row = profile.account_document(ledger).where("user_id = 'u005'").first()
    assert row.entries == [] and row.movements == [] and row.user.name == "!!"


@pytest.mark.parametrize("pieces", [None, 40])
def test_statement_text(ledger, pieces):
    rows = statement.statement_lines(ledger, dt.datetime(2024, 3, 15, 8, 5), pieces)
    lines = [r.line for r in rows.where("user_id = 'u002'").orderBy("line_no").collect()]
    assert lines == [
        "Kontoauszug", "Ben B. (u002)", "Erstellt am 15.03.24, 08:05", "Aktueller Kontostand: 0,00 €", "",
        "Produktbuchungen nach Monat.Jahr", "", "03.2024",
        "10.03.24, 09:00 | Gum | Ohne Kategorie | 4x | 2,00 €",
        "10.03.24, 09:00 | Cola | Drinks | 1x | 1,20 € | geloescht",
        "", "Zahlungen & Korrekturen nach Monat.Jahr", "", "03.2024",
        "12.03.24, 00:00 | Korrektur | x | 2,00 €",
    ]
    empty = [r.line for r in rows.where("user_id = 'u005'").orderBy("line_no").collect()]
    assert empty[6:] == [
        "Keine Produktbuchungen vorhanden.", "", "Zahlungen & Korrekturen nach Monat.Jahr",
        "Keine Zahlungen oder Korrekturen vorhanden.",
    ]
    headings = [r.line for r in rows.where("user_id = 'u001'").orderBy("line_no").collect() if len(r.line) == 7]
    assert headings == ["04.2024", "03.2024", "02.2024", "03.2024"]


def test_money_text(spark):
    from tallybook.functions.money import euro_text

    row = spark.sql("select cast(-1234567.5 as decimal(10,2)) as v").select(euro_text("v")).first()
    assert row[0] == "-1.234.567,50 €"


def test_catalog(ledger):
    assert by_key(catalog.active_catalog(ledger), "id", "category_title") == {
        "p1": "Drinks", "p2": "Drinks", "p3": "Snacks", "p4": "Ohne Kategorie",
    }
    assert [r.id for r in catalog.catalog_admin(ledger).collect()] == ["p4", "p1", "p2", "p3", "p5"]
    assert [r.id for r in catalog.categories_admin(ledger).collect()] == ["c1", "c2", "c3"]
    assert [r.id for r in catalog.active_categories(ledger).collect()] == ["c1", "c2"]
    assert [r.id for r in catalog.category_products(ledger).collect()] == ["p4"]
    assert [r.id for r in catalog.category_products(ledger, "c2").collect()] == ["p3"]
    assert by_key(catalog.category_tiles(ledger), "category_id", "products") == {"c1": 2, "c2": 1, "none": 1}
    assert by_key(catalog.category_product_count(ledger), "id", "product_count") == {"c1": 3, "c2": 1, "c3": 0}
    assert by_key(catalog.product_delete_plan(ledger), "product_id", "action")["p5"] == "remove"


def test_tiles_sort_by_german_rules(spark, ledger):
    titles = ledger.categories.withColumn("title", F.when(F.col("id") == "c1", "Äpfel").otherwise("Zebra"))
    assert [r.title for r in catalog.category_tiles(ledger.replace(categories=titles)).collect()] == [
        "Äpfel", "Ohne Kategorie", "Zebra",
    ]


def test_missing_setting_is_empty(ledger):
    none = ledger.replace(settings=ledger.settings.limit(0))
    assert catalog.setting_value(none).first().value == ""
    assert balance.low_balance_accounts(none).first().pay_link == ""


def test_detach_category(ledger):
    products, categories = catalog.detach_category(ledger, ledger.categories.where("id = 'c1'"))
    assert by_key(products, "id", "category_id") == {"p1": None, "p2": None, "p3": "c2", "p4": None, "p5": None}
    assert by_key(categories, "id", "active") == {"c1": False, "c2": True, "c3": False}


def test_board_order_and_own_vote(ledger):
    rows = community.suggestion_board(ledger, "u002").collect()
    assert [(r.id, r.upvotes, r.user_voted) for r in rows] == [("s1", 2, True), ("s3", 0, False), ("s2", 0, False)]
    assert [r.id for r in community.suggestions_decided(ledger).collect()] == ["s2"]
    assert [r.id for r in community.suggestions_open(ledger).collect()] == ["s1", "s3"]


def test_feed(ledger):
    rows = community.news_feed(ledger, "u001").collect()
    assert [(r.id, r.author_name, r.likes_count, r.comments_count, r.user_liked) for r in rows] == [
        ("n2", "Ada", 0, 0, False), ("n1", "Cem", 1, 2, True),
    ]
    threads = community.comment_threads(ledger, part_size=1).orderBy("part_no").collect()
    assert [[(i.author_name, i.body) for i in r["items"]] for r in threads] == [[("Ben B.", "first")], [("Ada", "second")]]


@pytest.mark.parametrize(
    "raw, handle",
    [
        ("https://www.PayPal.me/some.name", "some.name"), ("http://paypal.me/x1y?locale=de", "x1y"),
        ("paypal.me/abc/25", "abc"), (" @abc ", "abc"), ("abc#top", "abc"), ("", ""), (None, ""),
        ("https://paypal.me/paypal.me/@abc", "abc"), ("https://example.org/abc", "https:"),
    ],
)
def test_pay_handle(spark, raw, handle):
    frame = spark.createDataFrame([(raw,)], "raw string")
    assert frame.select(pay_handle("raw")).first()[0] == handle


def test_open_paid_totals_ignore_deletion(ledger):
    everyone = ledger.replace(users=ledger.users.withColumn("active", F.lit(True)))
    rows = by_key(balance.open_paid_totals(everyone), "user_id", "open_total", "paid_total", "entries_count")
    assert rows["u004"] == (D(0), D("1.20"), 1) and rows["u005"] == (D(0), D(0), 0)


def test_month_entries_are_half_open(ledger):
    assert {r.id for r in movements.month_entries(ledger, AS_OF).collect()} == {"e1", "e2", "e5", "e7"}
    december = dt.date(2023, 12, 31)
    edge = ledger.replace(entries=ledger.entries.withColumn(
        "created_at", F.when(F.col("id") == "e1", F.lit(at("2024-01-01 00:00:00")).cast("timestamp_ntz"))
        .otherwise(F.lit(at("2023-12-31 23:59:59")).cast("timestamp_ntz"))
    ))
    assert "e1" not in {r.id for r in movements.month_entries(edge, december).collect()}
    assert movements.month_entries(edge, december).count() == 5
