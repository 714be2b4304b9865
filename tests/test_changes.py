"""Change batches: last wins, keys stay unique, rejects are reported, nothing else is touched."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallybook.operators import balance, changes, rules
from tallybook.operators.evolve import evolve_products
from tests.ledger import START, at, by_key, frame, money

ORDER = ["changed_at", "seq"]
STAMP = "changed_at timestamp_ntz, seq int"


def batch(spark, columns, *rows):
    """Change rows; the change time and sequence number are added in order."""
    stamped = [(*row, at("2024-05-01"), number) for number, row in enumerate(rows)]
    return spark.createDataFrame(stamped, f"{columns}, {STAMP}")


USER = "id string, user_key string, name string, role string, active boolean"


def test_user_changes(spark, ledger):
    log = batch(
        spark, USER,
        ("u001", " Ada2 ", " Ada L ", "admin", None),
        ("u002", "ADA2", "Ben", "user", True),  # loses: u001 claimed it first
        ("u003", "cem", "Cem", "boss", True),  # role
        ("u004", "x", "Ben", "user", True),  # key
        ("u006", "U005", "New", "user", False),  # held by u005
        ("u007", "neu", "N", "user", True),  # name
        ("u008", "eight", "Eight", "user", None),
        ("u008", "eight8", "Eight", "user", False),  # last wins
    )
    result = changes.apply_user_changes(ledger.users, log, ORDER)
    users = by_key(result.accepted, "id", "user_key", "name", "role", "active")
    assert users["u001"] == ("Ada2", "Ada L", "admin", True)
    assert users["u008"] == ("eight8", "Eight", "user", False)
    assert users["u002"] == ("u002", "Ben B.", "user", True)
    assert set(users) == {"u001", "u002", "u003", "u004", "u005", "u008"}
    assert by_key(result.rejected, "id", "reason") == {
        "u002": "user_key_taken", "u003": "role_invalid", "u004": "user_key_too_short", "u006": "user_key_taken",
        "u007": "name_too_short",
    }
    times = by_key(result.accepted, "id", "created_at", "updated_at")
    assert times["u001"] == (START, at("2024-05-01")) and times["u008"][0] == at("2024-05-01")
    assert rules.duplicate_user_keys(result.accepted).isEmpty()


def applied(spark, ledger, *rows):
    result = changes.apply_user_changes(ledger.users, batch(spark, USER, *rows), ORDER)
    keys = by_key(result.accepted, "id", "user_key")
    return keys, sorted((r.id, r.user_key) for r in result.rejected.select("id", "user_key").collect())


def test_a_valid_change_survives_a_later_invalid_one(spark, ledger):
    keys, rejected = applied(spark, ledger, ("u001", "cc1", "Ada", "user", True), ("u001", "u002", "Ada", "user", True))
    assert keys["u001"] == "cc1" and keys["u002"] == "u002" and rejected == [("u001", "u002")]


def test_a_key_given_up_in_the_batch_is_free(spark, ledger):
    keys, rejected = applied(spark, ledger, ("u002", "dd1", "Ben", "user", True), ("u001", "U002", "Ada", "user", True), ("u003", "dd1", "Cem", "user", True))
    assert keys["u001"] == "U002" and keys["u002"] == "dd1" and rejected == [("u003", "dd1")]


def test_random_user_changes_one_by_one(spark, ledger):
    """Against a loop over the batch; every change is applied, overwritten later, or rejected."""
    import random

    rng = random.Random(5)
    start = {r.id: r.user_key for r in ledger.users.collect()}
    ids, names = [*start, "n1", "n2", "n3"], [*start.values(), "aa1", "bb1", "cc1"]
    rows = [(rng.choice(ids), rng.choice([str.upper, str.lower])(rng.choice(names)), "Name", "user", True) for _ in range(120)]
    now, refused = dict(start), []
    for user, key, *_ in rows:
        if any(k.lower() == key.lower() and u != user for u, k in now.items()):
            refused.append((user, key))
        else:
            now[user] = key
    keys, rejected = applied(spark, ledger, *rows)
    assert keys == now and rejected == sorted(refused)


def test_deactivations(spark, ledger):
    users = spark.createDataFrame(
        [("a", "admin", True), ("b", "admin", True), ("c", "user", True), ("d", "user", True)], "id string, role string, active boolean"
    ).withColumns({"updated_at": F.lit(START)})
    balances = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 5)], "user_id string, balance int")
    requests = batch(spark, "id string", ("c",), ("b",), ("a",), ("d",), ("x",), ("c",))
    result = changes.deactivate_users(users, requests, balances, ORDER)
    assert by_key(result.accepted, "id", "active") == {"a": True, "b": False, "c": False, "d": True}
    assert by_key(result.rejected, "id", "reason") == {"a": "last_admin", "d": "balance_not_zero", "x": "user_unknown"}


def test_strict_user_changes(spark, ledger):
    log = batch(spark, USER, ("n1", " Ab.C ", "Name", "user", True), ("n2", "a b c", "Name", "user", True), ("n3", "ab", "Name", "user", True))
    result = changes.apply_user_changes(ledger.users, log, ORDER, strict=True)
    assert by_key(result.accepted, "id", "user_key")["n1"] == "ab.c"
    assert by_key(result.rejected, "id", "reason") == {"n2": "user_key_characters", "n3": "user_key_too_short"}


def test_category_icon_survives_null(spark, ledger):
    columns = "id string, title string, icon_data_url string, active boolean"
    log = batch(
        spark, columns, ("c1", " Drinks2 ", "icon", True), ("c1", "Drinks3", None, None), ("c9", "New", None, None),
        ("c2", " x ", None, True),
    )
    result = changes.apply_category_changes(ledger.categories, log, ORDER)
    assert by_key(result.accepted, "id", "title", "icon_data_url", "active") == {
        "c1": ("Drinks3", "icon", True), "c2": ("Snacks", "", True), "c3": ("Empty", "", False), "c9": ("New", "", True),
    }
    assert by_key(result.rejected, "id", "reason") == {"c2": "title_too_short"}


def test_product_price_is_rounded_half_up(spark, ledger):
    columns = (
        "id string, name string, description string, price decimal(12,3), category_id string, icon_data_url string,"
        " excluded_from_revenue boolean, active boolean"
    )
    log = batch(
        spark, columns, ("p1", " Cola ", None, D("2.345"), None, None, None, None),
        ("p2", "Water", "d", D("-0.001"), "c1", None, None, None),
    )
    result = changes.apply_product_changes(ledger.products, log, ORDER)
    row = result.accepted.where("id = 'p1'").first()
    assert (row.name, row.price, row.category_id, row.description, row.excluded_from_revenue, row.active) == (
        "Cola", D("2.35"), None, "", False, True,
    )
    assert by_key(result.rejected, "id", "reason") == {"p2": "price_invalid"}
    assert by_key(balance.account_balance(ledger.replace(products=result.accepted)), "user_id", "balance")["u001"] == D("-0.70")


def test_soft_delete_first_wins(spark, ledger):
    requests = spark.createDataFrame(
        [
            ("e1", at("2024-04-02"), "u003", None), ("e1", at("2024-04-01"), "u001", " why "),
            ("e6", at("2024-04-01"), "u003", "late"), ("e5", at("2024-04-01"), "u003", None),
        ],
        "id string, deleted_at timestamp_ntz, deleted_by string, reason string",
    )
    rows = by_key(changes.soft_delete_entries(ledger.entries, requests, True), "id", "deleted_at", "deleted_by", "deleted_reason")
    assert rows["e1"] == (at("2024-04-01"), "u001", "why")
    assert rows["e5"] == (at("2024-04-01"), "u003", "Fehlbuchung")
    assert rows["e6"] == (at("2024-03-11 08:00:00"), None, "Fehlbuchung")
    assert rows["e2"] == (None, None, None)
    assert changes.soft_delete_entries(ledger.entries, requests).where("id = 'e1'").first().deleted_reason == " why "


def test_mark_paid(spark, ledger):
    chosen = spark.createDataFrame([("u001",), ("u004",), ("u005",)], "user_id string")
    when = dt.datetime(2024, 5, 1)
    paid = by_key(changes.mark_paid(ledger.entries, chosen, when), "id", "paid", "paid_at")
    assert paid["e1"] == (True, when) and paid["e8"] == (True, None) and paid["e5"] == (False, None)
    assert by_key(changes.mark_paid_counts(ledger.entries, chosen), "user_id", "marked") == {"u001": 4, "u004": 0, "u005": 0}


def test_posts_check_before_rounding(spark, ledger):
    posts = spark.createDataFrame(
        [
            ("1", "u001", D("0.004"), None, None, START), ("2", "u001", D("5.005"), None, None, START),
            ("3", "u001", D("0.000"), "n", None, START), ("4", "nobody", D("1.000"), "n", None, START),
            ("5", "u002", D("-1.000"), "n", None, START),
        ],
        "id string, user_id string, amount decimal(12,3), note string, created_by string, created_at timestamp_ntz",
    )
    paid = changes.post_payments(posts, ledger.users)
    assert by_key(paid.accepted, "id", "amount", "note") == {"2": (D("5.01"), "Zahlung")}
    assert by_key(paid.rejected, "id", "reason") == {
        "1": "amount_rounds_to_zero", "3": "amount_not_positive", "4": "user_unknown", "5": "amount_not_positive",
    }
    corrected = changes.post_adjustments(posts, ledger.users)
    assert by_key(corrected.accepted, "id", "amount", "note") == {
        "1": (D("0.00"), "Konto-Korrektur"), "2": (D("5.01"), "Konto-Korrektur"), "5": (D("-1.00"), "n"),
    }
    after = changes.balances_after(balance.account_balance(ledger), paid.accepted)
    assert by_key(after, "user_id", "balance") == {"u001": D("4.31")}


def test_bookings(spark, ledger):
    requests = spark.createDataFrame(
        [("b1", "u001", "p1", None), ("b2", "u001", "p1", -3), ("b3", "u001", "p3", 2), ("b4", "u001", "p5", 1), ("b5", "u001", "zz", 1)],
        "id string, user_id string, product_id string, quantity int",
    )
    result = changes.priced_bookings(requests, ledger.products)
    assert by_key(result.accepted, "id", "quantity", "total") == {"b1": (1, D("1.20")), "b2": (1, D("1.20")), "b3": (2, D("2.00"))}
    assert set(by_key(result.rejected, "id", "reason")) == {"b4", "b5"}


def test_migration_guard_is_for_everybody(ledger):
    rows = changes.paid_flag_migration(ledger).collect()
    assert [(r.user_id, r.amount) for r in rows] == [("u004", D("1.20"))]  # a deleted purchase counts
    marked = ledger.payments.withColumn("note", F.when(F.col("id") == "y1", changes.MIGRATION_NOTE).otherwise(F.col("note")))
    assert changes.paid_flag_migration(ledger.replace(payments=marked)).isEmpty()


def toggles(spark, *pairs):
    rows = [(item, member, at(f"2024-01-01 00:{n:02}:00")) for n, (item, member) in enumerate(pairs)]
    return spark.createDataFrame(rows, "news_id string, user_id string, created_at timestamp_ntz")


def test_toggles(spark, ledger):
    log = toggles(spark, *[("n1", "u001")] * 3, *[("n1", "u002")] * 2, ("zz", "u001"))
    result = changes.toggle_state(log, "news_id", ledger.news)
    assert [(r.news_id, r.user_id, r.created_at.minute) for r in result.state.collect()] == [("n1", "u001", 2)]
    assert [(r.news_id, r.toggles) for r in result.rejected.collect()] == [("zz", 1)]


def test_toggling_twice_gives_the_start(spark, ledger):
    log = toggles(spark, ("n1", "u001"), ("n1", "u002"), ("n2", "u003"))
    once = changes.toggle_state(log, "news_id", ledger.news, ledger.news_likes).state
    twice = changes.toggle_state(log, "news_id", ledger.news, once).state
    pairs = lambda rows: {(r.news_id, r.user_id) for r in rows.collect()}
    assert pairs(once) == {("n1", "u002"), ("n2", "u003")}
    assert pairs(twice) == pairs(ledger.news_likes)


def test_status(spark, ledger):
    log = batch(spark, "id string, status string", ("s1", "added"), ("s1", "rejected"), ("s2", "later"), ("zz", "open"), ("s1", None))
    result = changes.set_status(ledger.suggestions, log, ORDER)
    assert by_key(result.accepted, "id", "status") == {"s1": "rejected", "s2": "added", "s3": "open"}
    assert sorted(r.reason for r in result.rejected.collect()) == ["status_invalid", "status_invalid", "suggestion_unknown"]


def test_upsert_latest_and_settings(spark, ledger):
    log = spark.createDataFrame(
        [("paypal_me", " @neu ", "u003", at("2024-02-01"), 1), ("paypal_me", "ab", "u003", at("2024-03-01"), 2), ("paypal_me", "a b c", "u003", at("2024-03-01"), 3)],
        "key string, value string, updated_by string, updated_at timestamp_ntz, seq int",
    )
    cleaned = changes.clean_setting_changes(log)
    assert [r.seq for r in cleaned.rejected.orderBy("seq").collect()] == [2, 3]
    settings = changes.upsert_latest(ledger.settings, cleaned.accepted, ["key"], ["updated_at", "seq"])
    assert [(r.key, r.value) for r in settings.collect()] == [("paypal_me", "neu")]


def test_news_rules(spark, ledger):
    def post(id, title="Title", body="text", image=None):
        return dict(id=id, title=title, body=body, image_data_url=image, created_by="u003", created_at=START, updated_at=START)

    posts = frame(spark, "news", [
        post("ok", " Title ", " text "), post("short", " x "), post("long", "x" * 121), post("edge", "x" * 120, "y" * 3000),
        post("empty", body="  "), post("body", body="y" * 3001), post("gif", image="data:image/gif;base64,xx"),
        post("png", image="data:image/png;base64,xx"), post("big", image="data:image/png;base64," + "x" * 2_200_000),
    ])
    result = changes.add_news(posts)
    assert by_key(result.accepted, "id", "title", "body", "image_data_url")["ok"] == ("Title", "text", "")
    assert by_key(result.rejected, "id", "reason") == {
        "short": "title_too_short", "long": "title_too_long", "empty": "body_empty", "body": "body_too_long",
        "gif": "image_format", "big": "image_too_large",
    }
    marks = by_key(changes.author_read_marks(ledger.news_reads, result.accepted), "user_id", "last_seen_at")
    assert marks == {"u001": at("2024-03-01"), "u002": at("2024-03-02"), "u003": START}


def test_comments_and_moderation(spark, ledger):
    posts = frame(spark, "news_comments", [
        dict(id=i, news_id=n, user_id="u001", body=b, created_at=START)
        for i, n, b in (("1", "n1", " hi "), ("2", "zz", "hi"), ("3", "n1", " "), ("4", "n1", "x" * 501), ("5", "n1", "x" * 500))
    ])
    result = changes.add_comments(posts, ledger.news)
    assert by_key(result.accepted, "id", "body")["1"] == "hi" and result.accepted.count() == 2
    assert by_key(result.rejected, "id", "reason") == {"2": "news_unknown", "3": "body_empty", "4": "body_too_long"}

    asked = spark.createDataFrame(
        [("k1", "u001"), ("k2", "u001"), ("k1", "u004"), ("zz", "u003")], "comment_id string, requested_by string"
    )
    judged = changes.moderate_comments(ledger.news_comments, asked, ledger.users)
    assert [r.id for r in judged.accepted.collect()] == ["k1"]
    assert {(r.comment_id, r.requested_by, r.reason) for r in judged.rejected.collect()} == {
        ("k1", "u001", "not_allowed"), ("k1", "u004", "requester_unknown"), ("zz", "u003", "comment_unknown"),
    }
    admin = spark.createDataFrame([("k1", "u003")], "comment_id string, requested_by string")
    assert changes.moderate_comments(ledger.news_comments, admin, ledger.users).accepted.count() == 1


def test_suggestions_are_trimmed(spark, ledger):
    posts = spark.createDataFrame([("1", "  Tea ", None), ("2", " x ", "d")], "id string, title string, description string")
    result = changes.add_suggestions(posts)
    assert [(r.title, r.description, r.status) for r in result.accepted.collect()] == [("Tea", "", "open")]
    assert [r.reason for r in result.rejected.collect()] == ["title_too_short"]


def test_cascade_and_insert_if_absent(spark, ledger):
    gone = ledger.news.where("id = 'n1'")
    assert changes.cascade_delete(ledger.news_likes, "news_id", gone).isEmpty()
    assert changes.cascade_delete(ledger.news_comments, "news_id", gone).isEmpty()
    rows = spark.createDataFrame([("Drinks",), ("Neu",), ("Neu",)], "title string")
    assert [r.title for r in changes.insert_if_absent(ledger.categories, rows, ["title"]).collect()] == ["Neu"]


def test_schema_evolution_backfills_default_category(spark, ledger):
    old = ledger.products.select("id", "name", "price", "active", "created_at")
    default = frame(spark, "categories", [dict(id="c0", title="Allgemein", active=True)])
    rows = evolve_products(old, ledger.categories.unionByName(default))
    assert {r.category_id for r in rows.collect()} == {"c0"}
    kept = evolve_products(ledger.products, ledger.categories.unionByName(default))
    assert by_key(kept, "id", "category_id") == {"p1": "c1", "p2": "c1", "p3": "c2", "p4": "c0", "p5": "c1"}


def test_rule_violations(spark, ledger):
    assert rules.rule_violations(ledger).isEmpty()
    bad = frame(spark, "entries", [
        dict(id="b1", user_id="nobody", product_id="p1", quantity=0, unit_price=money("1.00"), total=money("1.00"), paid=False, created_at=START),
        dict(id="b2", user_id="u001", product_id="zz", quantity=1, unit_price=money("-1.00"), total=money("-1.00"), paid=False, created_at=START),
    ])
    twice = ledger.replace(
        entries=ledger.entries.unionByName(bad), users=ledger.users.withColumn("user_key", F.lit("Same")),
        news_likes=ledger.news_likes.unionByName(ledger.news_likes),
    )
    found = {(r.table_name, r.row_id, r.rule) for r in rules.rule_violations(twice).collect()}
    assert found == {
        ("entries", "b1", "quantity_not_positive"), ("entries", "b1", "total_differs"), ("entries", "b1", "user_unknown"),
        ("entries", "b2", "unit_price_negative"), ("entries", "b2", "product_unknown"),
        ("news_likes", "n1/u001", "pair_not_unique"),
        *(("users", f"u00{n}", "user_key_not_unique") for n in range(1, 6)),
    }


def test_rule_violation_counts(spark, ledger):
    """Every rule of every table fires, and the counts equal those of the listed rows."""
    assert rules.rule_violation_counts(ledger).isEmpty()
    long_text, one = "x" * 3001, money("1.00")
    broken = dict(
        users=[dict(id="v1", user_key="A", name=" ", role="guest"), dict(id="v2", user_key="a", name=None, role=None)],
        categories=[dict(id="v1", title=" a ")],
        products=[dict(id="v1", name="", price=None), dict(id="v2", name="ok", price=-one)],
        entries=[
            dict(id="v1", user_id="nobody", product_id="p1", quantity=0, unit_price=one, total=one, created_at=START),
            dict(id="v2", user_id="u001", product_id="zz", quantity=None, unit_price=-one, total=None, created_at=START),
            dict(id="v3", user_id=None, product_id=None, quantity=1, unit_price=one, total=one, created_at=START),
        ],
        payments=[dict(id="v1", user_id="nobody", amount=None), dict(id="v2", user_id="nobody", amount=money("0.00"))],
        adjustments=[dict(id="v1", user_id="nobody", amount=money("0.00"))],
        settings=[dict(key=rules.PAY_KEY, value="?")],
        suggestions=[dict(id="v1", title="", status=None)],
        news=[dict(id="v1", title="x" * 121, body="", image_data_url="y" * 2_200_001), dict(id="v2", title="", body=long_text)],
        news_comments=[dict(id="v1", news_id="none", body=" "), dict(id="v2", news_id=None, body=long_text)],
        suggestion_votes=[dict(suggestion_id="none", user_id="u001")] * 3,
        news_likes=[dict(news_id="none", user_id="u001")] * 2 + [dict(news_id=None, user_id=None)] * 2,
    )
    worse = ledger.replace(**{name: getattr(ledger, name).unionByName(frame(spark, name, rows)) for name, rows in broken.items()})
    listed = rules.rule_violations(worse).groupBy("table_name", "rule").agg(F.count("*").alias("rows"))
    want, got = ({tuple(r) for r in f.select("table_name", "rule", "rows").collect()} for f in (listed, rules.rule_violation_counts(worse)))
    assert got == want
    assert {"user_key_not_unique", "pair_not_unique", "parent_unknown", "news_unknown", "user_unknown", "product_unknown"} <= {r for _, r, _ in got}
    tables = dict(
        users=rules.user_rules(), categories=rules.category_rules(), products=rules.product_rules(), entries=rules.entry_rules(),
        payments=rules.payment_rules(), adjustments=rules.adjustment_rules(), settings=rules.setting_rules(),
        suggestions=rules.suggestion_rules(), news=rules.news_rules(), news_comments=rules.comment_rules(),
    )
    assert {(table, name) for table, checks in tables.items() for name, _ in checks} <= {(table, name) for table, name, _ in got}


def test_overflow_raises(spark, ledger):
    requests = spark.createDataFrame([("b", "u001", "p1", 2_000_000_000)], "id string, user_id string, product_id string, quantity int")
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|out of range|overflow"):
        changes.priced_bookings(requests, ledger.products).accepted.collect()
