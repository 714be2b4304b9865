"""Plans, storage and ledger invariants on the parquet tables."""

import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tallybook.operators import balance, movements, prefix, profile, revenue, rules, statement
from tallybook.plans.oracle import ORACLE
from tallybook.plans.queries import PRINTED_AT, QUERIES
from tallybook.session import fresh_dir, stage
from tallybook.sources.bind import AS_OF
from tallybook.sources.schemas import SCHEMAS
from tallybook.sources.tables import (
    append_ledger, month_rows, read_tables, write_documents, write_snapshot, write_statements,
)
from tests.ledger import by_key

ONE_TASK_WINDOW = r"Window \[[^\n]*\n(?:[^\n]*Sort \[[^\n]*\n)?[^\n]*Exchange SinglePartition"
STREAMS = {"stream_bookings", "stream_bookings_rejected", "stream_toggles", "stream_toggles_rejected", "stream_unread"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_plan_scales(bound, name):
    """No cross joins, no Python, and no window without a partition (it would be one task)."""
    text = plan(QUERIES[name](bound))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|FlatMapGroups", text)
    assert not re.search(ONE_TASK_WINDOW, text)


def test_window_pattern_finds_a_window_without_a_partition(spark):
    from pyspark.sql import Window

    frame = spark.range(9).withColumn("n", F.row_number().over(Window.orderBy("id")))
    assert re.search(ONE_TASK_WINDOW, plan(frame))


def test_month_filter_reaches_the_scan(bound):
    text = plan(movements.month_entries(bound, AS_OF))
    assert "GreaterThanOrEqual(l_shipdate,2000-06-01T00:00), LessThan(l_shipdate,2000" in text


def test_reports_scan_purchases_once(bound):
    for report in (revenue.revenue_summary, revenue.product_analysis, revenue.category_analysis):
        assert plan(report(bound, AS_OF)).count("lineitem.parquet") == 1


def test_scans_of_purchases(bound, monkeypatch):
    """Numbering and summing read them once, when they are staged; a document's head reads them once more."""
    staged = []
    monkeypatch.setattr(prefix, "stage", lambda rows, label: (staged.append(plan(rows)), stage(rows, label))[1])
    for build, scans in (
        (lambda: movements.running_balance(bound), 1), (lambda: movements.running_balance(bound, "as_booked"), 1), (lambda: rules.rule_violations(bound), 1),
        (lambda: statement.statement_lines(bound, PRINTED_AT), 1), (lambda: profile.account_document(bound), 2),
    ):
        staged.clear()
        text = plan(build()) + "".join(staged)
        assert text.count("lineitem.parquet") == scans
        assert "FullOuter" not in text


def test_rows_without_product_are_dealt_out(bound):
    """Payments and corrections don't meet the products on one null key."""
    spread = movements.with_product(movements.narrow_movements(bound), bound)
    assert re.search(r"Join \[product_id#\d+L?, _place#\d+L?\]", plan(spread))


def test_balance_scans_each_ledger_once_and_reads_few_columns(bound):
    text = plan(balance.account_balance(bound))
    assert text.count("lineitem.parquet") == 1
    assert "l_tax" not in text and "l_partkey" not in text


def test_unread_does_not_join_members_with_posts(bound):
    text = plan(QUERIES["news_unread"](bound))
    assert "documents.parquet" in text and not re.search(r"Join.*created_by", text)


def test_large_texts_are_not_read_for_counts(bound):
    for name in ("like_counts", "vote_counts", "news_unread", "user_voted"):
        assert not re.search(r"ReadSchema: struct<[^>]*\b(text|html):", plan(QUERIES[name](bound)))


def test_invariants(bound):
    row = balance.balance_check(bound).first()
    assert row.balance_total == row.ledger_total
    balances = balance.account_balance(bound)
    for mode in ("current", "as_booked"):
        ends = movements.running_balance(bound, mode).groupBy("user_id").agg(
            F.max_by("balance", F.struct("created_at", "kind", "id")).alias("last")
        )
        assert balances.join(ends, "user_id").where("balance <> last").isEmpty()
    sums = movements.movements(bound).groupBy("user_id").agg(F.sum("amount").alias("s"))
    assert balances.join(sums, "user_id").where("balance <> s").isEmpty()

    summary = revenue.revenue_summary(bound, AS_OF).first()
    products = revenue.product_analysis(bound, AS_OF).agg(F.sum("month_units"), F.sum("month_revenue"), F.sum("all_revenue")).first()
    assert (summary.month_units, summary.month_revenue, summary.all_revenue) == tuple(products)
    loose = revenue._sales_of_all_products(bound, AS_OF).where("category_id is null").agg(F.sum("all_revenue")).first()[0]
    listed = revenue.category_analysis(bound, AS_OF).agg(F.sum("all_revenue")).first()[0]
    assert listed + loose == summary.all_revenue and loose > 0

    pages = statement.statement_pages(bound, PRINTED_AT)
    sizes = pages.groupBy("user_id", "page", "pages").count()
    assert sizes.where("(page = 1 and count > 42) or (page > 1 and count > 48)").isEmpty()
    assert sizes.where("page < pages and ((page = 1 and count < 42) or (page > 1 and count < 48))").isEmpty()


def test_stored_ledger(spark, ledger, bound):
    root = fresh_dir(spark, "tables")
    for table in SCHEMAS:
        rows = getattr(ledger, table)
        if table in ("entries", "payments", "adjustments"):
            append_ledger(rows, root, table)
        else:
            write_snapshot(rows, root, table)
    append_ledger(ledger.entries.where("id = 'e5'").withColumn("id", F.lit("e9")), root, "entries")
    stored = read_tables(spark, root)
    assert by_key(balance.account_balance(stored), "user_id", "balance")["u002"] == D("-2.00")
    march = month_rows(stored.entries, AS_OF.replace(year=2024, month=3))
    assert {r.id for r in march.collect()} == {"e1", "e2", "e5", "e6", "e7", "e8", "e9"}
    month = AS_OF.replace(year=2024, month=3)
    # account_month_items numbers staged rows: its scan, of the same month_rows, is not in its last plan
    for frame in (march, movements.month_entries(stored, month), profile.user_month_detail(stored, month)):
        assert "month#" in re.search(r"PartitionFilters: \[([^]]*)\]", plan(frame)).group(1)
    listed = profile.account_month_items(stored, month).select(F.explode("items.id")).collect()
    assert {r[0] for r in listed} == {r.id for r in movements.month_entries(stored, month).collect()}
    assert {r.id for r in movements.month_entries(stored, month).collect()} == {r.id for r in movements.month_entries(ledger, month).collect()} | {"e9"}
    for table, schema in SCHEMAS.items():
        stored_schema = getattr(stored, table).drop("month").schema
        assert [(f.name, f.dataType) for f in stored_schema] == [(f.name, f.dataType) for f in schema]
    assert "code_hash" not in SCHEMAS["users"].names


def test_sinks(spark, ledger):
    from tallybook.operators.profile import account_document

    path = fresh_dir(spark, "statements")
    lines = statement.statement_lines(ledger, PRINTED_AT)
    write_statements(lines, path, lines_per_bucket=20)
    back = spark.read.text(path).select(F.split("value", "\t", 3).alias("v")).selectExpr("v[0] as u", "int(v[1]) as n", "v[2] as line")
    assert back.select("u", "n", "line").exceptAll(lines.selectExpr("user_id", "int(line_no)", "line")).isEmpty()
    assert back.count() == lines.count()

    path = fresh_dir(spark, "documents")
    write_documents(account_document(ledger), path)
    documents = spark.read.text(path)
    assert documents.count() == 5
    assert documents.where("value like '%\"deleted_at\":null%'").count() > 0


def test_every_query_has_sql():
    """All ledger queries; of the others, those that SQL can express."""
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["user_id", "user_key", "name", "role", "balance", "month_spent", "entries_count"]
    assert frame.count() > 100
