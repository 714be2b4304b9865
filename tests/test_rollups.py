"""Closed months give the rows of the ledgers, after late bookings, deletions and retries too; old files read as new ones."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tallybook.operators import balance, profile, revenue, rolled
from tallybook.session import folders, fresh_dir
from tallybook.sources.rollups import close_months, closed_months, touched_months
from tallybook.sources.schemas import SCHEMAS
from tallybook.sources.tables import append_ledger, read_products, read_tables, write_snapshot
from tests.ledger import AS_OF

LEDGERS = ("entries", "payments", "adjustments")


@pytest.fixture()
def root(spark, ledger):
    path = fresh_dir(spark, "tables")
    for table in SCHEMAS:
        rows = getattr(ledger, table)
        if table in LEDGERS:
            append_ledger(rows, path, table, "first")
        else:
            write_snapshot(rows, path, table)
    return path


def same(got, want):
    assert got.columns == want.columns and got.count() == want.count()
    assert got.exceptAll(want).isEmpty()


def agree(t, root, as_of=AS_OF):
    same(rolled.account_balance(t, root), balance.account_balance(t))
    same(rolled.account_month_dashboard(t, root, as_of), profile.account_month_dashboard(t, as_of))
    same(rolled.revenue_summary(t, root, as_of), revenue.revenue_summary(t, as_of))
    active = balance.account_overview(t, as_of, ordered=False)
    columns = ["user_id", "balance", "month_spent", "entries_count"]
    same(rolled.purchase_counts(t, root, as_of).join(active.select("user_id"), "user_id", "left_semi").select(columns), active.select(columns))


def test_closed_months(spark, root):
    t = read_tables(spark, root)
    agree(t, root)  # nothing is closed
    months = sorted({m for ledger in LEDGERS for m in touched_months(getattr(t, ledger))})
    open_month = AS_OF.replace(day=1)
    close_months(t, root, [m for m in months if m < open_month])
    assert closed_months(spark, root) == [m for m in months if m < open_month] != []
    agree(t, root)
    close_months(t, root, months)
    agree(t, root)
    agree(t, root, dt.date(2024, 2, 1))


def test_closed_months_are_not_read_again(spark, root):
    t = read_tables(spark, root)
    close_months(t, root, [m for m in touched_months(t.entries) if m < AS_OF.replace(day=1)])
    plan = rolled.account_balance(t, root)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[[^]]*total#.*?PartitionFilters: \[([^]]*)\]", plan)
    assert scans and all("month#" in filters and "NOT" in filters.upper() for filters in scans)


def test_late_bookings_deletions_and_retries(spark, root):
    t = read_tables(spark, root)
    close_months(t, root, touched_months(t.entries))
    late = t.entries.where("id = 'e1'").drop("month").withColumn("id", F.lit("e99"))
    before = {r.user_id: r.balance for r in balance.account_balance(t).collect()}
    total, user = late.select("total", "user_id").first()
    for _ in range(2):  # the job is tried again
        append_ledger(late, root, "entries", "late")
        t = read_tables(spark, root)
        assert t.entries.where("id = 'e99'").count() == 1
        assert {r.user_id: r.balance for r in rolled.account_balance(t, root).collect()} == before | {user: before[user] - total}
        agree(t, root)
    assert len(folders(spark, f"{root}/entries/month={touched_months(late)[0]}")) == 2
    # every booking of a closed month is deleted
    month = touched_months(late)[0]
    gone = t.replace(entries=t.entries.withColumn("deleted_at", F.when(F.col("month") == F.lit(month), F.col("created_at")).otherwise(F.col("deleted_at"))))
    close_months(gone, root, [month])
    agree(gone, root)
    assert month in closed_months(spark, root)


def test_appends_without_a_name_add_up(spark, root):
    t = read_tables(spark, root)
    n, more = t.payments.count(), t.payments.drop("month")
    rows = spark.createDataFrame(more.collect(), more.schema)
    append_ledger(rows, root, "payments")
    append_ledger(rows, root, "payments")
    assert read_tables(spark, root).payments.count() == 3 * n


def test_products_of_every_version_in_one_folder(spark, ledger):
    path = fresh_dir(spark, "versions")
    write_snapshot(ledger.categories.unionByName(ledger.categories.where("id = 'c1'").withColumns({"id": F.lit("c0"), "title": F.lit("Allgemein")})), path, "categories")
    old = ledger.products.where("id in ('p1', 'p2')").select("id", "name", "price", "active", "created_at")
    old.write.parquet(f"{path}/products")
    ledger.products.where("id not in ('p1', 'p2')").select(*SCHEMAS["products"].names).write.mode("append").parquet(f"{path}/products")
    found = {r.id: r for r in read_products(spark, path).collect()}
    assert len(found) == 5 and read_products(spark, path).schema.names == SCHEMAS["products"].names
    for key in ("p1", "p2"):
        assert (found[key].category_id, found[key].description, found[key].excluded_from_revenue, found[key].updated_at) == ("c0", "", False, found[key].created_at)
    new = {r.id: r for r in ledger.products.collect()}
    assert found["p3"] == new["p3"].__class__(*[new["p3"][n] for n in SCHEMAS["products"].names]) or found["p3"].asDict() == {n: new["p3"][n] for n in SCHEMAS["products"].names}
    assert found["p4"].category_id == "c0"
