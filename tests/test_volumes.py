"""What is written and shuffled on the way to a result: narrow rows, each of them once."""

import re

from pyspark.sql import functions as F

from tallybook.operators import prefix, profile, statement
from tallybook.plans.queries import PRINTED_AT
from tallybook.session import stage


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def staged_frames(monkeypatch):
    """Staged frames by label, as they are written."""
    written = {}

    def keep(rows, label):
        result = stage(rows, label)
        written.setdefault(label, []).append(result)
        return result

    monkeypatch.setattr(prefix, "stage", keep)
    return written


def test_purchases_meet_orders_as_plain_columns(bound):
    """Ids and times of deletion are computed above the join with the orders, not shuffled for it."""
    above, below = optimized(bound.entries).split("Join Inner")
    assert "concat_ws" in above and "concat_ws" not in below and "INTERVAL" not in below


def test_a_document_numbers_a_booking_once(bound, monkeypatch):
    written = staged_frames(monkeypatch)
    profile.account_document(bound)
    bookings = sum(frame.count() for frame in (bound.entries, bound.payments, bound.adjustments))
    assert [frame.count() for frames in written.values() for frame in frames] == [bookings, bookings]


def test_positions_in_different_parts(ledger):
    """With parts of one or two items the two positions of a booking lie in different parts; both lists stay whole."""
    whole = profile.document_items(profile.account_document(ledger))
    for size in (1, 2):
        cut = profile.document_items(profile.account_document(ledger, size))
        assert cut.exceptAll(whole).isEmpty() and whole.exceptAll(cut).isEmpty()


def test_statement_months_come_from_written_rows(bound, monkeypatch):
    months = []
    monkeypatch.setattr(statement, "stage", lambda rows, label: (months.append(optimized(rows)), stage(rows, label))[1])
    statement.statement_lines(bound, PRINTED_AT)
    assert len(months) == 1 and "l_orderkey" not in months[0]


def test_numbered_statement_rows_leave_ids_behind(bound, monkeypatch):
    written = staged_frames(monkeypatch)
    statement.statement_lines(bound, PRINTED_AT)
    assert not {"id", "block", "rank", "length"} & set(written["scan-pieces"][0].columns)


def test_pages_join_no_lines(bound, ledger):
    """The number of pages comes with the lines: none of the joins is on the lines' member."""
    text = statement.statement_pages(bound, PRINTED_AT)._jdf.queryExecution().executedPlan().toString()
    assert "line_no" in text and not re.search(r"line_no#\d+L?[^\n]*\n[^\n]*Join \[user_id", text)
    sizes = statement.statement_pages(ledger, PRINTED_AT).groupBy("user_id").agg(F.max("line_no").alias("n"), F.max("pages").alias("p"))
    assert all(r.p == (1 if r.n <= 42 else 2 + (r.n - 43) // 48) for r in sizes.collect())


def test_rows_of_unknown_members(ledger):
    """They keep their line numbers but have no pages, as they have no header."""
    users = ledger.users.where("id <> 'u001'")
    lines = statement.statement_lines(ledger.replace(users=users), PRINTED_AT)
    got = [r.line_no for r in lines.where("user_id = 'u001'").orderBy("line_no").collect()]
    assert got and got == list(range(7, 7 + len(got)))
    assert statement.statement_pages(ledger.replace(users=users), PRINTED_AT).where("user_id = 'u001'").isEmpty()
