"""Operators judge texts, not ids: different texts under one id or without any."""

from tallybook.llm.common import keyed, numbered, prepare
from tallybook.llm.decontaminate import decontaminate
from tallybook.llm.substring_dedup import substring_dedup
from tallybook.llm.suffix_dedup import suffix_dedup
from tests.llm import brute


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


A, B, C = words("a", 60), words("b", 120), words("c", 140)
ROWS = [(1, A), (None, A + " " + words("x", 20)), (None, B), (5, words("y", 30) + " " + A), (5, C)]


def removed(frame, column="n_removed"):
    return sorted((r.doc_id or 0, r[0], r[column]) for r in frame.collect())


def test_bytes(spark, frame):
    prepare(spark)
    got = suffix_dedup(frame(ROWS)).select("n_bytes", "doc_id", "n_removed", "kept_sha256")
    # the text without an id has the smallest; the other texts share nothing
    gone = {(1, A): len(A), (5, ROWS[3][1]): len(A) + 1}
    want = sorted((i or 0, len(t), gone.get((i, t), 0)) for i, t in ROWS)
    found = removed(got)
    assert [(i, n) for i, n, _ in found] == [(i, n) for i, n, _ in want]
    assert [g for _, _, g in found][:2] == [0, 0] and dict(((n, g) for _, n, g in found))[len(C)] == 0
    assert {r.kept_sha256 for r in got.collect()} >= {brute.sha(t) for t in (B, C, ROWS[1][1])}
    assert dict((n, g) for _, n, g in found)[len(A)] == len(A)


def test_windows(spark, frame):
    prepare(spark)
    found = removed(substring_dedup(frame(ROWS)).select("n_words", "doc_id", "n_removed"))
    assert found == [(0, 80, 60), (0, 120, 0), (1, 60, 60), (5, 90, 60), (5, 140, 0)]
    copies = removed(substring_dedup(frame([(7, A), (7, A), (7, B)])).select("n_words", "doc_id", "n_removed"))
    assert copies == [(7, 60, 60), (7, 60, 60), (7, 120, 0)]


def test_passages(spark, frame):
    prepare(spark)
    found = decontaminate(frame(ROWS), frame([(1, A)], "item_id"))
    assert removed(found.select("n_words", "doc_id", "n_hit"), "n_hit") == [(0, 80, 60), (0, 120, 0), (1, 60, 60), (5, 90, 60), (5, 140, 0)]
    assert {(r.n_words, r.contaminated, r.n_items) for r in found.collect()} == {(80, True, 1), (120, False, 0), (60, True, 1), (90, True, 1), (140, False, 0)}


def test_numbers(spark, frame):
    rows = numbered(keyed(frame([*ROWS, (5, C)]))).collect()
    by_text = {r["text"]: r["copy"] for r in rows}
    assert len(rows) == 6 and by_text[A] == 0 and {by_text[B], by_text[ROWS[1][1]]} == {by_text[C], by_text[ROWS[3][1]]} == {1, 2}
    assert {r["copy"] for r in numbered(keyed(frame([(1, A), (2, B), (None, C)]))).collect()} == {0}
