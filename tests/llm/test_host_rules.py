"""Host rules against a plain version, and the hosts' rates."""

import re
from collections import Counter

import pytest

from tallybook.llm.common import prepare
from tallybook.llm.host_rules import host_rates, judge_documents, measures
from tests.llm import brute

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain(doc_id, text):
    words = brute.WORDS.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if brute.WORDS.search(line)]
    symbols = len(re.findall("[#*$%&|<>]", text or ""))
    return (
        doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), len(words) < 10 or 100 * len(repeated) > 20 * len(words),
    )


def test_measures(spark, frame, texts, rows_of):
    prepare(spark)
    rows = [*texts, (None, "# a|b\n# a|b\n\n \n"), (None, None), (700, "\n\n"), (701, "  x y \U0001f600 z\x0b\x0c\r\tq"), (702, "a b c d e " * 3), (703, "x " * 30_000)]
    rows += [(704, "a b c d e f a b c d e"), (705, "p a b c d e q a b c d e r\n" * 2), (705, "<<>>" * 9)]
    got = rows_of(judge_documents(frame(rows)), *COLUMNS)
    assert got == {plain(*r) for r in rows}
    assert judge_documents(frame(rows)).count() == len(rows)
    assert judge_documents(frame([])).collect() == []


@pytest.fixture(scope="module")
def hosts(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "bad.org", "too short" if i % 10 else good) for i in range(200)]
    rows += [(1000 + i, f"h{i % 20}.org", "short" if i % 40 == 0 else good) for i in range(2000)]
    rows += [(5000, "tiny.org", "short"), (5001, "tiny.org", good), (5002, None, good)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_hosts_are_judged_and_small_ones_shrunk(hosts):
    prepare(hosts.sparkSession)
    judged = {r.doc_id: r for r in judge_documents(hosts).collect()}
    assert all(judged[i].host_rejected and not judged[i].kept for i in range(200))
    assert not judged[0].base_failed
    assert not judged[5001].host_rejected and judged[5001].kept and judged[5002].kept and not judged[5000].kept
    assert [judged[1000 + i].kept for i in range(2000)] == [i % 40 != 0 for i in range(2000)]
    rates = {r.host: r for r in host_rates(measures(hosts)).collect()}
    assert 0.85 < rates["bad.org"].base < 0.9 and rates["h1.org"].base < 0.01 < rates[""].base < rates["tiny.org"].base < 0.5
    assert rates["bad.org"].n == 200 and rates["bad.org"].symbols == 0


def test_equal_hosts_have_the_common_rate(spark):
    rows = spark.createDataFrame([(i, f"h{i % 4}", "short" if i < 8 else "a b c d e f g h i j k") for i in range(32)], "doc_id long, source string, text string")
    assert {round(r.base, 12) for r in host_rates(measures(rows)).collect()} == {0.25}


def test_no_python_on_the_way(spark, frame, texts):
    plan = judge_documents(frame(texts))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
    assert "Python" not in measures(frame(texts))._jdf.queryExecution().toString()
