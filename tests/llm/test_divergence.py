"""Source divergence against whole numbers in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tallybook.llm.common import prepare
from tallybook.llm.divergence import Counted, ranked_pairs, ranked_terms, source_divergence
from tests.llm import brute

TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, least=10, top=10):
    groups, docs, by_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERMS.findall((text or "").translate(brute.ASCII_LOWER))
        groups[lang or "", source or ""].update(words)
        by_lang[lang or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for (lang, source), count in groups.items():
        kept = [t for t in docs[lang] if docs[lang][t] >= least]

        def rates(counts):
            n = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // n for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = rates(count), rates(by_lang[lang])
        others = []
        for (l2, s2), c2 in groups.items():
            if l2 == lang and s2 != source:
                r = rates(c2)
                others.append((-sum(f(p[t], r[t]) for t in kept), s2.encode(), s2))
        terms = [(-f(p[t], q[t]), t.encode(), t) for t in kept if count[t] and p[t] > q[t]]
        for part, found, n in (("pair", others, None), ("term", terms, top)):
            out |= {(lang, source, part, item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(found)[:n])}
    return out


def documents(seed, count=240):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Über", "über", "é", "\U0001f600", "Zz"]
    rows = []
    for i in range(count):
        lang, source = rng.choice(["en", "de", None, "fr", ""]), rng.choice(["a", "b", None, "c", "ä", "hot", "hot", "hot"])
        own = vocabulary[len(source or "") * 5 :]
        rows.append((" ".join(rng.choice(own) + rng.choice(["", ",", "1", "-x"]) for _ in range(rng.randint(0, 40))) if rng.random() < 0.95 else None, lang, source))
    # a language with one source, one without kept terms, a group without terms, many equal values
    rows += [("only one here", "it", "x")] * 12 + [("rare", "pt", "p"), (None, "pt", "q"), ("", "pt", "r"), ("123 !!", "en", "silent")]
    rows += [(" ".join(f"t{chr(97 + k)}" for k in range(26)), "es", s) for s in ("m", "m", "n") for _ in range(5)] + [("zebra " * 3, "es", "m")] * 10
    return rows


@pytest.fixture(scope="module")
def table(spark):
    prepare(spark)
    rows = documents(1)
    frame = spark.createDataFrame([(i % 50 or None, *r, "x", 1, 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n long, p long")
    return rows, frame.repartition(4)


def test_against_plain(table, rows_of):
    rows, frame = table
    got = source_divergence(frame)
    assert got.columns == COLUMNS and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert rows_of(got, *COLUMNS) == plain(rows) and got.count() == len(plain(rows))


def test_any_block_tile_and_bound(table, rows_of):
    rows, frame = table
    counted = Counted(frame, 2)
    for block, tile in ((7, 2), (1000, 1), (3, 3)):
        assert rows_of(ranked_pairs(counted, block, tile), *COLUMNS) == {r for r in plain(rows, 2) if r[2] == "pair"}
    assert rows_of(ranked_terms(counted, 3), *COLUMNS) == {r for r in plain(rows, 2, 3) if r[2] == "term"}


def test_empty_and_very_long(spark, rows_of):
    schema = "doc_id long, text string, lang string, source string"
    assert source_divergence(spark.createDataFrame([], schema)).collect() == []
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(n)), "en", s) for n in (1, 60_000, 5) for s in ("a", "b", "c", "d")]
    got = source_divergence(spark.createDataFrame([(1, *r) for r in rows], schema), 3)
    assert rows_of(got, *COLUMNS) == plain(rows, 3)
