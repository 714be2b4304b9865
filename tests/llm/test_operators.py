"""Operators against plain versions of their definitions."""

import random

import pytest

from tallybook.llm import segments, simhash
from tallybook.llm.common import keyed, numbered, prepare
from tallybook.llm.decontaminate import decontaminate
from tallybook.llm.exact_dedup import exact_dedup
from tallybook.llm.simhash import simhash_dedup
from tallybook.llm.substring_dedup import substring_dedup, word_tokens
from tallybook.llm.suffix_dedup import byte_tokens, suffix_dedup
from tests.llm import brute

EXACT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
LEAKS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
PRINTS = ["doc_id", "fingerprint", "component_id"]
BYTES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
WORDS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


@pytest.fixture(scope="module")
def docs(spark, frame, texts):
    prepare(spark)
    return frame(texts).cache()


@pytest.mark.parametrize("bucket_rows", [2, 4096])
def test_exact_dedup(docs, texts, rows_of, bucket_rows):
    assert rows_of(exact_dedup(docs, bucket_rows), *EXACT) == brute.exact(texts)


def test_decontaminate(docs, texts, frame, rows_of):
    items = [(1, "same same same"), (2, None), (3, "!!"), (11, texts[20][1] or "x"), (4, " ".join((texts[50][1] or "").split()[:30])), (5, "the"), (6, "The, THE")]
    items += [(100 + i, t) for i, t in texts[:15]]
    assert rows_of(decontaminate(docs, frame(items, "item_id")), *LEAKS) == brute.contaminated(texts, items)


@pytest.mark.parametrize("cell_rows,agree", [(2048, 2), (3, 1), (2048, 3)])
def test_simhash(docs, texts, rows_of, cell_rows, agree):
    assert rows_of(simhash_dedup(docs, cell_rows=cell_rows, agree=agree), *PRINTS) == brute.simhash(texts)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 2000, 60])
def test_suffix_dedup(docs, texts, rows_of, shard_bytes):
    assert rows_of(suffix_dedup(docs, shard_bytes=shard_bytes), *BYTES) == brute.suffixes(texts)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 2000, 60])
def test_substring_dedup(docs, texts, rows_of, shard_bytes):
    assert rows_of(substring_dedup(docs, shard_bytes=shard_bytes), *WORDS) == brute.windows(texts)


def test_links_of_close_fingerprints(spark):
    """Chains of fingerprints a few bits apart, and a dense group, against all pairs."""
    rng = random.Random(3)
    prints = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.append(p)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
    centre = rng.getrandbits(64)
    prints += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints)]
    for options in ({}, {"agree": 1, "cell_rows": 5}, {"agree": 4}):
        edges = simhash.links(spark.createDataFrame(signed, "fp long"), **options).collect()
        pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in edges]
        root = {p % (1 << 64): p % (1 << 64) for (p,) in signed}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        assert {p: find(p) for p in root} == brute.linked(root)
        if not options:  # every row is in 15 cells, and a cell links each row to one other
            assert len(edges) < 15 * len(signed)


def test_bucket_memory_is_bounded(docs, texts, rows_of, monkeypatch):
    """Small batches and chunks give the same result."""
    monkeypatch.setattr(segments, "FLUSH_KEYS", 10)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    assert rows_of(suffix_dedup(docs), *BYTES) == brute.suffixes(texts)
    assert rows_of(substring_dedup(docs), *WORDS) == brute.windows(texts)
    prepare(docs.sparkSession)


def test_hot_minimisers_are_dealt_out(docs, texts, rows_of, monkeypatch):
    """Runs of frequent minimisers go by longer ones, dealt out, and give the same result; some do, and not all."""
    monkeypatch.setattr(segments, "HOT_LEAST", 3)
    monkeypatch.setattr(segments, "HOT_SHARE", 10_000)
    for tokens, window, gram, count in ((byte_tokens, 50, 16, segments.occurrences_across), (word_tokens, 35, 8, segments.occurrences_anywhere)):
        rows = numbered(keyed(docs))
        table = segments.repeated_keys(rows, tokens, window, gram, count)
        assert 0 < len(table.hot) <= segments.HOT_KEYS << segments.BUCKET_BITS
        salted = segments.travelling_runs(rows, tokens, window, gram, table).groupBy("salt").count().collect()
        assert min(r.salt for r in salted) == 0 and len(salted) > 5
    for shard_bytes in (1 << 20, 60):
        assert rows_of(suffix_dedup(docs, shard_bytes=shard_bytes), *BYTES) == brute.suffixes(texts)
        assert rows_of(substring_dedup(docs, shard_bytes=shard_bytes), *WORDS) == brute.windows(texts)


def test_strings_that_one_text_owns(frame, rows_of):
    """The smallest doc_id keeps what it repeats itself; all others lose it, wherever their rows come."""
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh ", k=90))
    rows = [(9, passage), (4, f"{passage}!{passage}"), (6, f"x{passage}{passage[:60]}"), (4, passage), (11, f"{passage[20:]}?{passage}")]
    got = rows_of(suffix_dedup(frame(rows), shard_bytes=64), *BYTES)
    assert got == brute.suffixes(rows)
    assert {r[2] for r in got if r[0] == 4} == {0}
