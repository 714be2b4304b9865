"""Claims of unique keys against a loop over them, and long chains of claims that decide about each other."""

import random

import pytest

from tallybook.operators import claims as C


def settled(spark, stored, rows):
    frame = spark.createDataFrame([(*row, n) for n, row in enumerate(rows)], "id string, _key string, _at int")
    found = C.settle(spark.createDataFrame(stored, "id string, _key string"), frame)
    return [r._ok for r in sorted(found.collect(), key=lambda r: r._at)]


def in_order(stored, rows):
    held, result = {}, []
    for member, key in stored:
        held[member] = key
    for member, key in rows:
        valid = all(k != key for m, k in held.items() if m != member)
        if valid:
            held[member] = key
        result.append(valid)
    return result


@pytest.fixture
def steps(monkeypatch):
    """Labels of what was written: one entry a round or doubling step, one for the numbered claims."""
    written = []
    plain = C.stage
    monkeypatch.setattr(C, "stage", lambda frame, label: (written.append(label), plain(frame, label))[1])
    return written


def chain(n):
    """Member i holds key i; each in turn claims the key of the one before."""
    return [(f"m{i}", f"k{i}") for i in range(n)], [("m0", "free")] + [(f"m{i}", f"k{i - 1}") for i in range(1, n)]


def test_chain_of_ten_thousand(spark, steps):
    stored, rows = chain(10_000)
    assert settled(spark, stored, rows) == [True] * 10_000 and len(steps) < 20


def test_a_chain_that_fails_at_its_start(spark, steps):
    stored, rows = chain(3000)
    got = settled(spark, [*stored, ("x", "free")], rows)
    assert got == [False] * 3000 and len(steps) < 20


def test_chain_of_opposites(spark, steps):
    """Member i claims the key of i - 1 just before i - 1 comes back to it or not: every other one gets through."""
    stored = [("m0", "k0")]
    rows = [("m0", "k0")] + [row for i in range(1, 200) for row in ((f"m{i}", f"k{i - 1}"), (f"m{i}", f"k{i}"))]
    assert settled(spark, stored, rows) == in_order(stored, rows) and len(steps) < 20


@pytest.mark.parametrize("seed", range(3))
def test_random_claims(spark, seed):
    rng = random.Random(seed)
    members, keys = [f"m{i}" for i in range(rng.randint(2, 30))], [f"k{i}" for i in range(rng.randint(2, 40))]
    stored = [(m, rng.choice(keys)) for m in members if rng.random() < 0.6]  # keys may be shared from the start
    rows = [(rng.choice(members), rng.choice(keys)) for _ in range(rng.randint(20, 150))]
    assert settled(spark, stored, rows) == in_order(stored, rows)


def test_repeated_and_no_claims(spark):
    stored = spark.createDataFrame([("a", "k")], "id string, _key string")
    rows = spark.createDataFrame([("b", "k", 1), ("b", "k", 1), ("b", "k", 2)], "id string, _key string, _at int")
    assert sorted((r._at, r._ok) for r in C.settle(stored, rows).collect()) == [(1, False), (2, False)]
    assert C.settle(stored, rows.limit(0)).isEmpty()


def test_members_who_claim_taken_keys_again_and_again(spark, steps):
    """Each claim hangs on several open ones; the rounds don't grow with the number of claims a member makes."""
    rng = random.Random(7)
    rows = [(f"m{rng.randint(0, 39)}", f"k{rng.randint(0, 9)}") for _ in range(2000)]
    assert settled(spark, [], rows) == in_order([], rows) and len(steps) < 20


def test_failed_claims_leave_the_rounds(spark, monkeypatch):
    written = []
    plain = C.stage
    monkeypatch.setattr(C, "stage", lambda frame, label: (written.append(plain(frame, label)), written[-1])[1])
    rng = random.Random(11)
    rows = [(f"m{rng.randint(0, 99)}", f"k{rng.randint(0, 19)}") for _ in range(400)]
    assert settled(spark, [], rows) == in_order([], rows)
    sizes = [frame.count() for frame in written]
    assert len(sizes) > 3 and sizes[-1] < 400


def test_keys_shared_from_the_start(spark):
    """A claim waits for all other holders, and each of them may claim the key again when the others are gone."""
    stored = [(f"m{i}", "k") for i in range(4)]
    rows = [row for i in (2, 0, 3) for row in (("x", "k"), ("m1", "k"), (f"m{i}", f"own{i}"))] + [("x", "k"), ("m1", "k"), ("m1", "free"), ("x", "k"), ("m1", "k")]
    got = settled(spark, stored, rows)
    assert got == in_order(stored, rows) and got[-5:] == [False, True, True, True, False]


def test_numbers_follow_the_order_of_claims(spark, monkeypatch):
    written = []
    plain = C.stage
    monkeypatch.setattr(C, "stage", lambda frame, label: (written.append(plain(frame, label)), written[-1])[1])
    rng = random.Random(3)
    frame = spark.createDataFrame([(rng.randint(0, 50), "k", rng.randint(0, 5000)) for _ in range(3000)], "id int, _key string, _at int").repartition(16)
    C.settle(frame.select("id", "_key").limit(0), frame)
    rows = [(r._at, r.id) for r in written[0].orderBy("_n").collect()]
    assert rows == sorted(rows)
