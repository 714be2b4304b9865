"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallybook.llm.common import prepare
from tallybook.llm.prefix_trie import conversation_trie, count_min, prefixes, screened

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn int, role string, text string, depth long, g1 string, shared string"


def plain(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            found[conv].append((turn is not None, turn or 0, tie, (role, text)))
    turns = {c: [t[3] for t in sorted(ts)] for c, ts in found.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append((c, len(rebuilt)))
    out = set()
    for node, ms in members.items():
        under = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in under if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n)
        ends = ",".join(str(c) for c, size in sorted(ms) if size == len(node))
        parent = min(members[node[:-1]])[0] if node else None
        children = sum(1 for m in members if m and m[:-1] == node)
        out.add((min(ms)[0], len(node), parent, len(ms), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 700), 150):
        kind = rng.random()
        for turn in range(rng.randint(1, 9)):
            text = "hello" if kind < 0.4 else rng.choice(["a", "bb", "", None, "\U0001f600é", "ü" * 5])
            rows.append((c, None if rng.random() < 0.05 else turn, rng.choice(["user", "user", None]), text))
    rows += [(800 + i, t, "user", f"same {t}") for i in range(90) for t in range(7)]  # copies of one conversation
    rows += rng.sample(rows, 20) + [(None, 0, "user", "nobody's"), (5, 3, "a", "tie"), (5, 3, "b", "tie"), (5, 3, "a", "tie")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def build(spark):
    prepare(spark)
    return lambda rows: spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("bits", [None, 3, 12])
def test_against_plain(build, rows_of, bits):
    rows = conversations(2)
    want = plain(rows)
    got = conversation_trie(build(rows), bits)
    assert got.columns == COLUMNS and {k for _, k in got.dtypes} == {"bigint", "string"}
    assert rows_of(got, *COLUMNS) == want and got.count() == len(want)


def test_the_sketch_never_calls_a_shared_prefix_single(build):
    found = prefixes(build(conversations(3)))
    for bits in (3, 8, 14):
        assert len(count_min(found, bits)[0]) * 8 == max(8, 1 << bits)
        flagged = screened(found, bits)
        shared = {r[:3] for r in map(tuple, found.groupBy("depth", "g1", "g2").count().where("count > 1").collect())}
        single = {tuple(r) for r in flagged.where("not shared").select("depth", "g1", "g2").collect()}
        assert not shared & single and (bits < 14 or single)


def test_edge_cases(spark, build, rows_of):
    assert conversation_trie(build([])).collect() == []
    assert conversation_trie(build([(None, 1, "a", "b")])).collect() == []
    # 1 takes more turns of the missing 0 than it has itself: it has no turns; long conversations and texts
    for rows in ([(1, 0, "u", "x")], [(7, t, "u", "y" * 1000 if t else "z" * 200_000) for t in range(60)] + [(8, t, "u", "w") for t in range(60)], [(100, 0, None, None), (100, 0, None, None)]):
        assert rows_of(conversation_trie(build(rows)), *COLUMNS) == plain(rows)
