"""Plain versions of the operators' definitions, for small inputs. Texts come as a list of (id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACES = re.compile("[\x20\x09-\x0d]+")
WORDS = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACES.sub("", text or "")].append((-len(text or ""), doc_id))
    return {
        (doc_id, min(groups[body])[1], len(groups[body]), min(groups[body])[1] == doc_id, sha(body))
        for doc_id, text in rows
        for body in [SPACES.sub("", text or "")]
    }


def contaminated(rows, items, window=10):
    wanted = defaultdict(set)
    for item_id, text in items:
        words = ITEM_WORDS.findall((text or "").translate(ASCII_LOWER))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            wanted[tuple(words[i : i + n])].add(item_id)
    sizes = {len(w) for w in wanted}
    out = set()
    for doc_id, text in rows:
        words = ITEM_WORDS.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in wanted:
                    found |= wanted[tuple(words[i : i + n])]
                    hit |= set(range(i, i + n))
        out.add((doc_id, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def fingerprint(text, words=4):
    found = WORDS.findall((text or "").translate(ASCII_LOWER))
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, distance=4):
    """{fingerprint: smallest fingerprint reachable} by comparing all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= distance:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in prints}


def simhash(rows):
    prints = [(doc_id, fingerprint(text)) for doc_id, text in rows]
    root = linked([p for _, p in prints])
    least = {}
    for doc_id, p in prints:
        least[root[p]] = min(doc_id, least.get(root[p], doc_id))
    return {(doc_id, f"{p:016x}", least[root[p]]) for doc_id, p in prints}


def suffixes(rows, window=50):
    owner = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - window + 1):
            owner[data[i : i + window]] = min(doc_id, owner.get(data[i : i + window], doc_id))
    out = set()
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if owner[data[i : i + window]] < doc_id:
                gone[i : i + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.add((doc_id, len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g))))
    return out


def windows(rows, window=35):
    texts = [(doc_id, WORDS.findall(text or "")) for doc_id, text in rows]
    count = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = set()
    for doc_id, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.add((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out
