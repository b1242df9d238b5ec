"""SimHash against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from voidscope.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(rows):
    """(id, text) -> component by search over all pairs."""
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(len(fps)):
                if label[b] > label[a] and (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                    label[b] = label[a]
                    changed = True
    best = {}
    for (i, _), c in zip(fps, label):
        if i is not None:
            best[c] = min(best.get(c, i), i)
    return sorted(((i, format(f, "016x"), best.get(c)) for (i, f), c in zip(fps, label)), key=str)


def near_variants(seed, n):
    random.seed(seed)
    base = [f"w{random.randrange(50)}" for _ in range(400)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(random.randrange(3)):
            words[random.randrange(len(words))] = f"x{random.randrange(30)}"
        out.append(" ".join(words))
    return out


EDGES = [None, "", " \t\n", "One", "one two", "ONE\ttwo three", "one two  three", "Ä b c d", "ä b c d", "a\u00a0b c d e", "a a a a a a a"]


def test_matches_brute_force(spark):
    texts = EDGES + near_variants(1, 25) + near_variants(2, 10) + ["repeated row of words here"] * 2
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, "one two"), (None, "alone without an id"), (100, None), (5000, "x " * 200_000)]
    docs = spark.createDataFrame([(i, t, "other", "z") for i, t in rows], SCHEMA)
    found = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str) == slow_components(rows)


def test_empty_table(spark):
    found = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and found.columns == ["doc_id", "fingerprint", "component_id"]


def test_long_text_is_counted_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_HASHES", 7)
    assert simhash.fingerprint(text) == whole
    assert np.array([whole], np.int64).view(np.uint64)[0] == slow_fingerprint(text)


@pytest.mark.parametrize("long_list", [1 << 30, 2])
def test_list_links_connect_what_is_linked(monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    random.seed(3)
    centers = [random.getrandbits(24) for _ in range(6)]
    members = {c for c in centers}
    for c in centers:
        x = c
        for _ in range(12):
            for _ in range(random.randrange(1, 5)):
                x ^= 1 << random.randrange(24)
            members.add(x)
    fps = np.array(sorted(members), np.uint64)
    a, b = simhash.link_list(fps)
    assert len(a) < len(fps)  # a forest, not all pairs

    def classes(pairs):
        label = {int(f): int(f) for f in fps}
        for _ in fps:
            for x, y in pairs:
                label[x] = label[y] = min(label[x], label[y])
        return label

    pairs = [(int(x), int(y)) for x in fps for y in fps if x < y and int(x ^ y).bit_count() <= 3]
    assert classes(list(zip(a.tolist(), b.tolist()))) == classes(pairs)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, 1001)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(1, 61)) and roots[1001] == 1000
