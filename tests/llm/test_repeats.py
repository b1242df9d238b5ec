"""Long repeats against brute force."""

import hashlib
import random

import numpy as np
import pytest

from voidscope.llm import repeats
from voidscope.llm.registry import op13_suffix_dedup
from voidscope.llm.runindex import RunIndex

SCHEMA = "doc_id long, text string, block string, found string"


def slow(rows, length=50):
    """(id, text) -> digest rows, by the first document of every window."""
    none = float("inf")
    first = {}
    data = [(none if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, none), i)
    out = []
    for (i, _), (key, b) in zip(rows, data):
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < key:
                gone[p:p + length] = [True] * length
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "b", "f") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in repeats.digest(repeats.without_repeats(docs, **kw)).collect()), key=str)


def passages(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(2, 8))) for _ in range(60)]
    shared = [" ".join(r.choice(words) for _ in range(r.randint(8, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [r.choice(shared) if r.random() < 0.5 else " ".join(r.choice(words) for _ in range(r.randint(1, 30)))
                 for _ in range(r.randint(0, 6))]
        rows.append((r.choice([i, i, i // 2]), " | ".join(parts)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("length", [1, 3, 7, 20, 50])
def test_index_matches_brute_force(length):
    r = random.Random(length)
    for _ in range(15):
        letters = r.choice([b"ab", b"abc", bytes(range(256)), b"\0\xff"])
        strings = [bytes(r.choice(letters) for _ in range(r.randint(0, 70))) for _ in range(r.randint(1, 10))]
        strings += [s[r.randint(0, 9):] for s in strings if r.random() < 0.5]
        owners = [r.randint(0, 9) for _ in strings]
        index = RunIndex(strings, np.array(owners), length)
        asked = strings + [bytes(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(4)]
        match, least, starts = index.matching_statistics(asked)
        for k, p in enumerate(asked):
            for i in range(len(p)):
                best = 0
                while best < min(length, len(p) - i) and any(p[i:i + best + 1] in s for s in strings):
                    best += 1
                assert match[starts[k] + i] == best
                if best == length:
                    assert least[starts[k] + i] == min(o for o, s in zip(owners, strings) if p[i:i + length] in s)


def test_runs_grow_with_the_difference_not_with_the_copies():
    r = random.Random(5)
    base = bytes(r.choice(b"abcd") for _ in range(500))
    copies = [base[:k] + b"z" + base[k:] for k in range(0, 500, 25)]
    one, all_ = RunIndex([base], np.zeros(1), 50), RunIndex(copies, np.arange(len(copies)), 50)
    assert all_.runs < 3 * one.runs and all_.size == 20 * (one.size + 1)


def test_documents_match_brute_force(spark):
    rows = passages(1, 150)
    assert run(spark, rows) == slow(rows)


def test_shorter_length_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(repeats, "SLICE", 333)
    rows = passages(2, 120)
    assert run(spark, rows, length=30) == slow(rows, 30)


def test_hot_marks_are_dealt_out_by_windows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(repeats, "HOT", 3)
    rows = passages(3, 120) + [(1000 + i, "the line that every document of this source carries at its end, always " + str(i)) for i in range(40)]
    assert run(spark, rows) == slow(rows)


def test_edges(spark):
    line = "0123456789" * 5
    rows = [(1, line), (2, line), (2, line), (3, line[:-1]), (4, ""), (5, None), (None, line), (None, line + "x"),
            (6, "a" * 5000), (7, "a" * 49), (8, "a" * 51), (9, "x" + line + "y" + line), (10, "ü" * 40), (11, "ü" * 40),
            (12, line[10:] + "abc" + line[:20])]
    assert run(spark, rows) == slow(rows)
    assert run(spark, []) == []


def test_long_text(spark):
    r = random.Random(9)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300_000))
    rows = [(1, text[100_000:100_200]), (2, text), (3, text[:150_000])]
    assert run(spark, rows) == slow(rows)


def test_query(spark, small_sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op13_suffix_dedup(spark, small_sf).collect()), key=str) == slow(rows)
