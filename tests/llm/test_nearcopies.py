"""Near copies against brute force over shingle sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voidscope.llm import nearcopies


def slow_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def slow_components(rows):
    sets = [slow_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    best = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            best[root(n)] = min(best.get(root(n), i), i)
    return sorted(((i, best.get(root(n))) for n, (i, _) in enumerate(rows)), key=str)


def variants(rng, size, n, edits):
    base = [f"w{rng.randrange(300)}" for _ in range(size)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(size)] = f"x{rng.randrange(3000)}"
        yield " ".join(words)


@pytest.mark.parametrize("small_list", [64, 3])
def test_matches_brute_force(spark, monkeypatch, small_list):
    monkeypatch.setattr(nearcopies, "SMALL_LIST", small_list)
    rng = random.Random(6)
    texts = [None, "", " \t\n", "One", "one", "one two", "ONE\ttwo three", "one two  three", "Ä b c d e f", "ä b c d e f", "a b c d e", "a a a a a a a"]
    for _ in range(12):
        texts += variants(rng, rng.choice([40, 127, 400]), 12, rng.choice([4, 8, 20]))
    chain = [f"c{i}" for i in range(150)]
    for step in range(12):  # neighbors are near, the ends are not
        texts.append(" ".join(chain[step * 6:step * 6 + 90]))
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, "alone without an id here at all"), (1000, None), (900, texts[30])]
    docs = spark.createDataFrame([(i, t, "other") for i, t in rows], "doc_id long, text string, node string")
    found = nearcopies.near_copies(docs).collect()
    expected = slow_components(rows)
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == expected
    assert 30 < len({c for _, c in expected}) < 140


def test_copies_in_the_pipeline_stage(spark):
    """127 words, replaced in two places each: 72 % to 85 % of the shingles, far beyond three SimHash bits."""
    import corpus_pipeline

    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(127)]
    copy, other = list(words), list(words)
    copy[30] = copy[90] = "changed"
    other[20::20] = ["different"] * len(other[20::20])
    docs = spark.createDataFrame([(4, " ".join(words)), (205, " ".join(copy)), (300, " ".join(other))], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [4, 300]


def test_long_list_pairs_are_all_but_connected_ones():
    rng = np.random.default_rng(4)
    members = np.tile(rng.integers(0, 256, nearcopies._BYTES, dtype=np.uint8), (100, 1))
    for row in members:
        row[4 + rng.choice(nearcopies._BYTES - 4, rng.integers(0, 36), replace=False)] += 1
    labels = np.arange(100)
    labels[:40] = 0
    shared = (members[:, None] == members[None]).sum(axis=2)
    expected = {(i, j) for i in range(100) for j in range(i) if labels[i] != labels[j] and shared[i, j] >= nearcopies.MIN_SHARED}
    least = nearcopies.MIN_SHARED
    found = [(max(x, y), min(x, y)) for i, j in nearcopies.list_pairs(members, labels, least, 0) for x, y in zip(i.tolist(), j.tolist())]
    assert len(found) == len(set(found)) and set(found) == expected
    assert not [i for i, _ in nearcopies.list_pairs(members, labels, least, 3) if len(i)]  # all share band 0


def test_lists_over_many_batches():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    keys = np.sort(rng.integers(0, 30, 500))
    keys[100:300] = keys[100]
    nodes = np.arange(500)
    rows = [bytes(rng.integers(0, 256, 80, dtype=np.uint8)) for _ in nodes]
    table = pa.record_batch([pa.array(keys), pa.array(nodes), pa.array(nodes), pa.array(rows, pa.binary())], ["key", "node", "label", "sketch"])
    for size in (1, 7, 64, 1000):
        got = {k: n.tolist() for k, n, _, _ in nearcopies._lists(table.slice(i, size) for i in range(0, 500, size))}
        assert got == {int(k): nodes[keys == k].tolist() for k in np.unique(keys) if (keys == k).sum() > 1}


def test_one_row_of_each_class_stays(spark):
    """Ids that stand for several texts, rows without an id and repeated rows."""
    rng = random.Random(3)
    base, other, third = (" ".join(f"{w}{rng.randrange(900)}" for _ in range(60)) for w in "abc")
    rows = [(7, base), (9, base), (9, other), (7, third), (7, third), (None, other), (None, "only here"), (None, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.stays, r.component_id) for r in nearcopies.classes(docs).collect())
    assert got == sorted([("7", True, 7), ("9", False, 7), ("9", True, 9), ("7", True, 7), ("7", True, 7), ("None", False, 9),
                          ("None", True, None), ("None", True, None)])


def test_long_fingerprint_keeps_pairs_at_the_least_similarity():
    rng = np.random.default_rng(7)
    for _ in range(300):
        common, left, right = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))
        a, b = (np.frombuffer(nearcopies.sketch(np.r_[common, x], nearcopies.LONG), np.uint8) for x in (left, right))
        assert (a == b).sum() >= nearcopies.LONG_SHARED


def test_recall_of_the_index():
    """Pairs at the least similarity, by simulation of the fingerprint."""
    rng = np.random.default_rng(5)
    hit = 0
    for _ in range(1000):
        common, left, right = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (80, 10, 10))
        a, b = (np.frombuffer(nearcopies.sketch(np.r_[common, x]), np.uint8) for x in (left, right))
        same = (a == b).reshape(nearcopies.BANDS, nearcopies.WIDTH)
        hit += same.all(axis=1).any() and same.sum() >= nearcopies.MIN_SHARED
    assert hit >= 997


def test_empty_table(spark):
    found = nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string"))
    assert found.count() == 0 and found.columns == ["doc_id", "component_id"]


def test_stages_judge_each_row_by_its_own_text(spark, monkeypatch):
    """Different texts of one id, rows without an id, repeated rows and clashing columns in the filtering stages."""
    import corpus_pipeline
    from voidscope.llm import toxicity

    rng = random.Random(4)
    base, other, third = (" ".join(f"{w}{rng.randrange(900)}" for _ in range(60)) for w in "abc")
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(7, base, 1), (9, base, 2), (9, other, 3), (7, third, 4), (7, third, 4), (None, item, 5), (None, "only here", 6), (3, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key long").withColumn("_row", F.lit("x"))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["_key"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7]
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: spark.createDataFrame([(1, 1, item)], "item_id long, doc_id long, text string"))
    assert sorted(r["_key"] for r in corpus_pipeline.drop_leaks(spark, docs, "").collect()) == [1, 2, 3, 4, 4, 6, 7]
    monkeypatch.setattr(corpus_pipeline, "toxicity_model", lambda docs, labels: None)
    monkeypatch.setattr(toxicity, "score", lambda docs, model: docs.selectExpr("doc_id", "cast(text like 'a%' as int) as predicted"))
    assert sorted(r["_key"] for r in corpus_pipeline.drop_toxic(spark, docs, "").collect()) == [3, 4, 4, 5, 6, 7]


def test_fingerprint_is_a_simhash():
    """A bit is 1 if set in over half of the scrambled hashes; the share of differing bits follows the angle of the sets."""
    rng = np.random.default_rng(9)
    size = nearcopies._BYTES
    mask = (1 << 64) - 1

    def slow(hashes):
        out = []
        for scramble in nearcopies._SCRAMBLE[:size // 8].tolist():
            ones = [0] * 64
            for h in hashes.tolist():
                z = h + scramble & mask
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
                z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
                z ^= z >> 31
                ones = [n + (z >> i & 1) for i, n in enumerate(ones)]
            out.append(sum(1 << i for i, n in enumerate(ones) if 2 * n > len(hashes)).to_bytes(8, "little"))
        return b"".join(out)

    for n in (1, 2, 7, 255, 256, 600):
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert nearcopies.sketch(hashes) == slow(hashes)
        assert nearcopies.sketch(hashes, nearcopies.LONG)[:size] == nearcopies.sketch(hashes)
    for common, apart in ((160, 20), (100, 100), (1, 200)):
        left, right = (rng.integers(0, 1 << 63, apart, dtype=np.uint64) for _ in range(2))
        both = rng.integers(0, 1 << 63, common, dtype=np.uint64)
        a, b = (np.unpackbits(np.frombuffer(nearcopies.sketch(np.r_[both, x]), np.uint8)) for x in (left, right))
        angle = np.arccos(common / (common + apart)) / np.pi
        assert abs((a != b).mean() - angle) < 0.04


def test_recall_of_short_texts():
    """Sets of four and five shingles at the least similarity: index, heads and count together."""
    rng = np.random.default_rng(15)
    hit = 0
    for _ in range(1000):
        five = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
        a, b = (np.frombuffer(nearcopies.sketch(x), np.uint8) for x in (five[:4], five))
        same = (a == b).reshape(nearcopies.BANDS, nearcopies.WIDTH)
        bits = np.bitwise_count(a ^ b)
        near = bits[:nearcopies.HEAD].sum() <= nearcopies.HEAD_BITS and bits.sum() <= nearcopies.MAX_BITS
        hit += near and same.all(axis=1).any() and same.sum() >= nearcopies.MIN_SHARED
    assert hit >= 985


@pytest.mark.parametrize("small", [64, 5])
def test_near_heads_of_lists(monkeypatch, small):
    monkeypatch.setattr(nearcopies, "LONG_LIST", 150)
    monkeypatch.setattr(nearcopies, "_OPEN_PAIRS", 50)
    rng = np.random.default_rng(12)
    keys = np.sort(np.r_[rng.integers(0, 60, 400), np.full(200, 70)]) | 3 << 32
    heads = rng.integers(0, 256, (40, nearcopies.HEAD), dtype=np.uint8)[rng.integers(0, 40, 600)]
    heads ^= np.packbits(rng.random((600, nearcopies.HEAD * 8)) < 0.12, axis=1)
    heads[keys == 70 | 3 << 32] = heads[-1]
    bits = np.unpackbits(heads, axis=1).astype(int)
    near = (keys[:, None] == keys[None]) & ((bits[:, None] != bits[None]).sum(axis=2) <= nearcopies.HEAD_BITS)
    label = np.arange(600)
    for _ in range(600):
        label = np.where(near, label[None], 600).min(axis=1)
    size = np.bincount(label, minlength=600)[label]
    long = keys == 70 | 3 << 32
    same = (heads[:, None] == heads[None]).reshape(600, 600, -1, nearcopies.WIDTH).all(axis=3)
    own = ~same.any(axis=2) | (same.argmax(axis=2) == 3)
    expected = {(a, b) for a, b in zip(*np.nonzero(near & own)) if a < b and size[a] <= small and not long[a]}
    i, j, large = nearcopies.near_heads(keys, heads, small)
    pairs = list(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected and expected
    groups = {tuple(np.flatnonzero(label == x).tolist()) for x in set(label[(size > small) & ~long].tolist())}
    assert {tuple(g.tolist()) for g in large} == groups | {tuple(np.flatnonzero(long).tolist())}
