"""Fill-in-middle frames against a direct text version."""

import hashlib
import re

import pytest

from voidscope.llm import middle

SCHEMA = "doc_id long, text string, frames string, n string"


def slow(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, mid, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{mid}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{mid}"
    lengths = (None, None) if form == "plain" else (len(prefix), len(mid))
    return (i, n, form, *lengths, out)


def digested(rows):
    return sorted(((i, n, f, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                   for (i, t), (_, n, f, p, m, out) in ((r, slow(*r)) for r in rows)), key=str)


ROWS = [
    *[(i, "Some words, and more: ünï😀 " * (i % 7) + "x" * i) for i in range(60)],
    (100, ""), (101, None), (None, "no id here"), (7, "repeated"), (7, "repeated"), (7, "other text"),
    (102, "a <P> b"), (103, "<S>"), (104, "x<M>"), (105, "<<P <S <M> <"), (106, "ends with <S"), (107, "<P"),
    (108, "\n\n\t "), (109, "A" * 500), (110, "é" * 500), (111, "<" * 300), (112, "ab<" * 100),
]


@pytest.mark.parametrize("frame_bytes", [1, 5, 64, 1 << 16])
def test_matches_direct_version(spark, frame_bytes):
    docs = spark.createDataFrame([(i, t, "f", "n") for i, t in ROWS], SCHEMA)
    found = middle.rearrange(middle.write_frames(docs, frame_bytes)).cache()
    assert sorted((tuple(r) for r in middle.digest(found).collect()), key=str) == digested(ROWS)
    texts = sorted((tuple(r) for r in middle.output_texts(found).collect()), key=str)
    assert texts == sorted(((i, slow(i, t)[2], slow(i, t)[5]) for i, t in ROWS), key=str)
    found.unpersist()


def test_every_cut_of_one_text():
    text = "ab,cd é\nef<" * 3
    data = text.encode()
    import numpy as np

    for size in (1, 2, 3, 7, 100):
        raw = np.frombuffer(data, np.uint8)
        cuts, _ = middle._frame_ends(raw, np.array([0]), np.array([len(data)]), size)
        char, unit = middle._begins(raw)
        starts = [0, *cuts[:-1].tolist()]
        import zstandard

        pack = zstandard.ZstdCompressor()
        frames = middle.Frames(
            [pack.compress(data[a:z]) for a, z in zip(starts, cuts.tolist())],
            np.cumsum(unit)[cuts - 1].tolist(), np.cumsum(char)[cuts - 1].tolist(), cuts.tolist())
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        for k in range(len(units) + 1):
            j, at, chars = frames.seek(k)
            offset = (starts + [len(data)])[j] + at
            assert data[:offset].decode() == "".join(units[:k]) and chars == len("".join(units[:k]))


def test_only_cut_frames_are_opened():
    import numpy as np
    import zstandard

    data = b"word " * 100_000
    raw = np.frombuffer(data, np.uint8)
    cuts, _ = middle._frame_ends(raw, np.array([0]), np.array([len(data)]), 1000)
    char, unit = middle._begins(raw)
    pack = zstandard.ZstdCompressor()
    starts = [0, *cuts[:-1].tolist()]
    row = {"doc_id": 1, "marked": False, "bytes": cuts.tolist(), "units": np.cumsum(unit)[cuts - 1].tolist(),
           "chars": np.cumsum(char)[cuts - 1].tolist(), "frames": [pack.compress(data[a:z]) for a, z in zip(starts, cuts.tolist())]}
    opened = []
    plain = middle.Frames.frame
    try:
        middle.Frames.frame = lambda self, j: opened.append(j) or plain(self, j)
        n, form, before, length, out = middle._rearranged(row, 1, pack)
    finally:
        middle.Frames.frame = plain
    assert form != "plain" and len(set(opened)) <= 2
    assert b"".join(middle.restored(out, form)) == data


def test_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert middle.digest(middle.rearrange(middle.write_frames(docs))).collect() == []
    rows = [(i, "long text; " * 40_000) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in middle.digest(middle.rearrange(middle.write_frames(docs))).collect()), key=str) == digested(rows)
