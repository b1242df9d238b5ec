"""Benchmark decontamination by edit distance over words.

A document leaks an item if one of its passages is within ``floor((1 - SIMILARITY) * n)`` word edits of the
item's ``n`` words (lower-cased letters and digits; everything else separates).

1. Windows. With k edits allowed, one of k + 1 pieces of the item stands unchanged in the passage, so only
   item-sized windows that line up with such a piece are looked at: no passage within the bound is lost here,
   and the walk below is not made from each of the corpus's words.
2. CGK embedding. A window and an item are read by the same random walk: step j writes the current word and
   moves on if a random bit of (j, word) is set. Edit distance becomes Hamming distance of the walks.
3. Bit-sampling LSH. Every band compares ``SAMPLED`` places of one walk; a window that agrees with its item in
   any band is a candidate. ``WALKS`` x ``BANDS`` repetitions give the recall measured in the tests.
4. The exact edit distance of every candidate is computed over the window with k words on either side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voidscope.llm.common import slices, texts

SIMILARITY = 0.8
MIN_WORDS = 5  # shorter items are no evidence and match nothing
WALKS, BANDS, SAMPLED = 12, 6, 2
SHIFTS = (0, 1, -1, 2, -2, 3, -3)
ITEM_BLOCK = 20_000  # mean number of items sent to the executors at once
PIECE_BYTES = 1 << 19  # text hashed at a time, which takes about fifty times its bytes
_BITMAP = 20
_PAD = np.uint64(0)
_WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WINDOWS = 4096  # windows embedded at a time
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) | np.uint64(1)  # never the pad


def word_hashes(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts in order, and the number of words of each text."""
    raw = [t.lower().encode("utf-8", "replace") for t in rows]
    a = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    ends_of_text = np.cumsum([len(r) + 1 for r in raw])
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    inside = _WORD_BYTE[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.r_[0, edge]
    start, end = edge[0::2], edge[1::2]  # the last byte is a separator
    power, inverse = _power(len(a) + 1)
    prefix = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * power[:-1], out=prefix[1:])
    h = _mixed((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    return h, np.diff(np.r_[0, np.searchsorted(start, ends_of_text)])


def _sequences(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` consecutive words at every place."""
    n = max(len(words) - length + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(length):
        h = h * _BASE + words[j: j + n]
    return _mixed(h)


@dataclass
class Items:
    """Items with their words, and their pieces sorted by hash for each piece length."""

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # hash, item, place, bitmap
    similarity: float


def index_items(ids: list[int], rows: list[str], similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> Items:
    hashes, counts = word_hashes(rows)
    words = np.split(hashes, np.cumsum(counts)[:-1]) if len(rows) else []
    found: dict[int, list[tuple[int, int, int]]] = {}
    for item, w in enumerate(words):
        n = len(w)
        if n < min_words:
            continue
        pieces = edits_allowed(n, similarity) + 1
        length = n // pieces
        at = _sequences(w, length)
        for p in range(pieces):
            place = p * n // pieces
            found.setdefault(length, []).append((int(at[place]), item, place))
    seeds = {}
    for length, rows_ in found.items():
        rows_.sort()
        h = np.array([r[0] for r in rows_], np.uint64)
        bitmap = np.zeros(1 << _BITMAP, bool)
        bitmap[h >> np.uint64(64 - _BITMAP)] = True
        seeds[length] = (h, np.array([r[1] for r in rows_]), np.array([r[2] for r in rows_]), bitmap)
    return Items(np.array(ids, object), words, seeds, similarity)


def _windows(words: np.ndarray, counts: np.ndarray, items: Items) -> np.ndarray:
    """Distinct (item, text, place) of windows that line up with a piece; places may stand out of the text."""
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    out = [np.zeros((0, 3), np.int64)]
    for length, (h, item, place, bitmap) in items.seeds.items():
        here = _sequences(words, length)
        at = np.flatnonzero(bitmap[here >> np.uint64(64 - _BITMAP)])
        at = at[text[at] == text[at + length - 1]]
        low, high = np.searchsorted(h, here[at]), np.searchsorted(h, here[at], side="right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        seed = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        out.append(np.stack([item[seed], text[at], at - first[text[at]] - place[seed]], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def _cut(words: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``n`` words from ``start``, padded where they leave ``begin..end``."""
    at = start[:, None] + np.arange(n)[None, :]
    inside = (at >= begin[:, None]) & (at < end[:, None])
    return np.where(inside, words[np.clip(at, 0, max(len(words) - 1, 0))], _PAD)


def _plan(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per walk: a random multiplier for each step, and the sampled steps of each band."""
    random = np.random.default_rng(1000 + n)
    steps = max(2 * n, SAMPLED)
    return [(random.integers(1, 1 << 63, steps, dtype=np.uint64) | np.uint64(1),
             random.integers(0, steps, (BANDS, SAMPLED))) for _ in range(WALKS)]


def embed(rows: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """CGK walks over the rows (words, padded): the word read at every step."""
    m, n = rows.shape
    padded = np.concatenate([rows, np.zeros((m, 1), np.uint64)], axis=1)
    at = np.zeros(m, np.int64)
    line = np.arange(m)
    out = np.empty((m, len(multipliers)), np.uint64)
    for j, multiplier in enumerate(multipliers):
        word = padded[line, at]
        out[:, j] = word
        at = np.minimum(at + ((word * multiplier) >> np.uint64(63)).astype(np.int64), n)
    return out


def _agree(rows: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """Whether each row agrees with its item in any band."""
    hit = np.zeros(len(rows), bool)
    for multipliers, bands in _plan(n):
        left, right = embed(rows, multipliers), embed(item, multipliers)
        same = left == right
        for places in bands:
            hit |= same[:, places].all(axis=1)
    return hit


def edit_distance(segments: np.ndarray, sizes: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Least word edit distance of each pattern to any part of its segment (the first ``sizes`` words)."""
    m, n = patterns.shape
    index = np.arange(n + 1)
    row = np.tile(index, (m, 1))
    best = row[:, n].copy()
    for j in range(segments.shape[1]):
        step = np.empty_like(row)
        step[:, 0] = 0
        step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (patterns != segments[:, j][:, None]))
        row = np.minimum.accumulate(step - index, axis=1) + index
        best = np.where(j < sizes, np.minimum(best, row[:, n]), best)
    return best


def leaks(rows: list[str], items: Items) -> list[tuple[int, int, int, int]]:
    """``(row, item, distance, words)`` of every leak found in the texts."""
    words, counts = word_hashes(rows)
    first = np.cumsum(counts) - counts
    found = _windows(words, counts, items)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    sizes = np.array([len(w) for w in items.words], np.int64)
    of = sizes[found[:, 0]] if len(found) else np.zeros(0, np.int64)
    for n in np.unique(of):
        same = found[of == n]
        k = edits_allowed(int(n), items.similarity)
        for start in range(0, len(same), _WINDOWS):
            item, text, place = same[start:start + _WINDOWS].T
            begin, end = first[text], first[text] + counts[text]
            pattern = np.stack([items.words[i] for i in item])
            near = np.zeros(len(item), bool)
            for shift in SHIFTS:
                left = np.flatnonzero(~near)
                if not len(left) or abs(shift) > k:
                    continue
                rows_ = _cut(words, begin[left], end[left], (begin + place)[left] + shift, int(n))
                near[left] |= _agree(rows_, pattern[left], int(n))
            item, text, place, begin, end, pattern = (x[near] for x in (item, text, place, begin, end, pattern))
            if not len(item):
                continue
            low = np.maximum(begin + place - k, begin)
            high = np.minimum(begin + place + n + k, end)
            segment = _cut(words, low, high, low, int(n) + 2 * k)
            distance = edit_distance(segment, high - low, pattern)
            for i, t, d in zip(item, text, distance):
                if d <= k:
                    key = int(t), int(i)
                    out[key] = min(out.get(key, (int(d), 0)), (int(d), int(n)))
                    out[key] = (out[key][0], int(n))
    return [(t, i, d, n) for (t, i), (d, n) in out.items()]


def batch_leaks(batch: pa.RecordBatch, items: Items) -> Iterator[pa.RecordBatch]:
    """Leaks of the rows ``doc_id, text`` of a batch, a piece of it at a time."""
    for part in slices(batch, limit=PIECE_BYTES):
        hits = leaks(texts(part.column("text")), items)
        if hits:
            doc = part.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([doc[t] for t, _, _, _ in hits], pa.int64()),
                pa.array([items.ids[i] for _, i, _, _ in hits], pa.int64()),
                pa.array([d for _, _, d, _ in hits], pa.int32()),
                pa.array([n for _, _, _, n in hits], pa.int32())],
                ["doc_id", "item_id", "distance", "item_words"])


SCHEMA = "doc_id long, item_id long, distance int, item_words int"


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id, distance, item_words, similarity`` of every leak of ``benchmark(item_id, text)`` in
    ``docs(doc_id, text)``, over whole texts; one row for each pair, with its least distance.

    NULL and empty texts hold no passage; items below ``min_words`` words match nothing; items of equal text
    are found each. Repeated rows count once; rows without an id are reported with a NULL id. Further columns
    are not read. An empty table on either side gives an empty result. The benchmark goes to the executors in
    blocks of about ``ITEM_BLOCK`` items; each block is one pass over the documents.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("item_id is not null and text is not null").distinct()
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for b in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(
            index_items([r["item_id"] for r in some], [r["text"] for r in some], similarity, min_words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from batch_leaks(batch, shared.value)

        part = rows.mapInArrow(run, SCHEMA)
        found = part if found is None else found.union(part)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "item_words")).alias("b"))
    return best.select(
        "doc_id", "item_id", "b.distance", "b.item_words", (1 - F.col("b.distance") / F.col("b.item_words")).alias("similarity"))
