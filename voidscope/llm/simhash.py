"""Near-duplicate documents by 64-bit SimHash and a byte-position inverted index.

Fingerprints are linked at ``MAX_BITS`` differing bits. Three differing bits leave at least five of the
eight bytes alike, so ``MIN_SHARED`` = 5 is the guaranteed number of shared positional bytes. Posting lists
of single bytes would hold 1/256 of all fingerprints and pair them quadratically; the index therefore keeps
the intersections of five single-byte lists: 56 keys per fingerprint, each naming five positions and their
bytes. Every pair that reaches the count meets in at least one list. Inside a list the shared positional
bytes of each pair are tallied, pairs below the minimum go, and the rest are verified on all 64 bits.

A list can hold at most 2^24 different fingerprints (the three free bytes), whatever the input size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voidscope.llm.common import slices, texts
from voidscope.session import stage

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
#: Lists longer than this are linked by bit flips instead of pair blocks; both give the same links.
LONG_LIST = 20_000
_HASHES = 1 << 16


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles; 0 without words, the whole sequence if there are too few words."""
    tokens = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles: Iterator[bytes] = iter([b" ".join(tokens)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
        total = len(tokens) - words + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for done in range(0, total, _HASHES):
        n = min(_HASHES, total - done)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(n)), np.uint64, n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (a signed long) of every row; a NULL text is an empty one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = pa.array([fingerprint(t, words) for t in texts(part.column("text"))], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), found], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def _keys(fp: Column) -> Column:
    """The 56 index keys: number of the position set in the high bits, its five bytes below."""
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = []
    for number, kept in enumerate(combinations(range(8), MIN_SHARED)):
        parts = [F.shiftleft(byte[p], 8 * i) for i, p in enumerate(kept)]
        keys.append(reduce(lambda a, b: a.bitwiseOR(b), parts, F.lit(number << 40).cast("long")))
    return F.array(*keys)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally of equal positional bytes of each pair."""
    return ((a ^ b).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then the exact distance for the pairs that pass it."""
    passed = np.flatnonzero(_shared(a, b) >= MIN_SHARED)
    return passed[np.bitwise_count(a[passed] ^ b[passed]) <= MAX_BITS]


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest label over the links i-j, to the fixed point."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return labels
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def link_list(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within one posting list of distinct sorted fingerprints."""
    k = len(members)
    labels = np.arange(k)
    if k <= LONG_LIST:
        rows = max(1, (1 << 21) // k)
        for start in range(0, k, rows):
            i, j = np.meshgrid(np.arange(start, min(k, start + rows)), np.arange(k), indexing="ij")
            i, j = i[i < j], j[i < j]
            linked = _verified(members[i], members[j])
            labels = merge(labels, i[linked], j[linked])
    else:
        differing = np.bitwise_or.reduce(members ^ members[0])
        free = [np.uint64(1 << b) for b in range(64) if int(differing) >> b & 1]
        for n in range(1, MAX_BITS + 1):
            for flips in combinations(free, n):
                wanted = members ^ np.bitwise_or.reduce(np.array(flips, np.uint64))
                at = np.minimum(np.searchsorted(members, wanted), k - 1)
                hit = np.flatnonzero(members[at] == wanted)
                labels = merge(labels, hit, at[hit])
    other = np.flatnonzero(labels != np.arange(k))
    return members[labels[other]], members[other]


def _link_lists(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys; rows are sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    two = starts[sizes == 2]
    linked = two[_verified(fps[two], fps[two + 1])]
    left.append(fps[linked])
    right.append(fps[linked + 1])
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
        a, b = link_list(np.unique(fps[start:start + size]))
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links that span every linked set of the distinct fingerprints in column ``fp``."""
    postings = distinct.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    postings = postings.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(keys, fps):
            a, b = _link_lists(keys, fps)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([rest_k, batch.column("key").to_numpy()])
            fps = np.concatenate([rest_f, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            cut = np.searchsorted(keys, keys[-1])  # the last list may go on in the next batch
            rest_k, rest_f = keys[cut:], fps[cut:]
            if cut:
                yield out(keys[:cut], fps[:cut])
        if len(rest_k):
            yield out(rest_k, rest_f)

    return postings.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable from each node of ``edges(a, b)``.

    Alternating star contraction; every round is written to the shared folder, so no lineage grows and a
    lost executor repeats one round. Rounds end when a round changes nothing.
    """
    edges = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbors of a node go to the smallest of its neighborhood
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = stage(large, "large-star")
        # small star: smaller neighbors and the node itself go to the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", "a").union(least.select("m", "b")).toDF("a", "b")
        edges = stage(small.filter("a <> b").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``.

    * ``component_id`` is the smallest id reachable over links of at most three bits, the row's own included.
    * NULL and empty texts have fingerprint zero and are linked like any other; a repeated row gives a
      repeated result row; rows without an id get the component of their fingerprint (NULL if no member
      has an id). Further columns of the input are not read. An empty table gives an empty result.
    """
    found = stage(fingerprints(docs, words), "fingerprints")
    # copies collapse before anything is compared; partial aggregation takes hot fingerprints
    groups = stage(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "groups")
    rooted = components(links(groups.select("fp"))).toDF("fp", "root")
    members = groups.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = stage(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    classes = stage(members.join(roots, "root").select("fp", "component_id"), "classes")
    return found.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
