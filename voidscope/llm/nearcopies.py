"""Near copies by the similarity of word shingle sets.

Two texts are linked if the Jaccard similarity of their sets of ``WORDS``-word shingles is ``SIMILARITY`` or
more. Candidates come from SimHash through an inverted index on byte positions, as in :mod:`voidscope.llm.simhash`. At 0.8
sets of one size lie 27 degrees apart and about 15 % of the bits differ, where 64 bits guarantee no shared byte; so the
fingerprint is longer.

1. Texts with equal sets (by a hash of 128 bits) collapse.
2. Inverted index on byte positions: ``BANDS`` keys of ``WIDTH`` positions and their bytes each. A posting carries the first
   ``HEAD`` bytes of the fingerprint; inside a list, pairs whose heads differ in more than ``HEAD_BITS`` bits go.
3. The shared positional bytes of the remaining pairs are tallied over the whole fingerprint; pairs below ``MIN_SHARED``
   and those with more than ``MAX_BITS`` differing bits go.
4. The similarity of the remaining pairs is computed exactly, from the texts of both ends.

Inside a list, members hang together over pairs of near heads. Groups of up to ``SMALL_LIST`` members give all these
pairs. A larger group (of lists beyond ``LONG_LIST`` rows the whole list) first gives the pairs with its most
central member only. In a second round, the members of groups that the verified links have left apart get a fingerprint
of ``LONG`` bytes, and the pairs between different classes that reach ``LONG_SHARED`` of them are verified. So a
large group of copies costs one comparison for each member, and no pair of the index is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voidscope.llm.common import slices, texts
from voidscope.llm.simhash import SEED, components, merge
from voidscope.session import stage

WORDS, SIMILARITY = 5, 0.8
#: At similarity 0.8 all keys miss a pair with probability 0.59 ** 20 = 3e-5; the count is four deviations below 64.
#: Sets of one size at the least similarity share 27 % of the bytes, those of 4 and 5 shingles 19 %.
BANDS, WIDTH, MIN_SHARED = 144, 2, 28
#: Bits of the whole fingerprint and of its head that may differ.
MAX_BITS = 500
HEAD, HEAD_BITS = 16, 38
#: The long fingerprint of the second round.
LONG, LONG_SHARED = 640, 100
SMALL_LIST = 16
LONG_LIST = 2048
_BYTES = BANDS * WIDTH
_SCRAMBLE = np.random.default_rng(11).integers(1, 1 << 63, LONG // 8, dtype=np.uint64)
_NODE_KEY = ["doc_id", "key1", "key2"]
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_HASHES = 255  # bits of so many hashes are counted in one byte
_CELLS = 1 << 22
_CHUNK = 1 << 15  # postings looked at together
_OPEN_PAIRS = 1 << 18


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; the whole sequence if there are too few words."""
    tokens = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) <= words:
        shingles = {b" ".join(tokens)}
    else:
        shingles = set(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def sketch(hashes: np.ndarray, size: int = _BYTES) -> bytes:
    """The SimHash of a set in ``size`` bytes, eight from each scramble of its hashes; empty for an empty set."""
    if not len(hashes):
        return b""
    ones = np.zeros(size * 8, np.int32)
    for start in range(0, len(hashes), _HASHES):
        words = hashes[start:start + _HASHES, None] + _SCRAMBLE[:size // 8]
        for shift, factor in zip((30, 27), _MIX):
            words = (words ^ (words >> np.uint64(shift))) * factor
        words ^= words >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def text_keys() -> list[Column]:
    """128 bits that name the text, NULL and empty alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long, ``key1, key2`` and the text, NULL texts as empty ones."""
    one, two = text_keys()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), one.alias("key1"), two.alias("key2"), text.alias("text"))


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, key1, key2, shape, sketch`` of every row; ``shape`` names the shingle set by 128 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, words) for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in _NODE_KEY),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array([sketch(s) for s in sets], pa.binary())], [*_NODE_KEY, "shape", "sketch"])

    rows = keyed(docs)
    return rows.mapInArrow(run, "doc_id long, key1 long, key2 long, shape binary, sketch binary")


def _keys(raw: list[bytes]) -> np.ndarray:
    """Index keys, one row for each fingerprint."""
    values = np.frombuffer(b"".join(r[:_BYTES] for r in raw), np.uint16).reshape(-1, BANDS)
    return values.astype(np.int64) | np.arange(BANDS, dtype=np.int64) << 32


def _shared(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (rows == one).sum(axis=1)


def central(members: np.ndarray) -> int:
    """The member that agrees most with the commonest byte of each position."""
    commonest = np.array([np.bincount(members[:, p], minlength=256).argmax() for p in range(members.shape[1])], np.uint8)
    return int(_shared(members, commonest).argmax())


def _first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band whose bytes two fingerprints share."""
    return (a[..., :_BYTES].reshape(len(a), BANDS, WIDTH) == b[..., :_BYTES].reshape(len(b), BANDS, WIDTH)).all(axis=2).argmax(axis=1)


def list_pairs(members: np.ndarray, labels: np.ndarray, least: int, band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one list that have different labels, share ``least`` bytes and no key of a band before."""
    # pairs inside the largest label are connected already: only the others are compared with all
    _, place = np.unique(labels, return_inverse=True)
    outside = np.flatnonzero(place != np.bincount(place).argmax())
    rank = np.full(len(members), -1)
    rank[outside] = np.arange(len(outside))
    step = max(1, _CELLS // members.size)
    for start in range(0, len(outside), step):
        some = outside[start:start + step]
        ok = (members[some][:, None, :] == members[None, :, :]).sum(axis=2) >= least
        ok &= (place[some][:, None] != place[None, :]) & (rank[some][:, None] > rank[None, :])
        i, j = np.nonzero(ok)
        if len(i):
            i = some[i]
            own = _first_band(members[i], members[j]) == band
            yield i[own], j[own]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys, nodes, labels and fingerprints of some thousand rows, always whole lists; rows come sorted by key."""
    held: list[list[np.ndarray]] = []
    waiting = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        read = [batch.column(c).to_numpy() for c in ("key", "node", "label")]
        read.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
        cut = int(np.searchsorted(read[0], read[0][-1]))  # the last list may go on in the next batch
        ended = cut or (held and held[-1][0][-1] != read[0][0])
        if ended and waiting + cut >= _CHUNK:
            if cut:
                held.append([p[:cut] for p in read])
            yield tuple(np.concatenate(p) for p in zip(*held))
            held, waiting, read = [], 0, [p[cut:] for p in read]
        held.append(read)
        waiting += len(read[0])
    if held:
        yield tuple(np.concatenate(p) for p in zip(*held))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Key, nodes, labels and fingerprints of every list of two members and more; rows come sorted by key."""
    for keys, nodes, labels, rows in _chunks(batches):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for a, z in zip(starts, np.r_[starts[1:], len(keys)]):
            if z - a > 1:
                yield int(keys[a]), nodes[a:z], labels[a:z], rows[a:z]


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each pair of heads, two words each."""
    return np.bitwise_count(a[:, 0] ^ b[:, 0]) + np.bitwise_count(a[:, 1] ^ b[:, 1])


def _near(groups: np.ndarray, heads: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i, j of rows of one group with near heads; rows are sorted by group."""
    apart, at = 0, np.arange(len(groups))
    while len(at):
        apart += 1
        at = at[:np.searchsorted(at, len(groups) - apart)]
        at = at[groups[at + apart] == groups[at]]
        close = at[_differing(heads[at], heads[at + apart]) <= HEAD_BITS]
        if len(close):
            yield close, close + apart


def near_groups(keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The smallest index that each row is connected with over near heads of one list; rows are sorted by key."""
    labels, waiting, size = np.arange(len(keys)), [], 0
    for i, j in _near(keys, heads):
        waiting.append((i, j))
        size += len(i)
        if size > _OPEN_PAIRS:
            labels = merge(labels, *(np.concatenate(p) for p in zip(*waiting)))
            waiting, size = [], 0
    return merge(labels, *(np.concatenate(p) for p in zip(*waiting))) if waiting else labels


def near_heads(keys: np.ndarray, heads: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Index pairs of near heads inside the lists, and the larger groups. Pairs that share an earlier key of
    their heads are taken from the list of that key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    large = [np.arange(a, a + n) for a, n in zip(starts[sizes > LONG_LIST], sizes[sizes > LONG_LIST])]
    rows = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= LONG_LIST), sizes))
    words = np.ascontiguousarray(heads).view(np.uint64)
    labels = near_groups(keys[rows], words[rows])
    count = np.bincount(labels, minlength=len(rows))[labels] if len(rows) else labels
    order = np.argsort(labels, kind="stable")
    crowd = order[count[order] > small]
    if len(crowd):
        large += np.split(rows[crowd], np.flatnonzero(np.diff(labels[crowd])) + 1)
    few = order[(count[order] > 1) & (count[order] <= small)]
    found = list(_near(labels[few], words[rows[few]]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), large
    i, j = (rows[few[np.concatenate(p)]] for p in zip(*found))
    same = (heads[i] == heads[j]).reshape(len(i), -1, WIDTH).all(axis=2)
    own = ~same.any(axis=1) | (same.argmax(axis=1) == keys[i] >> 32)
    return i[own], j[own], large


def _marked(a, b, key):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([key] * len(a), pa.int64())], ["a", "b", "key"])


def candidates(postings: DataFrame) -> DataFrame:
    """``a, b, key``: pairs of nodes with near heads, from the lists of ``postings(key, node, sketch)``.

    A large group gives only the pairs with its central member, and its members as pairs of a node with itself, with a
    key of the group: that of the list and the place of the group in it.
    """
    small = SMALL_LIST
    rows = postings.repartition("key").sortWithinPartitions("key").withColumn("label", F.col("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, _, heads in _chunks(batches):
            i, j, large = near_heads(keys, heads, small)
            yield _marked(nodes[i], nodes[j], None)
            for group in large:
                key = int(keys[group[0]])
                place = int(group[0] - np.searchsorted(keys, key))  # below LONG_LIST, or 0 of a whole list
                members = nodes[group]
                c = central(heads[group])
                words = heads[group].view(np.uint64)
                near = np.flatnonzero((_differing(words, words[[c]]) <= HEAD_BITS) & (np.arange(len(group)) != c))
                yield _marked(np.full(len(near), members[c]), members[near], None)
                yield _marked(members, members, key | place << 16)

    return rows.mapInArrow(run, "a long, b long, key long")


def open_pairs(rows: DataFrame) -> DataFrame:
    """``a, b``: pairs to verify of different labels, from the groups of ``rows(key, node, label, sketch)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, nodes, labels, members in _lists(batches):
            for i, j in list_pairs(members, labels, LONG_SHARED, key >> 32):
                yield _marked(nodes[i], nodes[j], None)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long").select("a", "b")


def _postings(groups: DataFrame) -> DataFrame:
    """``key, node, sketch``: one row for each index key of ``groups(node, sketch)``, with the head of the fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("sketch").to_pylist()
            keys = _keys(raw)
            heads = pa.array([r[:HEAD] for r in raw], pa.binary())
            for band in range(BANDS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[:, band]), batch.column("node"), heads], ["key", "node", "sketch"])

    return groups.filter("length(sketch) > 0").select("node", "sketch").mapInArrow(run, "key long, node long, sketch binary")


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, packed``: one compressed text for each row of ``wanted(node, doc_id, key1, key2)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch):
                data = [packer.compress(t.encode("utf-8", "replace")) for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in _NODE_KEY), pa.array(data, pa.binary())], [*_NODE_KEY, "packed"])

    rows = keyed(docs).mapInArrow(
        run, "doc_id long, key1 long, key2 long, packed binary").alias("t")
    # one plan at every size: texts stream past the wanted keys of their partition, and are not sorted
    asked = wanted.hint("shuffle_hash").alias("w")
    same = (F.col("t.key1") == F.col("w.key1")) & (F.col("t.key2") == F.col("w.key2")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    return rows.join(asked, same).select("w.node", "t.packed").dropDuplicates(["node"])


def _set_of(packed: bytes, words: int) -> np.ndarray:
    return shingle_set(zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "replace"), words)


def _long_sketches(packed: DataFrame, words: int) -> DataFrame:
    """``node, sketch`` with the long fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(_set_of(t, words), LONG) for t in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "sketch"])

    return packed.mapInArrow(run, "node long, sketch binary")


def _oriented(pairs: DataFrame) -> DataFrame:
    """The pairs with the end of more pairs first, so that the text of a center travels once."""
    degree = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("n"))
    both = pairs.join(degree.toDF("a", "na"), "a").join(degree.toDF("b", "nb"), "b")
    swap = F.col("nb") > F.col("na")
    return both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))


def _compared(pairs: DataFrame, values: DataFrame, made, near) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose ends are near: ``made`` turns the value of a node in ``values(node, value)`` into what
    ``near`` takes two of. The value of ``a`` comes once, before those it is compared with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            a, b, value = (batch.column(c) for c in ("a", "b", "value"))
            kept = []
            for i in range(batch.num_rows):
                found = made(value[i].as_py())
                if not b[i].is_valid:
                    left = found
                elif near(left, found):
                    kept.append((a[i].as_py(), b[i].as_py()))
            x, y = zip(*kept) if kept else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    right = values.toDF("b", "value").join(pairs.hint("shuffle_hash"), "b").select("a", "b", "value")
    first = values.toDF("a", "value").join(pairs.select("a").distinct(), "a", "left_semi").select(
        "a", F.lit(None).cast("long").alias("b"), "value")
    rows = first.union(right).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def tallied(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that share ``MIN_SHARED`` positional bytes of the fingerprints in ``groups(node, sketch)`` and
    differ in at most ``MAX_BITS`` bits."""
    def near(left, right):
        differing = left ^ right
        return (differing == 0).sum() >= MIN_SHARED and np.bitwise_count(differing).sum() <= MAX_BITS

    return _compared(pairs, groups.select("node", "sketch"), lambda raw: np.frombuffer(raw, np.uint8), near)


def verified(pairs: DataFrame, packed: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the similarity."""
    def near(left, right):
        common = len(np.intersect1d(left, right, assume_unique=True))
        return common >= similarity * (len(left) + len(right) - common) - 1e-9

    return _compared(pairs, packed, lambda text: _set_of(text, words), near)


def classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, key1, key2, component_id, stays`` of every row of ``docs(doc_id, text)``.

    ``key1, key2`` name the text. Of every class the row with the smallest id stays (NULL ids last, then the smallest
    keys), with the rows equal to it; ids that stand for several texts are told apart.

    * ``component_id`` is the smallest id reachable over links of the similarity, the row's own included.
    * NULL and empty texts are copies of each other; a text of fewer than ``words`` words is one shingle. A repeated
      row gives a repeated result row; rows without an id get the component of their text (NULL if no member has
      an id). Further columns of the input are not read. An empty table gives an empty result.
    """
    found = stage(sketches(docs, words), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), *_NODE_KEY)
    groups = found.groupBy("shape").agg(F.min(row).alias("first"), F.min("sketch").alias("sketch"))
    # the number is unique in the written table, which later steps read
    groups = stage(groups.withColumn("node", F.monotonically_increasing_id()), "set-groups")
    marked = stage(candidates(_postings(groups)), "candidates")
    pairs = stage(_oriented(marked.filter("a <> b").select("a", "b").distinct()), "candidate-pairs")
    pairs = stage(tallied(pairs, groups), "tallied-pairs")
    members = stage(marked.filter("key is not null").select("key", F.col("a").alias("node")), "long-lists")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct()
    wanted = groups.join(ends, "node", "left_semi").select("node", *[F.col(f"first.{c}").alias(c) for c in _NODE_KEY])
    packed = stage(_packed(docs, stage(wanted, "wanted")), "packed-texts")
    edges = stage(verified(pairs, packed, words, similarity), "near-links")
    rooted = components(edges)
    if members.head(1):
        labels = members.join(rooted, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
        apart = labels.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        labels = stage(labels.join(apart.select("key"), "key", "left_semi"), "open-lists")
        long = stage(_long_sketches(packed.join(labels.select("node").distinct(), "node", "left_semi"), words), "long-sketches")
        more = stage(_oriented(open_pairs(labels.join(long, "node"))), "candidate-pairs")
        edges = edges.union(stage(verified(more, packed, words, similarity), "near-links"))
        rooted = components(edges)
    nodes = groups.select("node", "shape", "first").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = stage(nodes.groupBy("root").agg(F.min("first").alias("kept")), "roots")
    named = stage(nodes.join(roots, "root").select("shape", "kept"), "classes")
    stays = F.col("kept.key1").eqNullSafe(F.col("key1")) & (F.col("kept.key2") == F.col("key2")) & F.col("kept.doc_id").eqNullSafe(F.col("doc_id"))
    return found.join(named, "shape").select(*_NODE_KEY, F.col("kept.doc_id").alias("component_id"), stays.alias("stays"))


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` of every row of ``docs(doc_id, text)``; see :func:`classes`."""
    return classes(docs, words, similarity).select("doc_id", "component_id")
