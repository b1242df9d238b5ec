"""Regression trees grown as Spark jobs.

Features are cut into at most ``max_bins`` bins. Every tree draws its rows (Poisson weights) and, at each node, the
features it may split, by hashes of its number, the row and the node, so that a task run again gives the same.

1. Nodes with more than ``PART_ROWS`` rows are split level by level: tasks send the weights and label sums of the
   bins, Spark adds them up and takes the best cut of each node.
2. The rows of every smaller node are shuffled to one group, where numpy grows the rest of that tree, a level at
   a time. Such a ``part`` is one row of the model.
3. Scoring sends each row to its part of every tree, and averages what the parts say.

Nodes are numbered as in a heap: the root is 1, the children of i are 2i (left) and 2i + 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voidscope.session import stage

PART_ROWS = 1 << 14  # rows of a node whose subtree one task grows
SCORED_ROWS = 1 << 17  # rows that meet one part in a group
TREE_BLOCKS = 32  # trees are dealt to so many tasks per chunk of rows
CHUNK_ROWS = 1 << 18
SAME = 1e-9  # relative difference below which gains count as equal
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
_BINNED = "key long, label double, bins binary"
_PART = ("tree int, part long, feature array<int>, bin array<int>, child array<int>, value array<double>, "
         "gains array<double>")
_TOP = "tree int, node long, feature int, bin int, gain double"


@dataclass(frozen=True)
class Trees:
    """Cuts per feature (in order), splits of the large nodes, and the parts below them."""

    count: int
    cuts: list[list[float]]
    top: list[tuple[int, int, int, int, float]]  # tree, node, feature, bin, gain
    parts: DataFrame


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the tree draws each row."""
    start = _mixed(np.array([(seed & 0xFFFFFFFF) << 32 | tree + 1], np.uint64))
    uniform = (_mixed(keys.view(np.uint64) ^ start) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_POISSON, uniform, side="right").astype(np.uint8)


def _subsets(tree: int, nodes: np.ndarray, seed: int, features: int) -> np.ndarray:
    """Features that each node may split, a square root of all, in order: of equal cuts the first feature's is taken."""
    start = _mixed(np.array([(seed & 0xFFFFFFFF) << 32 | tree + 1], np.uint64)) ^ np.uint64(0x5851F42D4C957F2D)
    each = np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = _mixed(_mixed(nodes.astype(np.uint64) + start)[:, None] ^ each[None, :])
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :math.ceil(math.sqrt(features))], axis=1)


def fit_cuts(rows: DataFrame, features: int, max_bins: int) -> list[list[float]]:
    """Cuts of each element of ``values``: middles between neighboring values, at quantiles where there are many."""
    shares = [i / max_bins for i in range(1, max_bins)]
    row = rows.agg(*[F.percentile_approx(F.col("values")[i], shares).alias(f"q{i}") for i in range(features)]).first()
    below = [np.unique(row[i]) for i in range(features)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("values"), features)
            for f in range(features):
                place = np.searchsorted(below[f], values[:, f])
                low = np.full(len(below[f]) + 1, np.inf)
                np.minimum.at(low, place, values[:, f])
                seen = np.unique(place)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), f, np.int32)), pa.array(seen.astype(np.int32)),
                                                  pa.array(low[seen])], ["feature", "place", "low"])

    lows = rows.select("values").mapInArrow(run, "feature int, place int, low double")
    lows = lows.groupBy("feature", "place").agg(F.min("low").alias("low")).collect()  # one row per bin
    cuts: list[list[float]] = [[] for _ in range(features)]
    for f, place, low in sorted(lows):
        if place:
            middle = below[f][place - 1] / 2 + low / 2
            cuts[f].append(float(middle if below[f][place - 1] < middle < low else low))
    return cuts


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, features)


def _kind(cuts: list[list[float]]) -> type:
    return np.uint8 if max(map(len, cuts)) < 256 else np.uint16


def binned(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """``key, label, bins`` of ``rows(key, label, values)``: the number of cuts at or below each value."""
    kind = _kind(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("values"), len(cuts))
            bins = np.stack([np.searchsorted(c, values[:, f], side="right") for f, c in enumerate(cuts)], axis=1)
            data = [r.tobytes() for r in bins.astype(kind)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array(data, pa.binary())], ["key", "label", "bins"])

    return rows.mapInArrow(run, _BINNED)


def _unpacked(blobs: list[bytes], kind: type, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(-1, features)


class _Walk:
    """Down the split large nodes of one tree."""

    def __init__(self, top: list[tuple[int, int, int, int, float]]):
        self.trees: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for tree in {t for t, *_ in top}:
            node, feature, cut = zip(*sorted((n, f, b) for t, n, f, b, _ in top if t == tree))
            self.trees[tree] = np.array(node), np.array(feature), np.array(cut)

    def nodes(self, tree: int, bins: np.ndarray) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        if tree not in self.trees or not len(bins):
            return at
        node, feature, cut = self.trees[tree]
        moving = np.arange(len(bins))
        while len(moving):
            place = np.minimum(np.searchsorted(node, at[moving]), len(node) - 1)
            split = node[place] == at[moving]
            moving, place = moving[split], place[split]
            at[moving] = 2 * at[moving] + (bins[moving, feature[place]] > cut[place])
        return at


def _dealt(rows: DataFrame, count: int, trees: int) -> DataFrame:
    """``rows`` once for every block of trees, a chunk of them to a task."""
    blocks, chunks = min(TREE_BLOCKS, trees), count // CHUNK_ROWS + 1
    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    chunk = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(chunks)).cast("int")
    return spread.repartitionById(blocks * chunks, (F.col("block") * chunks + chunk).cast("int"))


def _by_tree(batch: pa.RecordBatch, kind: type, features: int, trees: int):
    """Block rows of a batch: tree, and the batch's keys, labels and bins for it."""
    block = batch.column("block").to_numpy()
    for b in np.unique(block):
        some = np.flatnonzero(block == b)
        part = batch.take(pa.array(some)) if len(some) < batch.num_rows else batch
        bins = _unpacked(part.column("bins").to_pylist(), kind, features)
        for tree in range(int(b), trees, min(TREE_BLOCKS, trees)):
            yield tree, part.column("key").to_numpy(), part.column("label").to_numpy(zero_copy_only=False), bins


def _best_cuts(rows: DataFrame, count: int, trees: int, features: int, kind: type, seed: int, center: float,
               top: list, active: list[tuple[int, int]]) -> list:
    """Best cut of every active node, with the rows and weights on its sides: one row for each."""
    walk = _Walk(top)
    wanted = {t: np.sort(np.array([n for u, n in active if u == t])) for t in {t for t, _ in active}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, keys, labels, bins in _by_tree(batch, kind, features, trees):
                if tree not in wanted:
                    continue
                weight = _weights(keys, tree, seed)
                node = walk.nodes(tree, bins)
                place = np.minimum(np.searchsorted(wanted[tree], node), len(wanted[tree]) - 1)
                used = np.flatnonzero((weight > 0) & (wanted[tree][place] == node))
                if not len(used):
                    continue
                chosen = _subsets(tree, wanted[tree], seed, features)[place[used]]
                slots = chosen.shape[1]
                cell = (((place[used][:, None] * features + chosen) << 16) + bins[used[:, None], chosen]).ravel()
                ids, back = np.unique(cell, return_inverse=True)
                w = np.repeat(weight[used].astype(float), slots)
                y = np.repeat(labels[used] - center, slots)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), tree, np.int32)), pa.array(wanted[tree][(ids >> 16) // features]),
                    pa.array(((ids >> 16) % features).astype(np.int32)), pa.array((ids & 0xFFFF).astype(np.int32)),
                    pa.array(np.bincount(back)), pa.array(np.bincount(back, w)), pa.array(np.bincount(back, w * y))],
                    ["tree", "node", "feature", "bin", "n", "w", "s"])

    found = _dealt(rows, count, trees).mapInArrow(
        run, "tree int, node long, feature int, bin int, n long, w double, s double")
    found = found.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "nws"])
    upto = "(PARTITION BY tree, node, feature ORDER BY bin)"
    whole = "(PARTITION BY tree, node, feature)"
    sides = found.selectExpr("tree", "node", "feature", "bin", *[f"sum({c}) OVER {upto} AS l{c}" for c in "nws"],
                             *[f"sum({c}) OVER {whole} AS {c}" for c in "nws"])
    gain = F.expr("ls * ls / lw + (s - ls) * (s - ls) / nullif(w - lw, 0) - s * s / w")
    best = F.max(F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "ln", "n"))
    rows_ = sides.groupBy("tree", "node").agg(
        best.alias("m"), F.max("w").alias("w"), F.max_by("s", "feature").alias("s"))
    return rows_.select("tree", "node", (-F.col("m.f")).alias("feature"), (-F.col("m.b")).alias("bin"), "m.gain",
                        "m.ln", "m.n", "w", "s").orderBy("tree", "node").collect()


def _runs(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])


def grow(tree: int, root: int, bins: np.ndarray, labels: np.ndarray, weight: np.ndarray, max_depth: int, seed: int):
    """``feature, bin, child, value`` of the nodes of one subtree (feature -1: leaf; ``child`` is the left one, the
    right one follows) and the gain of each feature."""
    features = bins.shape[1]
    center = np.rint(np.average(labels, weights=weight))
    y, w = labels - center, weight.astype(float)
    gains = np.zeros(features)
    feature, cut, child, value = [], [], [], []
    rows, place = np.arange(len(y)), np.zeros(len(y), np.int64)  # open rows and the node of the level they lie in
    heap, made, depth = np.array([root], np.int64), 0, root.bit_length() - 1
    while len(heap):
        k = len(heap)
        total, sums = np.bincount(place, w[rows], k), np.bincount(place, w[rows] * y[rows], k)
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        np.minimum.at(low, place, y[rows])
        np.maximum.at(high, place, y[rows])
        best, at_feature, at_bin = np.zeros(k), np.full(k, -1, np.int32), np.zeros(k, np.int32)
        if depth < max_depth:
            mixed = (low < high)[place]
            rows, place = rows[mixed], place[mixed]
            chosen = _subsets(tree, heap, seed, features)
            for slot in range(chosen.shape[1] if len(rows) else 0):
                code = place << 16 | bins[rows, chosen[place, slot]]
                cells, back = np.unique(code, return_inverse=True)
                node = cells >> 16
                first = _runs(node)
                lw, ls = np.cumsum(np.bincount(back, w[rows])), np.cumsum(np.bincount(back, w[rows] * y[rows]))
                of = np.cumsum(np.isin(np.arange(len(cells)), first)) - 1
                lw -= np.r_[0, lw][first][of]
                ls -= np.r_[0, ls][first][of]
                rw, rs = total[node] - lw, sums[node] - ls
                last = np.r_[node[1:] != node[:-1], True]
                gain = np.where(last, -1.0, ls * ls / lw + rs * rs / np.where(last, 1, rw) - (sums * sums / total)[node])
                top = np.maximum.reduceat(gain, first)
                hit = np.flatnonzero(gain >= top[of] - SAME * np.abs(top[of]))
                hit = hit[_runs(of[hit])]  # the lowest bin of the best
                better = gain[hit] > best[node[hit]] * (1 + SAME) + 1e-12 * np.abs((sums * sums / total)[node[hit]])
                hit = hit[better]
                best[node[hit]], at_bin[node[hit]] = gain[hit], cells[hit] & 0xFFFF
                at_feature[node[hit]] = chosen[node[hit], slot]
        split = at_feature >= 0
        np.add.at(gains, at_feature[split], best[split])
        rank = np.cumsum(split) - 1
        made += k
        feature.append(at_feature)
        cut.append(at_bin)
        child.append(np.where(split, made + 2 * rank, -1).astype(np.int32))
        value.append(center + sums / total)
        going = split[place]
        rows, place = rows[going], place[going]
        right = bins[rows, at_feature[place]] > at_bin[place]
        heap = np.repeat(heap[split] * 2, 2) + np.tile([0, 1], split.sum())
        place = 2 * rank[place] + right
        depth += 1
    return (*(np.concatenate(x) for x in (feature, cut, child, value)), gains)


def fit_trees(rows: DataFrame, features: int, trees: int, max_depth: int, max_bins: int, seed: int,
              part_rows: int = PART_ROWS) -> Trees:
    """Trees on ``rows(key, label, values)``; rows of one key and tree are drawn equally often."""
    rows = stage(rows, "forest-values")
    cuts = fit_cuts(rows, features, max_bins)
    kind = _kind(cuts)
    rows = stage(binned(rows, cuts), "forest-rows")
    good = F.col("label").isNotNull() & ~F.isnan("label")
    count, labels, mean, low, high = rows.agg(
        F.count("*"), F.count(F.when(good, 1)), F.avg("label"), F.min("label"), F.max("label")).first()
    if not count or labels < count:
        raise ValueError("no rows to learn from" if not count else "a row to learn from has no label")
    center = float(round(mean))
    top, closed = [], []
    active = [(t, 1) for t in range(trees)] if count > part_rows and max_depth and low < high else []
    while active:
        below = []
        for tree, node, feature, cut, gain, left, n, w, s in _best_cuts(
                rows, count, trees, features, kind, seed, center, top, active):
            if gain is None or gain <= 1e-12 * s * s / w:
                closed.append((tree, node, [-1], [0], [-1], [center + s / w], [0.0] * features))
                continue
            top.append((tree, node, feature, cut, gain))
            below += [(tree, 2 * node + side) for side, m in enumerate((left, n - left))
                      if m > part_rows and (2 * node).bit_length() <= max_depth]
        active = below
    parts = _parts(rows, count, trees, features, kind, seed, max_depth, top, [c[:2] for c in closed])
    if closed:
        parts = parts.union(rows.sparkSession.createDataFrame(closed, _PART))
    return Trees(trees, cuts, top, stage(parts, "forest-parts"))


def _parts(rows: DataFrame, count: int, trees: int, features: int, kind: type, seed: int, max_depth: int,
           top: list, closed: list[tuple[int, int]]) -> DataFrame:
    """The subtrees below the large nodes, each grown where its rows meet."""
    walk, shut = _Walk(top), {t: [n for u, n in closed if u == t] for t in {t for t, _ in closed}}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, keys, labels, bins in _by_tree(batch, kind, features, trees):
                weight = _weights(keys, tree, seed)
                node = walk.nodes(tree, bins)
                used = np.flatnonzero((weight > 0) & ~np.isin(node, shut.get(tree, [])))
                used = used[np.argsort(node[used], kind="stable")]
                for some in np.split(used, _runs(node[used])[1:]) if len(used) else []:
                    out.append((tree, int(node[some[0]]), bins[some].tobytes(), labels[some].tobytes(), weight[some].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 3))],
                    ["tree", "part", "bins", "labels", "weights"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        tree, part = (k.as_py() for k in key)
        read = [b"".join(table.column(c).to_pylist()) for c in ("bins", "labels", "weights")]
        grown = grow(tree, part, np.frombuffer(read[0], kind).reshape(-1, features), np.frombuffer(read[1]),
                     np.frombuffer(read[2], np.uint8), max_depth, seed)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        return pa.table([pa.array([tree], pa.int32()), pa.array([part], pa.int64()),
                         *[pa.array([x], pa.list_(k)) for x, k in zip(grown, kinds)]],
                        names=["tree", "part", "feature", "bin", "child", "value", "gains"])

    sent = _dealt(rows, count, trees).mapInArrow(send, "tree int, part long, bins binary, labels binary, weights binary")
    return sent.groupBy("tree", "part").applyInArrow(build, _PART)


def predict(model: Trees, rows: DataFrame) -> DataFrame:
    """``key, prediction``: mean of the trees for every row of ``rows(key, values)``; keys must differ."""
    kind, features, trees = _kind(model.cuts), len(model.cuts), model.count
    walk = _Walk(model.top)
    rows = stage(binned(rows.withColumn("label", F.lit(None).cast("double")), model.cuts), "scored-rows")
    count = rows.count()
    lots = count // SCORED_ROWS + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, keys, _, bins in _by_tree(batch, kind, features, trees):
                node, lot = walk.nodes(tree, bins), _mixed(keys.view(np.uint64)) % np.uint64(lots)
                order = np.lexsort((lot, node))
                for some in np.split(order, np.flatnonzero((np.diff(node[order]) != 0) | (np.diff(lot[order]) != 0)) + 1):
                    out.append((tree, int(node[some[0]]), int(lot[some[0]]), keys[some].tobytes(), bins[some].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                    ["tree", "part", "lot", "keys", "bins"])

    def answer(rows: pa.Table, parts: pa.Table) -> pa.Table:
        keys, values = np.zeros(0, np.int64), np.zeros(0)
        if rows.num_rows and parts.num_rows:
            keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64)
            bins = _unpacked(rows.column("bins").to_pylist(), kind, features)
            feature, cut, child, value = (
                parts.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("feature", "bin", "child", "value"))
            at, moving = np.zeros(len(keys), np.int64), np.arange(len(keys))
            while len(moving):
                moving = moving[feature[at[moving]] >= 0]
                here = at[moving]
                at[moving] = child[here] + (bins[moving, feature[here]] > cut[here])
            values = value[at]
        return pa.table([pa.array(keys), pa.array(values)], names=["key", "value"])

    sent = _dealt(rows, count, trees).mapInArrow(send, "tree int, part long, lot long, keys binary, bins binary")
    parts = model.parts.select("tree", "part", "feature", "bin", "child", "value").withColumn(
        "lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))))
    by = ["tree", "part", "lot"]
    said = sent.groupBy(*by).cogroup(parts.groupBy(*by)).applyInArrow(answer, "key long, value double")
    return said.groupBy("key").agg(F.avg("value").alias("prediction"))


def importances(model: Trees) -> list[float]:
    """Share of each feature in the gain of a tree, averaged over the trees that split."""
    features = len(model.cuts)
    sums = np.zeros((model.count, features))
    below = model.parts.select("tree", F.posexplode("gains").alias("f", "gain")).groupBy("tree", "f").agg(F.sum("gain"))
    for tree, f, gain in below.collect():  # one row for each tree and feature
        sums[tree, f] += gain
    for tree, _, f, _, gain in model.top:
        sums[tree, f] += gain
    sums = sums[sums.sum(axis=1) > 0]
    share = (sums / sums.sum(axis=1, keepdims=True)).sum(axis=0)
    return [float(v) for v in (share / share.sum() if len(sums) else share)]


def save_trees(model: Trees, path: str, spark: SparkSession) -> None:
    model.parts.write.mode("overwrite").parquet(f"{path}/parts")
    spark.createDataFrame(model.top, _TOP).write.mode("overwrite").parquet(f"{path}/top")
    spark.createDataFrame([(model.count, model.cuts)], "count int, cuts array<array<double>>").write.mode(
        "overwrite").parquet(f"{path}/cuts")


def load_trees(path: str, spark: SparkSession) -> Trees:
    count, cuts = spark.read.parquet(f"{path}/cuts").first()
    top = [tuple(r) for r in spark.read.parquet(f"{path}/top").collect()]  # one row per large node
    return Trees(count, [list(c) for c in cuts], top, spark.read.schema(_PART).parquet(f"{path}/parts"))
