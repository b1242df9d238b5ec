"""Trees grown as jobs: parts, cuts, scoring, importances."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voidscope.operators import forest


def _rows(spark, n, seed=3, features=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, features)).round(3)
    y = np.rint(20 * x[:, 0] + 8 * x[:, 1] * x[:, 2] + rng.normal(size=n))
    data = [(int(k), float(v), [float(u) for u in r]) for k, (v, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(data, "key long, label double, values array<double>"), x, y


def _answers(model, rows):
    return {r["key"]: r["prediction"] for r in forest.predict(model, rows).collect()}


def test_large_nodes_give_the_same_trees(spark):
    """Splitting nodes over tasks and growing them in one place are the same trees."""
    rows, x, y = _rows(spark, 900)
    whole = forest.fit_trees(rows, 6, 12, 30, 256, 42)
    dealt = forest.fit_trees(rows.repartition(5), 6, 12, 30, 256, 42, part_rows=60)
    assert not whole.top and len(dealt.top) > 12 * 5
    assert max(n for _, n, *_ in dealt.top) > 4 and dealt.parts.count() > whole.parts.count() == 12
    one, two = _answers(whole, rows), _answers(dealt, rows)
    assert len(one) == 900 and one == pytest.approx(two)
    assert forest.importances(whole) == pytest.approx(forest.importances(dealt))
    fit = np.array([one[k] for k in range(900)])
    assert 1 - ((fit - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.95


def test_subtree_by_brute_force():
    """With all features at hand the root split is the best of all cuts, and leaves are pure."""
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 9, (70, 1)).astype(np.uint8)
    labels, weight = rng.normal(size=70), rng.integers(1, 4, 70).astype(np.uint8)
    feature, cut, child, value, gains = forest.grow(0, 1, bins, labels, weight, 30, 5)

    def spread(some):
        mean = np.average(labels[some], weights=weight[some])
        return (weight[some] * (labels[some] - mean) ** 2).sum()

    found = {b: spread(np.full(70, True)) - spread(bins[:, 0] <= b) - spread(bins[:, 0] > b) for b in range(bins.max())}
    assert cut[0] == max(found, key=found.get) and child[0] == 1
    at = np.zeros(70, int)
    while (feature[at] >= 0).any():
        at = np.where(feature[at] >= 0, child[at] + (bins[:, 0] > cut[at]), at)
    means = [np.average(labels[bins[:, 0] == b], weights=weight[bins[:, 0] == b]) for b in bins[:, 0]]
    assert value[at] == pytest.approx(np.array(means))
    assert gains.sum() == pytest.approx(spread(np.full(70, True)) - sum(spread(bins[:, 0] == b) for b in np.unique(bins)))
    shallow = forest.grow(0, 1, bins, labels, weight, 2, 5)
    assert len(shallow[0]) <= 7 and (forest.grow(0, 1, bins, labels * 0, weight, 30, 5)[0] == -1).all()


def test_draws():
    """Weights are Poisson and independent over trees; subsets are uniform; the first of equal features is split."""
    keys = np.arange(20_000)
    weight = np.array([forest._weights(keys, t, 42) for t in range(8)], float)
    assert weight.mean(axis=1) == pytest.approx(np.ones(8), abs=0.04) and weight.var(axis=1) == pytest.approx(np.ones(8), abs=0.06)
    assert np.abs(np.corrcoef(weight) - np.eye(8)).max() < 0.04
    roots = np.concatenate([forest._subsets(t, np.array([1]), 42, 19) for t in range(4000)])
    nodes = forest._subsets(3, np.arange(1, 4001), 42, 19)
    for drawn in (roots, nodes):
        assert drawn.shape == (4000, 5) and (np.diff(drawn, axis=1) > 0).all()
        assert np.bincount(drawn.ravel(), minlength=19) == pytest.approx(np.full(19, 4000 * 5 / 19), rel=0.12)
    bins = np.tile(np.arange(40, dtype=np.uint8)[:, None], (1, 4))
    feature = forest.grow(0, 1, bins, np.arange(40.0) ** 2, np.ones(40, np.uint8), 1, 9)[0]
    assert feature[0] == forest._subsets(0, np.array([1]), 9, 4)[0].min()


def test_cuts(spark):
    """Few values: every middle; many: quantiles. Values on a cut lie to its right."""
    rows = spark.createDataFrame([(i, 0.0, [float(i % 4), float(i), 7.0]) for i in range(2000)],
                                 "key long, label double, values array<double>")
    cuts = forest.fit_cuts(rows, 3, 16)
    assert cuts[0] == [0.5, 1.5, 2.5] and len(cuts[1]) == 15 and cuts[2] == []
    assert np.diff(cuts[1]) == pytest.approx(125, abs=2)
    bins = {r["key"]: list(r["bins"]) for r in forest.binned(rows, cuts).collect()}
    assert bins[6] == [2, 0, 0] and bins[1999] == [3, 15, 0]


def test_odd_rows(spark, tmp_path):
    rows, _, _ = _rows(spark, 30)
    with pytest.raises(ValueError):
        forest.fit_trees(rows.limit(0), 6, 3, 30, 256, 1)
    with pytest.raises(ValueError):
        forest.fit_trees(rows.withColumn("label", F.when(F.col("key") != 4, F.col("label"))), 6, 3, 30, 256, 1)
    flat = forest.fit_trees(rows.withColumn("label", F.lit(5.0)), 6, 8, 30, 256, 1, part_rows=4)
    assert set(_answers(flat, rows).values()) == {5.0} and forest.importances(flat) == [0.0] * 6
    same = rows.withColumn("values", F.array(*[F.lit(1.0)] * 6))
    stuck = forest.fit_trees(same, 6, 8, 30, 256, 1, part_rows=4)
    assert len(set(_answers(stuck, same).values())) == 1 and not stuck.top and stuck.parts.count() == 8
    assert forest.fit_trees(rows, 6, 8, 0, 256, 1).parts.filter(F.size("feature") > 1).isEmpty()
    deep = forest.fit_trees(rows, 6, 8, 30, 300, 1, part_rows=10)
    forest.save_trees(deep, str(tmp_path / "t"), spark)
    again = forest.load_trees(str(tmp_path / "t"), spark)
    assert again.cuts == deep.cuts and sorted(again.top) == sorted(deep.top)
    assert _answers(again, rows) == _answers(deep, rows)


def test_scored_rows_are_dealt_out(spark, monkeypatch):
    rows, _, _ = _rows(spark, 400)
    model = forest.fit_trees(rows, 6, 5, 30, 256, 42, part_rows=100)
    once = _answers(model, rows)
    monkeypatch.setattr(forest, "SCORED_ROWS", 50)
    monkeypatch.setattr(forest, "CHUNK_ROWS", 90)
    assert _answers(model, rows) == pytest.approx(once) and len(once) == 400


def test_full_forest_of_many_rows_ends_in_time(spark):
    """6000 rows and 10 trees of full depth did not end in 140 s with one pass per batch of nodes."""
    rows, _, _ = _rows(spark, 6000, features=19)
    rows = rows.withColumn("label", F.rand(5) * 1000).localCheckpoint()
    began = time.time()
    model = forest.fit_trees(rows, 19, 10, 30, 256, 42)
    assert model.parts.select(F.sum(F.size("feature"))).first()[0] > 40_000
    assert time.time() - began < 60
