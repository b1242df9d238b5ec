"""Closed forms, ranking and medians against numpy and the standard library."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from voidscope.functions.geometry import with_principal_axes
from voidscope.functions.ranking import exact_medians, number_rows, smallest_flag
from voidscope.functions.spread import attach, last_chunk
from voidscope.operators.evaluation import normal_quantile

ENTRIES = ("xx", "yy", "zz", "xy", "xz", "yz")


def _matrices():
    rng = np.random.default_rng(3)
    out = []
    for _ in range(60):
        m = rng.normal(size=(3, 3))
        out.append(m @ m.T)
    out += [np.diag(d) for d in ([1, 1, 1], [2, 2, 1], [2, 1, 1], [0, 0, 0], [3, 2, 0], [5, 0, 0])]
    rotation, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    out += [rotation @ np.diag(d) @ rotation.T for d in ([4, 4, 1], [4, 1, 1], [1e6, 1, 1e-3], [7, 0, 0])]
    return out


def test_principal_axes(spark):
    matrices = _matrices()
    rows = [(i, *[float(m[j]) for j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))])
            for i, m in enumerate(matrices)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in ENTRIES))
    for row in with_principal_axes(df, ENTRIES).collect():
        m = matrices[row["id"]]
        scale = max(1.0, np.abs(m).max())
        wanted = np.sort(np.linalg.eigvalsh(m))[::-1]
        got = np.array([row["l1"], row["l2"], row["l3"]])
        assert np.allclose(got, wanted, atol=1e-7 * scale), (row["id"], got, wanted)
        axes = np.array([[row[f"r{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)])
        assert np.allclose(axes @ axes.T, np.eye(3), atol=1e-6)
        assert np.allclose(m @ axes.T, axes.T * got, atol=2e-6 * scale)
        for axis in axes:
            assert axis[np.abs(axis).argmax()] > 0


def test_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.01, 0.074, 0.076, 0.3, 0.5, 0.7, 0.925, 0.9999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("q"))
    for row in df.collect():
        assert row["q"] == pytest.approx(NormalDist().inv_cdf(row["p"]), rel=1e-12, abs=1e-15)


def test_number_rows_spreads_one_hot_key(spark):
    rng = np.random.default_rng(5)
    keys = np.where(rng.random(4000) < 0.7, 1, rng.integers(2, 9, 4000))
    rows = [(int(k), int(v), i) for i, (k, v) in enumerate(zip(keys, rng.integers(0, 50, 4000)))]
    df = spark.createDataFrame(rows, "k long, v long, i long").repartition(8)
    got = {r["i"]: r["n"] for r in number_rows(df, ["k"], ["v", "i"], "n").collect()}
    seen = {}
    for k, v, i in sorted(rows):
        assert got[i] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1


@pytest.mark.parametrize("wanted", [0, 1, 7, 499, 500, 900])
def test_smallest_flag_is_exact(spark, wanted):
    df = spark.range(500).withColumn("h", F.md5(F.col("id").cast("string")))
    flagged = smallest_flag(df, F.col("h"), ["id"], wanted, "low")
    hits = {r["id"] for r in flagged.filter("low").collect()}
    order = [r["id"] for r in df.orderBy("h").collect()]
    assert hits == set(order[:wanted])


def test_exact_medians(spark):
    rng = np.random.default_rng(8)
    columns = {
        "normal": rng.normal(size=1001), "even": rng.exponential(size=1000),
        "hot": np.r_[np.full(700, 2.5), rng.normal(size=301)], "two": np.array([1.0, 2.0]),
        "four": np.array([1.0, 2.0, 3.0, 10.0]), "same": np.full(9, -4.0),
        "wide": np.r_[1e300, -1e300, 1e-300, 5.0, 6.0],
    }
    n = max(map(len, columns.values()))
    rows = [tuple(float(c[i]) if i < len(c) else (None if i % 2 else float("nan")) for c in columns.values())
            for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    got = exact_medians(df, list(columns), bins=16)
    for name, values in columns.items():
        assert got[name] == pytest.approx(float(np.median(values)), rel=1e-12)
    assert exact_medians(df.filter("1 = 0"), ["normal"]) == {}


def test_attach_covers_every_chunk(spark):
    base = spark.range(6).select(F.lit(1).cast("long").alias("snapshot_id"), (F.col("id") * 700_000).alias("atom_id"))
    totals = base.groupBy("snapshot_id").agg(F.count("*").alias("n"), last_chunk())
    joined = attach(base, totals)
    assert totals.first()["last_chunk"] == 3
    assert joined.count() == 6 and joined.filter("n = 6").count() == 6


def test_medians_of_an_infinite_column_are_refused(spark):
    import pytest

    from voidscope.functions.ranking import exact_medians

    rows = spark.createDataFrame([(1.0, float("inf")), (2.0, 3.0), (5.0, 4.0)], "fine double, wild double")
    with pytest.raises(ValueError, match="wild"):
        exact_medians(rows, ["fine", "wild"])
    assert exact_medians(rows, ["fine"]) == {"fine": 2.0}
