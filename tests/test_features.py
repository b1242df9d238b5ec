"""Feature rows against a direct numpy calculation, edge clouds and invariants."""

import numpy as np
import pytest

from tests.helpers import A0, points
from voidscope.operators import bandwidth
from voidscope.operators.alignment import align, box_sizes
from voidscope.operators.catalog import FAMILIES, FEATURES, feature_catalog
from voidscope.plans.features import snapshot_features


def pca(cloud):
    centered = cloud - cloud.mean(axis=0)
    if len(cloud) < 3:
        return centered
    _, vectors = np.linalg.eigh(np.cov(centered.T))
    axes = vectors.T[::-1]
    axes = axes * np.sign(axes[np.arange(3), np.abs(axes).argmax(axis=1)])[:, None]
    return centered @ axes.T


def expected(cloud, mode):
    n = len(cloud)
    small = n < 3
    aligned = pca(cloud) / (1.0 if small and mode == "training" else A0)
    extent = (aligned.max(axis=0) - aligned.min(axis=0)).max()
    if mode == "training":
        box = 1.0 if small else extent
    else:
        box = 2.0 if small else max(1.5, min(1.5 * extent, 10.0))
    out = {"num_points": n}
    grid = np.zeros((10, 10, 10))
    if box > 0:
        index = np.floor((aligned + box / 2) / (box / 10)).astype(int)
        for i, j, k in index[((index >= 0) & (index < 10)).all(axis=1)]:
            grid[i, j, k] = 1
    occ = grid.sum()
    out["occupancy_total"], out["occupancy_fraction"] = occ, occ / 1000
    for axis in "xyz":
        out[f"occupancy_{axis}_mean"] = occ / 100
    steps = [np.abs(np.diff(grid, axis=a)).sum() for a in range(3)]
    for axis, step in zip("xyz", steps):
        out[f"occupancy_gradient_{axis}"] = step
    out["occupancy_gradient_total"] = out["occupancy_surface"] = sum(steps)
    out["grid_entropy"] = -np.log(1 / occ + 1e-12) if occ else 0.0

    def inertia(p):
        p = p - p.mean(axis=0)
        return np.sort(np.linalg.eigvalsh((p * p).sum() * np.eye(3) - p.T @ p))[::-1]

    moi = inertia(np.argwhere(grid == 1).astype(float)) if occ else np.zeros(3)
    for i in range(3):
        out[f"grid_moi_{i + 1}"] = moi[i]
    out["moi_principal_3"] = inertia(cloud)[2] if n >= 3 else None
    d = np.linalg.norm(cloud - cloud.mean(axis=0), axis=1)
    out["rdf_mean"] = d.mean() if n >= 2 else None
    if n < 2:
        out["rdf_kurtosis"] = None
    elif d.std() < 1e-6:
        out["rdf_kurtosis"] = 0.0
    else:
        out["rdf_kurtosis"] = ((d - d.mean()) ** 4).mean() / d.var() ** 2 - 3
    used = aligned if mode == "training" else cloud
    if n >= 2:
        counts = np.histogramdd(used, bins=10)[0].ravel()
        p = counts[counts > 0] / n
        out["entropy_spatial"] = -(p * np.log(p)).sum()
    else:
        out["entropy_spatial"] = None
    if n >= 10:
        gaps = np.sort(np.linalg.norm(used[:, None] - used[None], axis=2), axis=1)
        bw = gaps[:, max(1, int(0.2 * n)) - 1].mean()
        out["ms_bandwidth"] = bw if bw > 0 else 2 * gaps[:, 1].mean()
    else:
        out["ms_bandwidth"] = None
    return out


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(21)
    return {
        1: rng.normal(size=(1, 3)), 2: rng.normal(size=(2, 3)), 3: rng.normal(size=(3, 3)) * [5, 2, 1],
        9: rng.normal(size=(9, 3)) * [5, 2, 1], 10: rng.normal(size=(10, 3)) * [1, 4, 2],
        120: rng.random((120, 3)) * [30, 20, 11], 400: rng.normal(size=(400, 3)) * [9, 4, 2] + 100,
        7: np.c_[np.arange(12.0) ** 1.5, np.zeros(12), np.zeros(12)] @ np.array(
            [[0.6, 0.8, 0], [-0.8, 0.6, 0], [0, 0, 1]]),
    }


@pytest.mark.parametrize("mode", ["training", "extractor"])
def test_rows(spark, clouds, mode):
    got = {r["snapshot_id"]: r.asDict() for r in snapshot_features(points(spark, clouds), mode).collect()}
    assert got.keys() == clouds.keys()
    for s, cloud in clouds.items():
        wanted = expected(cloud, mode)
        degenerate = s in (2, 3, 7)  # rounding decides the cells of flat directions
        for name in [*FEATURES, "num_points"]:
            if degenerate and (name in FAMILIES["grid"] or (mode == "training" and name == "entropy_spatial")):
                continue
            if wanted[name] is None:
                assert got[s][name] is None, (s, name)
            else:
                assert got[s][name] == pytest.approx(wanted[name], rel=1e-7, abs=1e-7), (s, name)


def test_coincident_cloud(spark):
    same = {1: np.full((12, 3), 2.5), 2: np.r_[np.zeros((30, 3)), [[3.0, 4.0, 0.0]]]}
    rows = {r["snapshot_id"]: r for r in snapshot_features(points(spark, same), "extractor").collect()}
    assert rows[1]["moi_principal_3"] == pytest.approx(0) and rows[1]["rdf_kurtosis"] == 0
    assert rows[1]["ms_bandwidth"] == 0 and rows[1]["entropy_spatial"] == pytest.approx(0, abs=1e-12)
    assert rows[1]["occupancy_total"] == 1
    assert rows[2]["ms_bandwidth"] == pytest.approx(
        expected(same[2], "extractor")["ms_bandwidth"])


def test_training_box_of_coincident_cloud_is_empty(spark):
    row = snapshot_features(points(spark, {1: np.full((5, 3), 1.0)}), "training").first()
    assert row["occupancy_total"] == 0 and row["grid_entropy"] == 0 and row["grid_moi_1"] == 0


def test_identities_and_rotation(spark, clouds):
    rng = np.random.default_rng(2)
    rotation, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    cloud = clouds[400]
    moved = {0: cloud, 1: cloud @ rotation.T + [7, -3, 2]}
    a, b = snapshot_features(points(spark, moved)).orderBy("snapshot_id").collect()
    for name in ("moi_principal_3", "rdf_mean", "rdf_kurtosis", "ms_bandwidth"):
        assert a[name] == pytest.approx(b[name], rel=1e-9)
    for row in (a, b):
        assert row["occupancy_x_mean"] == row["occupancy_y_mean"] == row["occupancy_z_mean"] \
            == pytest.approx(row["occupancy_total"] / 100)
        assert row["occupancy_surface"] == row["occupancy_gradient_total"]


def test_families(spark, clouds):
    table = points(spark, {120: clouds[120]})
    whole = snapshot_features(table).first()
    for family, names in FAMILIES.items():
        row = snapshot_features(table, families=(family,)).first()
        for name in FEATURES:
            assert row[name] == (pytest.approx(whole[name]) if name in names else None)
    with pytest.raises(ValueError):
        snapshot_features(table, families=("hull",))
    with pytest.raises(ValueError):
        snapshot_features(table, mode="other")


def test_sampling_is_repeatable_and_capped(spark):
    rng = np.random.default_rng(4)
    table = points(spark, {0: rng.random((1500, 3)), 1: rng.random((40, 3))})
    sizes = {r["snapshot_id"]: r["count"] for r in bandwidth.sample_points(table).groupBy("snapshot_id").count().collect()}
    assert sizes == {0: 500, 1: 40}
    first = {tuple(r) for r in bandwidth.sample_points(table).collect()}
    assert first == {tuple(r) for r in bandwidth.sample_points(table.repartition(7)).collect()}


def test_large_snapshots_are_thinned_exactly(spark, monkeypatch):
    rng = np.random.default_rng(4)
    table = points(spark, {0: rng.random((3000, 3)), 1: rng.random((900, 3)), 2: rng.random((70, 3))})
    # snapshot 3 has ids whose keys are all large, so thinning leaves it short
    key = lambda i: (i % 2**32) * bandwidth.SCRAMBLE % 2**32
    high = [i for i in range(9000) if key(i) > 2**32 * 0.7][:1000]
    table = table.unionByName(spark.createDataFrame([(3, i, 0.0, 1.0, 2.0) for i in high], table.schema))
    wanted = {tuple(r) for r in bandwidth.sample_points(table, 20).collect()}
    monkeypatch.setattr(bandwidth, "LARGE", 800)
    assert {tuple(r) for r in bandwidth.sample_points(table, 20).collect()} == wanted
    assert len(wanted) == 80


def test_knn_rank(spark):
    table = points(spark, {0: [[float(i), 0, 0] for i in range(6)]})
    got = {r["atom_id"]: r["kth_distance"] for r in bandwidth.knn_distance(table, k=2).collect()}
    assert got == {i: 1.0 for i in range(6)}
    assert all(r["kth_distance"] is None for r in bandwidth.knn_distance(table, k=7).collect())


def test_align_and_box(spark, clouds):
    table = points(spark, {400: clouds[400], 2: clouds[2]})
    got = align(table).orderBy("snapshot_id", "atom_id").collect()
    tail = np.array([[r["pc1"], r["pc2"], r["pc3"]] for r in got if r["snapshot_id"] == 400])
    assert np.allclose(tail, pca(clouds[400]) / A0, atol=1e-9)
    sizes = {r["snapshot_id"]: r["box_size"] for r in box_sizes(table, mode="extractor").collect()}
    assert sizes[2] == 2.0 and 1.5 <= sizes[400] <= 10.0


def test_catalog(spark):
    rows = feature_catalog(spark).orderBy("ordinal").collect()
    assert [r["feature"] for r in rows] == [*FEATURES, "n_vacancies"]
    assert len(FEATURES) == 19 and feature_catalog(spark, include_target=False).count() == 19
