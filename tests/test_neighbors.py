"""Radius and nearest joins against all-pairs numpy, on friendly and hostile layouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import voidscope.operators.neighbors as nb
from tests.helpers import boxes, brute_nearest, image, points, ref_box, sites


def _check(found, clouds, lattice, length=None):
    got = {(r["snapshot_id"], r["atom_id"]): (r["site_id"], r["distance"]) for r in found.collect()}
    assert len(got) == sum(len(c) for c in clouds.values())
    for s, cloud in clouds.items():
        best, gap = brute_nearest(cloud, lattice[s] if isinstance(lattice, dict) else lattice,
                                  None if length is None else np.array(length[s]))
        for i in range(len(cloud)):
            assert got[s, i][1] == pytest.approx(gap[i], abs=1e-12)
            if got[s, i][0] != best[i]:  # only sites at the same distance up to rounding may swap
                other = lattice[s] if isinstance(lattice, dict) else lattice
                reach = np.linalg.norm(image(other[got[s, i][0]] - cloud[i],
                                             None if length is None else np.array(length[s])))
                assert reach == pytest.approx(gap[i], abs=1e-12)


@pytest.fixture()
def rng():
    return np.random.default_rng(11)


@pytest.mark.parametrize("few", [500_000, 0])
def test_open_random(spark, rng, monkeypatch, few):
    monkeypatch.setattr(nb, "broadcast_bytes", lambda spark: few * nb.SITE_BYTES)
    lattice = rng.random((200, 3)) * [10, 4, 30]
    clouds = {1: rng.random((150, 3)) * [10, 4, 30], 2: rng.normal(size=(50, 3)) * 20}
    _check(nb.nearest_site(points(spark, clouds), sites(spark, lattice), periodic=False), clouds, lattice)


def test_far_away_points_use_the_tree(spark, rng):
    lattice = rng.random((300, 3))
    clouds = {0: rng.normal(size=(60, 3)) * 1e4 + 5e4}
    _check(nb.nearest_site(points(spark, clouds), sites(spark, lattice), periodic=False), clouds, lattice)


def test_crowded_cell_uses_the_tree(spark, rng, monkeypatch):
    monkeypatch.setattr(nb, "CROWDED", 8)
    lattice = np.concatenate([rng.random((100, 3)) * 50, 25 + rng.random((200, 3)) * 1e-3])
    clouds = {0: np.concatenate([rng.random((80, 3)) * 50, 25 + rng.random((80, 3)) * 1e-3])}
    _check(nb.nearest_site(points(spark, clouds), sites(spark, lattice), periodic=False), clouds, lattice)


def test_crowded_periodic(spark, rng, monkeypatch):
    monkeypatch.setattr(nb, "CROWDED", 8)
    monkeypatch.setattr(nb, "LEAF", 4)
    lattice = np.concatenate([rng.random((40, 3)) * 10, 9.99 + rng.random((100, 3)) * 1e-2])
    clouds = {0: rng.random((100, 3)) * 10, 3: rng.random((20, 3)) * 0.01}
    edges = {0: (10.0, 10.0, 10.0), 3: (10.0, 11.0, 12.0)}
    found = nb.nearest_site(points(spark, clouds), sites(spark, lattice), boxes(spark, edges), ref_box((10.0,) * 3))
    centered = {s: c - np.array(edges[s]) / 2 for s, c in clouds.items()}
    centered = {s: image(c, np.array(edges[s])) for s, c in centered.items()}
    _check(found, centered, image(lattice - 5, 10.0), edges)


@pytest.mark.parametrize("count,few", [(1, 9999), (2, 0), (5, 9999), (60, 0)])
def test_small_periodic_boxes(spark, rng, monkeypatch, count, few):
    monkeypatch.setattr(nb, "broadcast_bytes", lambda spark: few * nb.SITE_BYTES)
    lattice = rng.random((count, 3)) * [3, 1, 2]
    clouds = {0: rng.random((70, 3)) * 6 - 1, 1: rng.random((30, 3)) * 3}
    edges = {0: (3.0, 1.0, 2.0), 1: (3.3, 0.9, 2.0)}
    found = nb.nearest_site(points(spark, clouds), sites(spark, lattice), boxes(spark, edges), ref_box((3.0, 1.0, 2.0)))
    wrapped = {s: image(c - np.array(edges[s]) / 2, np.array(edges[s])) for s, c in clouds.items()}
    _check(found, wrapped, image(lattice - np.array([1.5, 0.5, 1.0]), np.array([3.0, 1.0, 2.0])), edges)


def test_affine(spark, rng):
    lattice = rng.random((120, 3)) * [5, 6, 7]
    edges = {0: (6.0, 6.0, 6.0), 1: (5.0, 6.0, 7.0)}
    clouds = {s: rng.random((60, 3)) * edge for s, edge in edges.items()}
    found = nb.nearest_site(points(spark, clouds), sites(spark, lattice), boxes(spark, edges),
                            ref_box((5.0, 6.0, 7.0)), affine=True)
    wrapped = {s: image(c - np.array(edges[s]) / 2, np.array(edges[s])) for s, c in clouds.items()}
    base = image(lattice - np.array([2.5, 3.0, 3.5]), np.array([5.0, 6.0, 7.0]))
    _check(found, wrapped, {s: base * (np.array(e) / [5, 6, 7]) for s, e in edges.items()}, edges)


def test_sites_per_snapshot(spark, rng):
    lattice = {0: rng.random((50, 3)), 1: rng.random((70, 3)) * 9}
    clouds = {0: rng.random((40, 3)), 1: rng.random((40, 3)) * 12}
    table = points(spark, lattice).withColumnRenamed("atom_id", "site_id")
    _check(nb.nearest_site(points(spark, clouds), table, periodic=False), clouds, lattice)


def test_tie_takes_lowest_site(spark):
    lattice = np.array([[2.0, 0, 0], [0.0, 0, 0], [1.0, 1, 0], [1.0, -1, 0], [0.0, 0, 0]])
    found = nb.nearest_site(points(spark, {0: [[1, 0, 0], [0, 0, 0]]}), sites(spark, lattice), periodic=False)
    assert [r["site_id"] for r in found.orderBy("atom_id").collect()] == [0, 1]


def test_coincident_sites_and_points(spark, monkeypatch):
    monkeypatch.setattr(nb, "CROWDED", 4)
    lattice = np.concatenate([np.zeros((40, 3)), np.ones((3, 3))])
    clouds = {0: np.concatenate([np.zeros((30, 3)), np.full((5, 3), 0.9)])}
    found = nb.nearest_site(points(spark, clouds), sites(spark, lattice), periodic=False)
    assert [r["site_id"] for r in found.orderBy("atom_id").collect()] == [0] * 30 + [40] * 5


def test_no_sites(spark):
    with pytest.raises(ValueError):
        nb.nearest_site(points(spark, {0: [[0, 0, 0]]}), sites(spark, [[0, 0, 0]]).limit(0), periodic=False)


@pytest.mark.parametrize("radius,edge", [(0.3, None), (0.3, (1.0, 2.0, 1.5)), (0.9, (1.0, 2.0, 1.5))])
def test_radius_pairs(spark, rng, radius, edge):
    cloud = rng.random((120, 3)) * (edge or (1.0, 2.0, 1.5))
    periodic = None if edge is None else boxes(spark, {0: edge})
    got = {(r["atom_id"], r["other_id"]): r["distance"]
           for r in nb.radius_pairs(points(spark, {0: cloud}), radius, periodic).collect()}
    length = None if edge is None else np.array(edge)
    wanted = {}
    for i in range(len(cloud)):
        for j in range(i + 1, len(cloud)):
            gap = np.linalg.norm(image(cloud[j] - cloud[i], length))
            if gap < radius:
                wanted[i, j] = gap
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(wanted[k], abs=1e-12) for k in got)


def test_nearest_other(spark, rng):
    cloud = np.concatenate([rng.random((60, 3)), np.zeros((4, 3)), [[50, 50, 50], [50, 50, 50.5]]])
    got = {r["atom_id"]: (r["distance"], r["copies"]) for r in nb.nearest_other(points(spark, {0: cloud})).collect()}
    assert sum(c for _, c in got.values()) == len(cloud)
    for i, (distance, copies) in got.items():
        gaps = np.linalg.norm(cloud - cloud[i], axis=1)
        gaps[i] = np.inf
        assert distance == pytest.approx(gaps.min(), abs=1e-12)
        assert copies == (np.abs(cloud - cloud[i]).max(axis=1) == 0).sum()


def test_nearest_other_crowded(spark, rng, monkeypatch):
    monkeypatch.setattr(nb, "CROWDED", 4)
    monkeypatch.setattr(nb, "LEAF", 2)
    test_nearest_other(spark, rng)


@pytest.mark.parametrize("affine", [False, True])
def test_far_points_of_a_small_reference_are_matched_where_they_are_read(spark, rng, monkeypatch, affine):
    """Boxes much wider than the reference: no join and no tree, same answers; a repeated point has one."""
    monkeypatch.setattr(nb, "_tree_descent", lambda *a: pytest.fail("the tree was used"))
    lattice = rng.random((200, 3)) * [5, 6, 7]
    edges = {0: (40.0, 60.0, 50.0), 1: (5.5, 6.0, 7.0)}
    clouds = {s: rng.random((80, 3)) * edge for s, edge in edges.items()}
    table = points(spark, clouds)
    found = nb.nearest_site(table.unionByName(table.filter("atom_id < 9")), sites(spark, lattice), boxes(spark, edges),
                            ref_box((5.0, 6.0, 7.0)), affine=affine)
    assert found.count() == 160
    wrapped = {s: image(c - np.array(edges[s]) / 2, np.array(edges[s])) for s, c in clouds.items()}
    base = image(lattice - np.array([2.5, 3.0, 3.5]), np.array([5.0, 6.0, 7.0]))
    stretch = {s: np.array(e) / [5, 6, 7] if affine else 1.0 for s, e in edges.items()}
    _check(found, wrapped, {s: base * stretch[s] for s in edges}, edges)


def test_search_of_places_without_a_number(spark):
    """A place that is not a number has the lowest site and no distance."""
    lattice = np.array([[1.0, 1, 1], [2.0, 2, 2], [1.0, 1, 1]])
    rows = [(0, 0, 900.0, 0.0, 0.0), (0, 1, float("nan"), 0.0, 0.0)]
    table = spark.createDataFrame(rows, "snapshot_id long, atom_id long, x double, y double, z double")
    found = {r["atom_id"]: r for r in nb.nearest_site(table, sites(spark, lattice), periodic=False).collect()}
    assert set(found) == {0, 1} and found[0]["site_id"] == 1
    assert found[1]["site_id"] == 0 and np.isnan(found[1]["distance"])


def test_points_without_a_coordinate_in_a_box(spark, rng):
    """A point that lacks a coordinate has a site without a distance in a periodic box, one that is no number has none."""
    lattice = rng.random((50, 3)) * 4
    rows = [(0, 0, 1.0, 1.0, 1.0), (0, 1, float("nan"), 1.0, 1.0), (0, 2, None, 1.0, 1.0), (0, 3, 30.0, 30.0, 30.0)]
    table = spark.createDataFrame(rows, "snapshot_id long, atom_id long, x double, y double, z double")
    found = {r["atom_id"]: r for r in nb.nearest_site(
        table, sites(spark, lattice), boxes(spark, {0: (60.0,) * 3}), ref_box((4.0,) * 3)).collect()}
    assert set(found) == {0, 2, 3} and found[2]["distance"] is None and found[3]["distance"] is not None


def test_own_sites_of_small_snapshots_are_matched_in_one_task(spark, rng, monkeypatch):
    """Without joins on cells, and as with them: ties, repeated keys, missing sites, values that are no numbers."""
    asked = [(s, i, *p) for s, n in ((1, 200), (2, 40), (3, 5), (4, 30)) for i, p in enumerate((rng.random((n, 3)) * 9).tolist())]
    asked += [(1, 7, 50.0, 50.0, 50.0), (2, 3, 0.5, 0.5, 0.5), (None, 1, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0, 1.0),
              (5, 0, float("nan"), 1.0, 1.0), (5, 1, 2.0, 1.0, 1.0), (6, 0, float("inf"), 0.0, 0.0), (6, 2, 1.0, 0.0, 0.0)]
    offered = [(s, 3 * i + 1, *p) for s, n in ((1, 150), (2, 20), (3, 1), (5, 9), (6, 4)) for i, p in enumerate((rng.random((n, 3)) * 9).tolist())]
    offered += [(1, 0, *offered[5][2:]), (1, 999, *offered[6][2:]), (2, 2, 1.0, 1.0, 1.0), (2, 0, 1.0, 1.0, 1.0)]
    queries = spark.createDataFrame(asked, "snapshot_id long, atom_id long, x double, y double, z double")
    sites = spark.createDataFrame(offered, "snapshot_id long, site_id long, x double, y double, z double")
    shifted = sites.withColumn("site_id", F.struct(F.col("site_id").alias("atom_id"), F.lit(0).alias("ix")))
    own = nb.Setting(["snapshot_id"], periodic=False, stretched=False)

    def matched():
        rows = nb.nearest(queries, shifted, own).collect()
        return sorted((r.snapshot_id, r.atom_id, r.site_id.atom_id, str(r.d2)) for r in rows)

    monkeypatch.setattr(nb, "TASK_ROWS", -1)
    expected = matched()
    monkeypatch.setattr(nb, "TASK_ROWS", 100)  # one snapshot by joins, the others in tasks
    monkeypatch.setattr(nb, "_CHUNK", 30)
    assert matched() == expected
    monkeypatch.setattr(nb, "_nearest_joined", lambda *a: pytest.fail("the joins were used"))
    monkeypatch.setattr(nb, "TASK_ROWS", 1 << 14)
    numbers = nb.nearest(queries.filter("snapshot_id < 5"), sites, own).collect()
    assert len(numbers) == 200 + 40 + 5
    assert sorted((r.snapshot_id, r.atom_id, r.site_id, str(r.d2)) for r in numbers) == [r for r in expected if r[0] < 5]
