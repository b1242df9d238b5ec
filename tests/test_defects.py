"""Wigner-Seitz counts and surface selection on generated lattices."""

import numpy as np
import pytest

import voidscope.operators.surface as surface
from tests.helpers import A0, boxes, fcc, points, ref_box, sites
from voidscope.operators.wigner_seitz import WignerSeitz, strain

CELLS = 4
EDGE = (CELLS * A0,) * 3


def _without(lattice, gone):
    return np.delete(lattice, gone, axis=0)


@pytest.fixture(scope="module")
def defects(spark):
    """0 perfect and shaken, 1 three atoms missing, 2 two extra, 3 two missing and one extra."""
    rng = np.random.default_rng(1)
    lattice = fcc(CELLS)
    shake = lambda a: a + rng.normal(size=a.shape) * 0.05
    extra = lattice[[5, 90]] + [0.3, 0.2, -0.1]
    return {
        0: shake(lattice),
        1: shake(_without(lattice, [3, 77, 200])),
        2: np.concatenate([shake(lattice), extra]),
        3: np.concatenate([shake(_without(lattice, [10, 11])), extra[:1]]),
    }


@pytest.fixture(scope="module")
def analysis(spark, defects):
    return WignerSeitz(points(spark, defects), sites(spark, fcc(CELLS)),
                       boxes(spark, {s: EDGE for s in defects}), ref_box(EDGE))


def test_summary(analysis, defects):
    rows = {r["snapshot_id"]: r for r in analysis.summary().collect()}
    counts = {s: (r["n_vacancies"], r["n_interstitials"]) for s, r in rows.items()}
    assert counts == {0: (0, 0), 1: (3, 0), 2: (0, 2), 3: (2, 1)}
    for s, r in rows.items():
        assert r["n_reference_sites"] == 4 * CELLS**3 and r["n_defective_atoms"] == len(defects[s])
        assert r["n_vacancies"] - r["n_interstitials"] == r["n_reference_sites"] - r["n_defective_atoms"]
        assert r["vacancy_concentration"] == pytest.approx(r["n_vacancies"] / r["n_reference_sites"])
        assert r["volumetric_strain"] == pytest.approx(0)


def test_listed_defects(analysis, defects):
    vacant = {(r["snapshot_id"], r["site_id"]) for r in analysis.vacancies().collect()}
    assert vacant == {(1, 3), (1, 77), (1, 200), (3, 10), (3, 11)}
    surplus = {(r["snapshot_id"], r["atom_id"]): r["site_id"] for r in analysis.interstitials().collect()}
    assert surplus == {(2, 256): 5, (2, 257): 90, (3, 254): 5}
    occupancy = analysis.occupancy().groupBy("snapshot_id").agg({"occupancy": "sum", "site_id": "count"}).collect()
    assert {r["snapshot_id"]: r["sum(occupancy)"] for r in occupancy} == {s: len(c) for s, c in defects.items()}
    assert all(r["count(site_id)"] == 256 for r in occupancy)


def test_vacant_blocks_cross_block_borders(spark):
    lattice = np.array([[float(i), 0, 0] for i in range(9000)])
    filled = [0, 4095, 4096, 8999]
    found = WignerSeitz(points(spark, {0: lattice[filled]}), sites(spark, lattice), periodic=False)
    vacant = {r["site_id"] for r in found.vacant_sites().collect()}
    assert vacant == set(range(9000)) - set(filled)
    assert found.summary().first()["volumetric_strain"] is None


@pytest.mark.parametrize("affine", [True, False])
def test_strained_crystal(spark, affine):
    factor = np.array([1.08, 1.08, 1.08])
    edge = tuple(np.array(EDGE) * factor)
    found = WignerSeitz(points(spark, {0: fcc(CELLS) * factor}), sites(spark, fcc(CELLS)),
                        boxes(spark, {0: edge}), ref_box(EDGE), affine=affine)
    row = found.summary().first()
    if affine:
        assert (row["n_vacancies"], row["n_interstitials"]) == (0, 0)
    assert row["volumetric_strain"] == pytest.approx(1.08**3 - 1)


def test_every_snapshot_has_a_row(spark):
    """Snapshots without atoms or without a box, and a reference of sites per snapshot."""
    lattice = fcc(2)
    edge = (2 * A0,) * 3
    table = points(spark, {0: lattice, 1: lattice[1:], 2: lattice})
    box = boxes(spark, {0: edge, 1: edge, 3: edge})
    found = WignerSeitz(table, sites(spark, lattice), box, ref_box(edge))
    rows = {r.snapshot_id: (r.status, r.n_vacancies, r.n_interstitials, r.n_defective_atoms, r.vacancy_concentration)
            for r in found.reported().collect()}
    assert rows == {0: ("ok", 0, 0, 32, 0.0), 1: ("ok", 1, 0, 31, 1 / 32), 2: ("no box", None, None, None, None),
                    3: ("no atoms", 32, 0, 0, 1.0)}
    assert found.summary().count() == 4 and "status" not in found.summary().columns
    open_ = WignerSeitz(table, sites(spark, lattice), periodic=False).reported()
    assert {r.status for r in open_.collect()} == {"ok"} and open_.count() == 3
    with pytest.raises(ValueError, match="one set of sites"):
        WignerSeitz(table, sites(spark, lattice).selectExpr("0L as snapshot_id", "*"), box, ref_box(edge))


def test_strain_table(spark):
    rows = strain(boxes(spark, {1: (2.0, 3.0, 4.0)}, low=-1.0), ref_box((1.0, 3.0, 4.0))).collect()
    assert rows[0]["volume"] == pytest.approx(24) and rows[0]["volumetric_strain"] == pytest.approx(1.0)


def _surface(spark, clouds, periodic=True, radius=2.0):
    rows = surface.surface_atoms(
        points(spark, clouds), radius, boxes(spark, {s: EDGE for s in clouds}) if periodic else None).collect()
    return {s: {r["atom_id"] for r in rows if r["snapshot_id"] == s} for s in clouds}


def _vacancy_clouds():
    lattice = fcc(CELLS)
    return {0: lattice, 1: _without(lattice, [100]), 2: _without(lattice, [10, 200])}


def test_surface_around_vacancies(spark):
    found = _surface(spark, _vacancy_clouds())
    assert {s: len(a) for s, a in found.items()} == {0: 0, 1: 12, 2: 24}
    lattice = _without(fcc(CELLS), [100])
    gap = lattice - fcc(CELLS)[100]
    near = np.linalg.norm(gap - EDGE[0] * np.round(gap / EDGE[0]), axis=1) < A0 * 0.75
    assert found[1] == set(np.flatnonzero(near))


@pytest.mark.parametrize("periodic", [True, False])
def test_surface_on_demand_agrees(spark, monkeypatch, periodic):
    clouds = {1: _vacancy_clouds()[1]}
    listed = _surface(spark, clouds, periodic)
    monkeypatch.setattr(surface, "CROWDED", 30)
    assert _surface(spark, clouds, periodic) == listed


def test_dense_clump(spark, monkeypatch):
    rng = np.random.default_rng(6)
    cloud = np.concatenate([rng.random((40, 3)) * 8, 4 + rng.random((60, 3)) * 0.4, np.full((9, 3), 4.2)])
    listed = _surface(spark, {0: cloud}, periodic=False)
    monkeypatch.setattr(surface, "CROWDED", 10)
    assert _surface(spark, {0: cloud}, periodic=False) == listed
    assert len({a in listed[0] for a in range(100, 109)}) == 1  # coincident atoms share the answer


def test_surface_brute_force(spark):
    """An atom with any sampled free direction is exposed; one far inside every sample is not."""
    rng = np.random.default_rng(9)
    cloud = rng.random((300, 3)) * 7
    found = _surface(spark, {0: cloud}, periodic=False, radius=1.5)[0]
    directions = rng.normal(size=(4000, 3))
    directions /= np.linalg.norm(directions, axis=1)[:, None]
    for i, p in enumerate(cloud):
        gaps = np.linalg.norm((p + 1.5 * directions)[:, None] - np.delete(cloud, i, axis=0)[None], axis=2).min(axis=1)
        if (gaps >= 1.5).any():
            assert i in found
        elif gaps.max() < 1.4:
            assert i not in found


def test_within_surface(spark):
    lattice = fcc(CELLS)
    cloud = _without(lattice, [100])
    table, box = points(spark, {0: cloud}), boxes(spark, {0: EDGE})
    shell = surface.surface_atoms(table, 2.0, box).collect()
    at = cloud[[r["atom_id"] for r in shell]]
    gap = cloud[:, None] - at[None]
    gap = np.linalg.norm(gap - EDGE[0] * np.round(gap / EDGE[0]), axis=2).min(axis=1)
    got = {r["atom_id"]: r["surface_distance"] for r in surface.within_surface(table, 2.6, 2.0, box).collect()}
    assert got.keys() == set(np.flatnonzero(gap < 2.6))
    assert all(got[i] == pytest.approx(gap[i], abs=1e-9) for i in got)
    assert surface.keep_selected(table, surface.surface_atoms(table, 2.0, box)).count() == 12


def test_surface_atoms_are_not_matched_with_themselves(spark, monkeypatch):
    """Their distance is 0, so only the other atoms go through the nearest join."""
    rng = np.random.default_rng(5)
    cloud = rng.random((250, 3)) * 6
    asked = []
    nearest = surface.nearest
    monkeypatch.setattr(surface, "nearest", lambda q, *a: asked.append(q.count()) or nearest(q, *a))
    table = points(spark, {0: cloud})
    exposed = {r["atom_id"] for r in surface.surface_atoms(table, 1.2).collect()}
    rows = {r["atom_id"]: r["surface_distance"] for r in surface.within_surface(table, 1.0, 1.2).collect()}
    gaps = np.linalg.norm(cloud[:, None] - cloud[sorted(exposed)][None], axis=2).min(axis=1)
    assert rows.keys() == set(np.flatnonzero(gaps < 1.0)) and 0 < len(exposed) < 250
    assert all(abs(rows[i] - gaps[i]) < 1e-12 for i in rows) and asked == [250 - len(exposed)]


def test_small_snapshots_are_judged_in_one_task(spark, monkeypatch):
    """Without neighbor lists, and as with them: images, repeated and missing keys, coordinates that are no numbers."""
    rng = np.random.default_rng(21)
    rows = [(s, i, *p) for s, n in ((1, 150), (2, 300), (3, 1)) for i, p in enumerate(rng.uniform(0, 9, (n, 3)).tolist())]
    rows += [(1, 3, 4.5, 4.5, 4.5), (1, 4, *rows[4][2:]), (2, 7, None, 1.0, 1.0), (2, 8, float("nan"), 1.0, 1.0),
             (2, 9, float("inf"), 1.0, 1.0), (2, 900, 1e300, 0.0, 0.0), (2, None, 4.0, 4.0, 4.0), (None, 5, 4.0, 4.0, 4.0)]
    cloud = spark.createDataFrame(rows, "snapshot_id long, atom_id long, x double, y double, z double")
    box = boxes(spark, {1: (9.0,) * 3, 2: (9.0,) * 3})

    def selected(where):
        return sorted(map(str, surface.surface_atoms(cloud, 2.0, where).collect()))

    listed = surface._listed
    monkeypatch.setattr(surface, "WHOLE", -1)
    expected = [selected(None), selected(box)]
    assert 0 < len(expected[1]) < len(expected[0]) < len(rows)

    def refuse(*_):
        raise AssertionError("neighbor lists were built")

    monkeypatch.setattr(surface, "WHOLE", 1 << 14)
    monkeypatch.setattr(surface, "_listed", refuse)
    for chunk in (1 << 13, 40):
        monkeypatch.setattr(surface, "_CHUNK", chunk)
        assert [selected(None), selected(box)] == expected
    monkeypatch.setattr(surface, "_listed", listed)
    monkeypatch.setattr(surface, "WHOLE", 200)  # one snapshot from lists, the others in tasks
    assert [selected(None), selected(box)] == expected


def test_exposure_of_many_atoms_agrees_with_all_crossings():
    """Lattices whose holes are just touched or just closed, flat and dense clouds; few centers are looked at together."""
    rng = np.random.default_rng(8)
    grid = np.stack(np.meshgrid(*[np.arange(5.0)] * 3), axis=-1).reshape(-1, 3)
    hole = 3**0.5 / 2
    clouds = [(grid, r) for r in (1.0, hole, hole - 1e-6, hole + 1e-6)]
    clouds += [(fcc(3), 1.9), (fcc(3), 2.1), (rng.random((150, 3)) * 6, 1.5), (rng.random((150, 3)) * [6, 6, 0], 1.0),
               (np.concatenate([rng.random((80, 3)) * 6, 3 + rng.random((60, 3)) * 0.3]), 1.5)]
    for cloud, radius in clouds:
        centers, uncovered, offsets = surface._geometry(radius)
        near, expected = [], []
        for p in cloud:
            around = offsets(*(cloud - p).T)
            around = around[(around**2).sum(axis=1) < 4 * radius**2]
            near.append(around)
            expected.append(len(around) == 0 or len(uncovered(centers(around), around)) > 0)
        sizes = np.array([len(n) for n in near])
        listed = np.flatnonzero(sizes)
        got = surface._exposure(radius)(np.concatenate([near[i] for i in listed]).T, np.cumsum(sizes[listed]) - sizes[listed])
        assert (got == np.array(expected)[listed]).all()


def test_exposed_atoms_are_proved_by_few_centers(monkeypatch):
    """Most exposed atoms need one direction, and covered ones the crossings of a few neighbors, not of all."""
    rng = np.random.default_rng(4)
    cloud = rng.random((400, 3)) * 8
    crossings = []
    pairs = np.triu_indices
    monkeypatch.setattr(surface.np, "triu_indices", lambda n, k: crossings.append(n) or pairs(n, k))
    kept = surface._uncovered_rows(
        np.zeros(400, int), np.arange(400), cloud, np.full(400, surface.QUERY + surface.OTHER), 5.0, surface._exposure(2.5))
    assert 0 < kept.sum() < 400 and 0 < max(crossings) < 30


def test_small_snapshots_are_dealt_to_all_cores(spark):
    """A table of few bytes may be much work, so its tasks are not merged."""
    rng = np.random.default_rng(2)
    clouds = {s: rng.random((20, 3)) * 4 for s in range(40)}
    exposed = surface.surface_atoms(points(spark, clouds), 1.0)
    assert exposed.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
