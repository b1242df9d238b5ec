"""Per-axis periodicity and explicit images."""

import itertools

import numpy as np
import pytest

import voidscope.operators.neighbors as nb
import voidscope.operators.surface as surface
from tests.helpers import A0, boxes, fcc, points
from voidscope.operators.images import folded, radius_pairs_images, with_flags

FLAG_ROWS = "snapshot_id long, px boolean, py boolean, pz boolean"


def flagged(spark, edges, flags):
    """edges and flags by snapshot; flags like ``ppf``."""
    rows = [(s, *[f == "p" for f in flags[s]]) for s in edges]
    return boxes(spark, edges).join(spark.createDataFrame(rows, FLAG_ROWS), "snapshot_id")


def brute_pairs(cloud, edge, flags, radius):
    edge = np.array(edge, float)
    repeats = np.array([f == "p" for f in flags])
    home = np.where(repeats, cloud - edge / 2 - edge * np.round((cloud - edge / 2) / edge), cloud)
    reach = [range(-4, 5) if p else [0] for p in repeats]
    out = set()
    for shift in itertools.product(*reach):
        moved = home + np.array(shift) * edge
        gap = np.linalg.norm(moved[None] - home[:, None], axis=2)
        for i, j in zip(*np.nonzero(gap < radius)):
            if i < j or (i == j and shift > (0, 0, 0)):
                out.add((int(i), int(j), *shift, round(float(gap[i, j]), 9)))
    return out


@pytest.mark.parametrize("flags", ["ppp", "ppf", "fpf", "fff"])
def test_pairs_in_small_boxes(spark, flags):
    rng = np.random.default_rng(3)
    edge = (2.0, 3.0, 5.0)
    cloud = rng.random((25, 3)) * 6 - 1
    found = radius_pairs_images(points(spark, {0: cloud}), 2.6, flagged(spark, {0: edge}, {0: flags})).collect()
    got = {(r.atom_id, r.other_id, r.ix, r.iy, r.iz, round(r.distance, 9)) for r in found}
    assert len(got) == len(found) and got == brute_pairs(cloud, edge, flags, 2.6)


def test_both_directions_and_missing_box(spark):
    clouds = {0: [[0.1, 0, 0], [0.9, 0, 0]], 1: [[0, 0, 0], [0.9, 0, 0]]}
    table, box = points(spark, clouds), boxes(spark, {0: (1.0, 9.0, 9.0)})
    rows = radius_pairs_images(table, 0.95, box, both=True).collect()
    assert {(r.snapshot_id, r.atom_id, r.other_id, r.ix) for r in rows} == {
        (0, 0, 1, -1), (0, 0, 1, 0), (0, 1, 0, 1), (0, 1, 0, 0), (1, 0, 1, 0), (1, 1, 0, 0)}
    assert radius_pairs_images(table, 0.95, None).count() == 2
    assert folded(table, box).filter("lx is null").count() == 2


def test_flags_from_boundary_words(spark):
    rows = spark.createDataFrame([(0, ["pp", "ff", "s"]), (1, ["p", "pp"]), (2, None)], "snapshot_id long, boundary array<string>")
    got = {r.snapshot_id: (r.px, r.py, r.pz) for r in with_flags(rows).collect()}
    assert got == {0: (True, False, False), 1: (True, True, False), 2: (False, False, False)}


def _surface(spark, cloud, edge, flags, radius=2.0):
    found = surface.surface_atoms(points(spark, {0: cloud}), radius, flagged(spark, {0: edge}, {0: flags})).collect()
    return {r.atom_id for r in found}


def test_slab_wire_and_crystal(spark):
    lattice = fcc(4)
    edge = (4 * A0,) * 3
    slab = _surface(spark, lattice, edge, "ppf")
    z = lattice[:, 2]
    assert slab == set(np.flatnonzero((z == z.min()) | (z == z.max()))) and len(slab) == 64
    assert _surface(spark, lattice, edge, "ppp") == set()
    wire, free = _surface(spark, lattice, edge, "pff"), _surface(spark, lattice, edge, "fff")
    assert slab < wire < free


@pytest.mark.parametrize("cells", [1, 2])
def test_small_crystals_have_no_surface(spark, cells):
    edge = (cells * A0,) * 3
    assert _surface(spark, fcc(cells), edge, "ppp") == set()
    top = _surface(spark, fcc(cells), edge, "ppf")
    z = fcc(cells)[:, 2]
    assert top == set(np.flatnonzero((z == z.min()) | (z == z.max())))


def test_crowded_slab_agrees(spark, monkeypatch):
    lattice = np.delete(fcc(3), [20], axis=0)
    listed = _surface(spark, lattice, (3 * A0,) * 3, "ppf")
    monkeypatch.setattr(surface, "CROWDED", 30)
    assert _surface(spark, lattice, (3 * A0,) * 3, "ppf") == listed


def test_distance_through_the_box_edge(spark):
    cloud = np.array([[0.2, 1, 1], [3.9, 1, 1], [2.0, 1, 1]])
    box = flagged(spark, {0: (4.0, 50.0, 50.0)}, {0: "pff"})
    rows = surface.within_surface(points(spark, {0: cloud}), 2.5, 0.1, box).collect()
    assert {r.atom_id: round(r.surface_distance, 9) for r in rows} == {0: 0.0, 1: 0.0, 2: 0.0}


def test_crowded_cell_is_dealt_to_many_tasks(spark, monkeypatch):
    """2000 points in one cell: every lot of the join stays below the limit on both sides, and no pair is lost."""
    rng = np.random.default_rng(4)
    cloud = np.concatenate([rng.random((2000, 3)) * 0.5, rng.random((200, 3)) * 20])
    table = points(spark, {0: cloud})
    plain = {tuple(r) for r in nb.radius_pairs(table, 0.2).select("atom_id", "other_id").collect()}
    monkeypatch.setattr(nb, "CELL_ROWS", 100)
    lots = []
    join = type(table).join

    def watched(self, other, on=None, how=None):
        if isinstance(on, list) and "_own_lot" in on:
            for side in (self, other):
                lots.append(side.groupBy(*on).count().agg({"count": "max"}).first()[0])
        return join(self, other, on, how)

    monkeypatch.setattr(type(table), "join", watched)
    dealt = [tuple(r) for r in nb.radius_pairs(table, 0.2).select("atom_id", "other_id").collect()]
    assert len(dealt) == len(set(dealt)) and set(dealt) == plain
    assert lots and max(lots) <= 200
    gap = np.linalg.norm(cloud[:, None] - cloud[None], axis=2)
    assert plain == {(i, j) for i, j in zip(*np.nonzero(gap < 0.2)) if i < j}


def test_pairs_in_tilted_cells(spark):
    rng = np.random.default_rng(12)
    edge, tilt = np.array([3.0, 4.0, 5.0]), {"xy": 1.3, "xz": -0.7, "yz": 2.9}
    cell = np.array([[3.0, 0, 0], [1.3, 4.0, 0], [-0.7, 2.9, 5.0]])
    cloud = rng.random((20, 3)) * 9 - 2
    for flags in ("ppp", "ppf", "pfp", "fff"):
        box = flagged(spark, {0: tuple(edge)}, {0: flags}).selectExpr("*", *[f"{v}D as {k}" for k, v in tilt.items()])
        found = radius_pairs_images(points(spark, {0: cloud}), 2.4, box, both=True).collect()
        got = sorted((r.atom_id, r.other_id, round(r.distance, 7)) for r in found)
        wanted = []
        for shift in itertools.product(*[range(-6, 7) if f == "p" else [0] for f in flags]):
            gap = np.linalg.norm(cloud[None] + np.array(shift) @ cell - cloud[:, None], axis=2)
            wanted += [(int(i), int(j), round(float(gap[i, j]), 7)) for i, j in zip(*np.nonzero(gap < 2.4)) if i != j or any(shift)]
        assert got == sorted(wanted)


def test_tilted_crystal(spark):
    """A crystal sheared by one lattice step across the box is the same crystal."""
    lattice, edge = fcc(3), (3 * A0,) * 3
    for flags, count in (("ppp", 0), ("ppf", 36)):
        box = flagged(spark, {0: edge}, {0: flags}).selectExpr("*", f"{A0}D as xy", f"{A0}D as xz", f"{-A0}D as yz")
        assert surface.surface_atoms(points(spark, {0: lattice}), 2.0, box).count() == count
        wrong = box.selectExpr("snapshot_id", "xlo", "xhi", "ylo", "yhi", "zlo", "zhi", "px", "py", "pz", "1.7D as xy")
        assert surface.surface_atoms(points(spark, {0: lattice}), 2.0, wrong).count() >= count
