"""Dump folder to dataset, model and comparison."""

import numpy as np
import pytest

from tests.helpers import A0, fcc
from voidscope.operators.catalog import FEATURES
from voidscope.plans import model
from voidscope.plans.workflows import compare_methods, extract_dataset, geometric_vacancies
from voidscope.sources.dumps import scan_dumps

CELLS = 3
EDGE = CELLS * A0


def write(path, cloud, flags="pp pp pp"):
    lines = ["ITEM: TIMESTEP", "0", "ITEM: NUMBER OF ATOMS", str(len(cloud)), f"ITEM: BOX BOUNDS {flags}"]
    lines += [f"0.0 {EDGE}"] * 3 + ["ITEM: ATOMS id type x y z"]
    lines += [f"{i + 1} 1 " + " ".join(repr(float(v)) for v in p) for i, p in enumerate(cloud)]
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(5)
    path = tmp_path_factory.mktemp("run")
    lattice = fcc(CELLS)
    gone = {"a.dump": [4], "b.dump": [7, 50], "c.dump": [1, 30, 60], "perfect.dump": []}
    for name, out in gone.items():
        cloud = np.delete(lattice, out, axis=0)
        write(path / name, cloud + rng.normal(size=cloud.shape) * 0.01)
    write(path / "free.dump", lattice, "ff ff ff")
    (path / "broken.dump").write_text("nothing here\n")
    reference = tmp_path_factory.mktemp("ref")
    write(reference / "ref.dump", lattice)
    return str(path), str(reference), {k: len(v) for k, v in gone.items()}


def test_extract(spark, folder):
    path, _, gone = folder
    dataset, status = extract_dataset(scan_dumps(spark, path), mode="extractor", total_atoms=4 * CELLS**3)
    rows = {r["file"]: r for r in dataset.collect()}
    assert rows.keys() == {"a.dump", "b.dump", "c.dump", "free.dump"}
    assert dataset.columns == ["file", *FEATURES, "n_vacancies"]
    assert {f: rows[f]["n_vacancies"] for f in ("a.dump", "b.dump", "c.dump")} == {
        f: float(gone[f]) for f in ("a.dump", "b.dump", "c.dump")}
    assert rows["free.dump"]["occupancy_total"] > 0
    assert {r["file"]: r["status"] for r in status.collect()} == {
        "a.dump": "ok", "b.dump": "ok", "c.dump": "ok", "free.dump": "ok", "perfect.dump": "no surface atoms",
        "broken.dump": "no atoms section"}


def test_extract_by_distance(spark, folder):
    path, _, _ = folder
    scan = scan_dumps(spark, path + "/a.dump")
    near, _ = extract_dataset(scan, surface_distance=0.5)
    wide, _ = extract_dataset(scan, surface_distance=A0)
    assert near.first()["num_points"] == 12
    assert 12 < wide.first()["num_points"] <= 4 * CELLS**3 - 1


def test_geometric_counts(spark, folder):
    path, reference, gone = folder
    found = geometric_vacancies(scan_dumps(spark, path), scan_dumps(spark, reference))
    rows = {r["snapshot_id"]: r["n_vacancies"] for r in found.summary().collect()}
    assert rows == {**gone, "free.dump": 0}


def test_compare(spark, folder):
    path, reference, gone = folder
    rng = np.random.default_rng(0)
    rows = [(f"t{i}", *map(float, rng.random(len(FEATURES))), float(i % 5)) for i in range(40)]
    schema = "file string, " + ", ".join(f"{f} double" for f in FEATURES) + ", n_vacancies double"
    forest, _ = model.train(spark.createDataFrame(rows, schema), num_trees=5, mode="extractor")
    table = {r["snapshot_id"]: r for r in compare_methods(spark, path, reference, forest).collect()}
    assert table.keys() == {*gone, "free.dump", "broken.dump"}
    broken = table["broken.dump"]
    assert broken["ml_vacancies"] is broken["ws_vacancies"] is broken["verdict"] is None
    assert broken["ml_status"] != "ok" and broken["ws_status"] != "ok"
    for name, count in gone.items():
        assert table[name]["ws_vacancies"] == count
        assert table[name]["difference"] == pytest.approx(table[name]["ml_vacancies"] - count)
        assert table[name]["verdict"] in ("excellent", "good", "significant difference")
