"""Dump scan, quarantine and dataset files."""

import pytest

from checks import fixtures
from tests.helpers import POINTS
from voidscope.operators.catalog import FEATURES
from voidscope.operators.dataset import feature_dataset
from voidscope.sources import dumps
from voidscope.sources.datasets import (
    feature_schema,
    read_features_csv,
    read_points,
    write_features,
    write_points,
)
from voidscope.sources.dumps import failed_files, run_summary, scan_dumps

HEAD = """ITEM: TIMESTEP
0
ITEM: NUMBER OF ATOMS
{n}
ITEM: BOX BOUNDS pp pp pp
0.0 10.0
-5 5 0.1
1e0 2.5e1
ITEM: ATOMS {columns}
"""


def dump(columns, rows):
    return HEAD.format(n=len(rows), columns=columns) + "".join(r + "\n" for r in rows)


GOOD = dump("id type x y z vx", ["1 1 0.5 1.5 2.5 9", "", "  2 1 1e-3 -2 3 8  ", "\t", "3 2 7 8 9 7"])

FILES = {
    "good.dump": GOOD,
    "many.dump": dump("id a b c d e f g h x y z", ["1 2 3 4 5 6 7 8 9 .1 .2 .3"]),
    "noz.dump": dump("id x y", ["1 0 0"]),
    "empty.dump": "",
    "nosection.dump": "ITEM: TIMESTEP\n5\nhello\n",
    "word.dump": dump("id x y z", ["1 0 0 0", "2 0 zero 0"]),
    "short.dump": dump("id x y z", ["1 0 0 0", "2 0"]),
    "noatoms.dump": dump("id x y z", []),
    "frames.dump": dump("id x y z", ["1 1 2 3", "2 4 5 6"]) + dump("id x y z", ["1 7 7 7"]),
    "tail.dump": dump("id x y z", ["1 1 2 3"]) + "ITEM: EXTRA\n4 4 4 4\n",
    "skip_surface_normalized.dump": GOOD,
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("dumps")
    for name, text in FILES.items():
        (path / name).write_text(text)
    return str(path)


@pytest.fixture(scope="module")
def scan(spark, folder):
    return scan_dumps(spark, folder)


def test_status(scan):
    status = {r["file"]: r["status"] for r in scan.status.collect()}
    assert status == {
        "good.dump": "ok", "many.dump": "ok", "noz.dump": "missing x, y or z", "empty.dump": "no atoms section",
        "nosection.dump": "no atoms section", "word.dump": "bad value", "short.dump": "bad value",
        "noatoms.dump": "ok", "frames.dump": "ok", "tail.dump": "ok"}
    assert {r["status"]: r["files"] for r in run_summary(scan.status).collect()} == {
        "ok": 5, "missing x, y or z": 1, "no atoms section": 2, "bad value": 2}
    assert [r["file"] for r in failed_files(scan.status, 3).collect()] == [
        "empty.dump", "nosection.dump", "noz.dump"]
    assert {r["snapshot_id"]: r["num_atoms"] for r in scan.snapshots().collect()} == {
        "good.dump": 3, "many.dump": 1, "noatoms.dump": 0, "frames.dump": 2, "tail.dump": 1}


def test_atoms(scan):
    rows = {}
    for r in scan.atoms().orderBy("snapshot_id", "atom_id").collect():
        rows.setdefault(r["snapshot_id"], []).append((r["atom_id"], r["x"], r["y"], r["z"]))
    assert rows == {
        "good.dump": [(0, 0.5, 1.5, 2.5), (1, 1e-3, -2.0, 3.0), (2, 7.0, 8.0, 9.0)],
        "many.dump": [(0, 0.1, 0.2, 0.3)],
        "frames.dump": [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)],
        "tail.dump": [(0, 1.0, 2.0, 3.0)]}
    extra = {r["snapshot_id"]: r["extra"] for r in scan.atoms().filter("atom_id = 0").collect()}
    assert extra["good.dump"] == {"id": 1.0, "type": 1.0, "vx": 9.0}
    assert extra["many.dump"] == dict(zip("id a b c d e f".split(), map(float, range(1, 8))))


def test_boxes(scan):
    rows = {r["snapshot_id"]: r for r in scan.boxes().collect()}
    good = rows["good.dump"]
    assert (good["xlo"], good["xhi"], good["ylo"], good["yhi"], good["zlo"], good["zhi"]) == (0, 10, -5, 5, 1, 25)
    assert good["declared_atoms"] == 5 and good["boundary"] == ["pp", "pp", "pp"]
    assert "empty.dump" not in rows and rows["frames.dump"]["declared_atoms"] == 2


def test_boxed_atoms(spark, tmp_path):
    texts = {
        "xu": dump("id type xu yu zu", ["1 1 1 2 3", "2 1 4"]),
        "xs": dump("id type xs ys zs", ["1 1 0.5 0.25 0.5"]),
        "named": dump("id q w a b", ["9 9 1 2 3"]),
        "both": dump("id x y z xu yu zu", ["1 1 2 3 4 5 6"]),
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {r["snapshot_id"]: (r["x"], r["y"], r["z"]) for r in scan_dumps(spark, str(tmp_path)).boxed_atoms().collect()}
    assert got == {"xu": (1, 2, 3), "xs": (5.0, -2.5, 13.0), "named": (1, 2, 3), "both": (1, 2, 3)}


def test_equal_names_in_several_folders(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"run{i}").mkdir()
        (tmp_path / f"run{i}" / "dump.0").write_text(dump("id x y z", [f"{n + 1} {i} {n} 0" for n in range(i + 1)]))
    scan = scan_dumps(spark, f"{tmp_path}/*/dump.*")
    assert {r["file"]: (r["status"], r["num_atoms"]) for r in scan.status.collect()} == {
        f"run{i}/dump.0": ("ok", i + 1) for i in range(3)}
    assert sorted((r["snapshot_id"], r["atom_id"], r["x"], r["y"]) for r in scan.atoms().collect()) == [
        (f"run{i}/dump.0", n, float(i), float(n)) for i in range(3) for n in range(i + 1)]
    assert scan.boxes().count() == scan.boxed_status.filter("status = 'ok'").count() == 3
    with pytest.raises(ValueError, match="dump.0"):
        scan_dumps(spark, f"{tmp_path}/*/dump.*", name_pattern=r"([^/]+)$").status.count()


def test_text_is_neither_shuffled_nor_copied(spark, folder):
    scan = scan_dumps(spark, folder)
    plan = scan._placed()._jdf.queryExecution().executedPlan().toString()
    text = next(line for line in plan.splitlines() if "FileScan text" in line)
    above = plan[:plan.index(text)].splitlines()
    depth = len(text) - len(text.lstrip(" :+-"))
    parents = []
    for line in reversed(above):
        at = len(line) - len(line.lstrip(" :+-"))
        if at < depth:
            parents.append(line)
            depth = at
    assert parents and not any("Exchange" in p or "Window" in p or "Sort" in p for p in parents)


def test_boxed_status(spark, tmp_path):
    head = "ITEM: NUMBER OF ATOMS\n2\n"
    bounds = "ITEM: BOX BOUNDS pp pp pp\n0 1\n0 1\n0 1\n"
    texts = {
        "fine": head + bounds + "ITEM: ATOMS id x y z\n1 .1 .2 .3\n2 .4 .5 .6\n3 beyond the count\n",
        "unboxed": head + "ITEM: ATOMS id x y z\n1 .1 .2 .3\n2 .4 .5 .6\n",
        "two_bounds": head + "ITEM: BOX BOUNDS pp pp pp\n0 1\n0 1\nITEM: ATOMS id x y z\n1 0 0 0\n2 0 0 0\n",
        "word": head + bounds + "ITEM: ATOMS id x y z\n1 .1 oops .3\n2 .4 .5 .6\n",
        "short": head + bounds + "ITEM: ATOMS id x y z\n1 .1 .2 .3\n2 .4\n",
        "flat": head + bounds + "ITEM: ATOMS id x y\n1 .1 .2\n2 .3 .4\n",
        "none": head + bounds,
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    scan = scan_dumps(spark, str(tmp_path))
    assert {r["file"]: (r["status"], r["num_atoms"]) for r in scan.boxed_status.collect()} == {
        "fine": ("ok", 2), "unboxed": ("no box bounds", 0), "two_bounds": ("no box bounds", 0), "word": ("bad value", 2),
        "short": ("fewer rows than declared", 1), "flat": ("missing x, y or z", 2), "none": ("no atoms section", 0)}
    assert sorted((r["snapshot_id"], r["atom_id"]) for r in scan.boxed_atoms().collect()) == [("fine", 0), ("fine", 1), ("short", 0)]


def test_file_split_over_many_blocks(spark, tmp_path):
    rows = [f"{i + 1} {i}.25 {-i} {i * 2}" for i in range(4000)]
    blanks = [r if i % 97 else r + "\n" for i, r in enumerate(rows)]
    (tmp_path / "big.dump").write_text(dump("id x y z", blanks) + dump("id x y z", rows[:50]))
    (tmp_path / "small one+%.dump").write_text(GOOD)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scan = scan_dumps(spark, str(tmp_path))
        assert scan._blocks.count() > 10
        got = scan.atoms().filter("snapshot_id = 'big.dump'").orderBy("atom_id").collect()
        counted = {r["snapshot_id"]: r["num_atoms"] for r in scan.snapshots().collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert counted == {"big.dump": 4000, "small one+%.dump": 3}
    assert [(r["atom_id"], r["x"], r["y"], r["z"]) for r in got] == [
        (i, i + 0.25, float(-i), float(i * 2)) for i in range(4000)]


def test_feature_files(spark, tmp_path):
    features = spark.createDataFrame([("a", 1.0, float("nan"), 4.0), ("b", None, 2.5, 5.0)],
                                     "snapshot_id string, rdf_mean double, grid_moi_1 double, n_vacancies double")
    table = feature_dataset(features)
    assert table.columns == ["file", *FEATURES, "n_vacancies"]
    path = str(tmp_path / "csv")
    write_features(table, path, "csv")
    for schema in (None, feature_schema()):
        rows = {r["file"]: r for r in read_features_csv(spark, path, schema).collect()}
        assert rows["a"]["rdf_mean"] == 1.0 and rows["a"]["grid_moi_1"] is None
        assert rows["b"]["rdf_mean"] is None and rows["b"]["n_vacancies"] == 5.0
    write_features(table.drop("n_vacancies"), path, "csv")
    with pytest.raises(ValueError):
        read_features_csv(spark, path)
    parquet = str(tmp_path / "parquet")
    write_features(table, parquet)
    assert spark.read.parquet(parquet).count() == 2


def test_point_files(spark, tmp_path):
    table = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0)], POINTS)
    write_points(table, str(tmp_path / "p"))
    assert read_points(spark, str(tmp_path / "p")).collect() == table.collect()


@pytest.mark.parametrize("block", [None, 512])
def test_every_frame(spark, tmp_path, block):
    """Frames of one file, some empty, over many file blocks and chunks of lines."""
    counts = [3, 0, 1500, 1, 40, 0, 7]
    text = "".join(dump("id x y z", [f"{i + 1} {f}.5 {i} 0" + ("\n" if i % 11 == 3 else "") for i in range(n)])
                   for f, n in enumerate(counts))
    (tmp_path / "run.dump").write_text(text + "ITEM: TIMESTEP\n9\nITEM: NUMBER OF ATOMS\n4\n")
    (tmp_path / "bad.dump").write_text(dump("id x y z", ["1 0 0 0"]) + dump("id x y", ["1 0 0"]) + dump("id x y z", ["1 a 0 0"]))
    (tmp_path / "none.dump").write_text("hello\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        scan = scan_dumps(spark, str(tmp_path), first_frame=False)
        status = {r.file: (r.status, r.num_atoms) for r in scan.status.collect()}
        rows = {}
        for r in scan.atoms().orderBy("snapshot_id", "atom_id").collect():
            rows.setdefault(r.snapshot_id, []).append((r.atom_id, r.x, r.y))
        boxed = {r.file: r.status for r in scan.boxed_status.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert status == {
        **{f"run.dump#{f}": ("ok", n) for f, n in enumerate(counts)}, "run.dump#7": ("no atoms section", 0),
        "bad.dump#0": ("ok", 1), "bad.dump#1": ("missing x, y or z", 1), "bad.dump#2": ("bad value", 1),
        "none.dump#0": ("no atoms section", 0)}
    assert rows == {**{f"run.dump#{f}": [(i, f + 0.5, float(i)) for i in range(n)] for f, n in enumerate(counts) if n},
                    "bad.dump#0": [(0, 0.0, 0.0)]}
    # heads declare five rows more or less than written ones, with blank lines counted in
    assert boxed["run.dump#0"] == "ok" and boxed["run.dump#7"] == "no atoms section"


def test_tilted_boxes_are_named(spark, tmp_path):
    tilted = "ITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS xy xz yz pp pp pp\n0 1 .1\n0 1 0\n0 1 0\nITEM: ATOMS id x y z\n1 0 0 0\n"
    (tmp_path / "tilted").write_text(tilted)
    (tmp_path / "straight").write_text(tilted.replace("xy xz yz ", ""))
    scan = scan_dumps(spark, str(tmp_path))
    assert {r.file: r.status for r in scan.boxed_status.collect()} == {"tilted": "tilted box", "straight": "ok"}
    assert [r.snapshot_id for r in scan.boxed_atoms().collect()] == ["straight"]
    assert [r.snapshot_id for r in scan.boxes().collect()] == ["straight"] and scan.atoms().count() == 2
    cells = {r.snapshot_id: (r.xlo, round(r.xhi, 9), r.xy, r.xz, r.yz, r.boundary) for r in scan.cells().collect()}
    assert cells == {"tilted": (0.0, 0.9, 0.1, 0.0, 0.0, ["pp"] * 3), "straight": (0.0, 1.0, 0.0, 0.0, 0.0, ["pp"] * 3)}


def test_ordered_files(spark, tmp_path):
    rows = [(f"s{i * 37 % 100:02d}", float(i)) for i in range(100)]
    table = feature_dataset(spark.createDataFrame(rows, "snapshot_id string, n_vacancies double")).repartition(5)
    write_features(table, str(tmp_path / "csv"), "csv", ordered=True)
    read = []
    for part in sorted((tmp_path / "csv").glob("part-*.csv")):
        lines = part.read_text().splitlines()
        read += [line.split(",")[0] for line in lines[1:]]
    assert read == sorted(r[0] for r in rows)


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"run={i}").mkdir()
        (tmp_path / f"run={i}" / "dump.0").write_text(GOOD)
    before = spark.conf.get(dumps.LISTING)
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    try:
        scan = dumps.scan_dumps(spark, str(tmp_path))
        assert len(scan._text.inputFiles()) == 100
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= dumps.LISTING_WAVES * context.defaultParallelism < 100
    assert spark.conf.get(dumps.LISTING) == before


def test_text_of_the_dump_folders(spark, tmp_path):
    rows = [(s, p, i, f"line {i}") for s in (1, 2, None) for p in (0, 1) for i in range(5)] + [(3, 0, 0, "größer"), (3, 0, 1, None)]
    lines = spark.createDataFrame(rows, "snapshot_id long, piece long, place long, value string")
    lines = lines.repartition(2, "snapshot_id", "piece").sortWithinPartitions("snapshot_id", "piece", "place").drop("place")
    fixtures._write_folders(lines, ["snapshot_id", "piece"], f"{tmp_path}/ours")
    lines.write.partitionBy("snapshot_id", "piece").text(f"{tmp_path}/theirs")
    found = {}
    for name in ("ours", "theirs"):
        files = list((tmp_path / name).glob("*/*/*.txt"))
        found[name] = {(f.parent.parent.name, f.parent.name): f.read_text() for f in files}
        assert len(files) == len(found[name]) == 7
    assert found["ours"] == found["theirs"]
