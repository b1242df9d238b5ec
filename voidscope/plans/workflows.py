"""Whole runs: dump folder to feature dataset, and learned against geometric vacancy counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voidscope.functions.ranking import number_rows
from voidscope.operators.alignment import DEFAULT_A0
from voidscope.operators.catalog import FAMILIES
from voidscope.operators.dataset import TOTAL_ATOMS, feature_dataset, vacancy_target
from voidscope.operators.evaluation import method_comparison
from voidscope.operators.images import FLAGS, TILTS, with_flags
from voidscope.operators.surface import PROBE_RADIUS, keep_selected, surface_atoms, within_surface
from voidscope.operators.wigner_seitz import WignerSeitz
from voidscope.plans.features import snapshot_features
from voidscope.plans.model import Forest, score
from voidscope.session import stage
from voidscope.sources.dumps import OK, DumpScan, scan_dumps

NO_SURFACE = "no surface atoms"
BOX = ["snapshot_id", *[f"{a}{end}" for a in "xyz" for end in ("lo", "hi")]]


def select_surface(
    points: DataFrame,
    boxes: DataFrame,
    probe_radius: float = PROBE_RADIUS,
    surface_distance: float | None = None,
    periodic: bool | None = None,
) -> DataFrame:
    """Points on the surface, or nearer to it than ``surface_distance``.

    ``periodic=None`` follows the boundary flags of each snapshot, axis by axis; True and False hold for all axes.
    """
    cell = [*BOX, *[t for t in TILTS if t in boxes.columns]]
    sized = None if periodic is False else boxes.select(*cell) if periodic else with_flags(boxes).select(*cell, *FLAGS)
    if surface_distance is None:
        return keep_selected(points, surface_atoms(points, probe_radius, sized))
    return keep_selected(points, within_surface(points, surface_distance, probe_radius, sized))


def extract_dataset(
    scan: DumpScan,
    mode: str = "training",
    a0: float = DEFAULT_A0,
    probe_radius: float = PROBE_RADIUS,
    surface_distance: float | None = None,
    total_atoms: int = TOTAL_ATOMS,
    families: tuple[str, ...] = tuple(FAMILIES),
    periodic: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Feature rows of the surface clouds of all good dumps, and the status of every file.

    ``extractor`` mode adds the count-based target; ``training`` mode adds ``num_points``.
    """
    points = stage(scan.atoms().select("snapshot_id", "atom_id", "x", "y", "z"), "points")
    surface = stage(select_surface(points, scan.cells(), probe_radius, surface_distance, periodic), "surface")
    features = snapshot_features(surface, mode, a0, families)
    if mode == "extractor":
        dataset = feature_dataset(features.drop("num_points"), vacancy_target(points, total_atoms))
    else:
        dataset = feature_dataset(features)
    kept = surface.select(F.col("snapshot_id").alias("file")).distinct().withColumn("_kept", F.lit(True))
    status = scan.status.join(kept, "file", "left").select(
        "file", F.when((F.col("status") == OK) & F.col("_kept").isNull(), NO_SURFACE)
        .otherwise(F.col("status")).alias("status"))
    return dataset, status


def predict_vacancies(points: DataFrame, forest: Forest, a0: float = DEFAULT_A0) -> DataFrame:
    """Predicted vacancy count per snapshot, on features of the mode the model was trained on."""
    mode = forest.mode or "extractor"
    features = snapshot_features(points, mode, a0)
    return score(forest, feature_dataset(features), mode).select(F.col("file").alias("snapshot_id"), "prediction")


def geometric_vacancies(
    scan: DumpScan, reference: DumpScan, periodic: bool = True, affine: bool = False
) -> WignerSeitz:
    """Wigner-Seitz analysis of every dump of ``scan`` against the one dump of ``reference``."""
    # dropped rows leave gaps in the row numbers; sites are numbered without gaps in the same order
    sites = stage(number_rows(
        reference.boxed_atoms().select("atom_id", *"xyz"), [], ["atom_id"], "site_id").drop("atom_id"), "reference")
    ref_box = reference.boxes().select(*BOX[1:]).first()
    if ref_box is None:
        raise ValueError("the reference dump has no box bounds")
    return WignerSeitz(
        stage(scan.boxed_atoms(), "boxed"), sites, scan.boxes().select(*BOX), ref_box.asDict(), periodic, affine)


def compare_methods(
    spark: SparkSession,
    path: str,
    reference_path: str,
    forest: Forest,
    a0: float = DEFAULT_A0,
    periodic: bool = True,
    affine: bool = False,
    name_pattern: str | None = None,
) -> DataFrame:
    """Learned and geometric vacancy counts of every dump side by side.

    A file that one of the two readers sets aside keeps its row, with NULL counts and the reason in ``ml_status``
    or ``ws_status``.
    """
    scan = scan_dumps(spark, path, name_pattern=name_pattern)
    reference = scan_dumps(spark, reference_path, name_pattern=name_pattern)
    summary = geometric_vacancies(scan, reference, periodic, affine).summary()
    points = stage(scan.atoms().select("snapshot_id", "atom_id", *"xyz"), "points")
    both = method_comparison(predict_vacancies(points, forest, a0), summary)
    status = scan.status.select(F.col("file").alias("snapshot_id"), F.col("status").alias("ml_status")).join(
        scan.boxed_status.select(F.col("file").alias("snapshot_id"), F.col("status").alias("ws_status")), "snapshot_id", "full")
    return status.join(both, "snapshot_id", "left")
