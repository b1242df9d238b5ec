"""One wide feature row per snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voidscope.functions.spread import attach
from voidscope.operators.alignment import DEFAULT_A0, box_size, frames, project
from voidscope.operators.bandwidth import ms_bandwidth
from voidscope.operators.catalog import FAMILIES, FEATURES
from voidscope.operators.grid import GRID_EPSILON, cell_aggregates, cell_code, grid_columns
from voidscope.operators.shape import (
    bin_code,
    entropy_from_counts,
    moi_principal_3,
    radial_aggregates,
    radial_columns,
    radius_from_centroid,
)
from voidscope.session import stage


def bounded_frames(points: DataFrame, a0: float, mode: str) -> DataFrame:
    """Per-snapshot axes, aligned extremes, grid box size and radial statistics (staged)."""
    framed = frames(points, a0, mode)
    aligned = project(points, framed, keep=("cx", "cy", "cz"))
    extremes = aligned.groupBy("snapshot_id").agg(
        *[F.min(f"pc{k}").alias(f"min_pc{k}") for k in (1, 2, 3)],
        *[F.max(f"pc{k}").alias(f"max_pc{k}") for k in (1, 2, 3)],
        *[c.alias(name) for name, c in radial_aggregates(radius_from_centroid()).items()],
    )
    extent = F.greatest(*[F.col(f"max_pc{k}") - F.col(f"min_pc{k}") for k in (1, 2, 3)])
    return stage(
        framed.join(extremes, "snapshot_id").withColumn("box_size", box_size(extent, F.col("n"), mode)),
        "bounds",
    )


def snapshot_features(
    points: DataFrame,
    mode: str = "training",
    a0: float = DEFAULT_A0,
    families: tuple[str, ...] = tuple(FAMILIES),
    epsilon: float = GRID_EPSILON,
) -> DataFrame:
    """The 19 features of every snapshot, plus ``num_points``.

    ``training`` takes entropy and bandwidth from the aligned cloud and sizes the grid by its extent;
    ``extractor`` takes them from the raw cloud and clamps the grid box. Three column-pruned passes over
    the points (moments, aligned extremes, cell counts) and one sampling pass; everything per snapshot
    is small and staged between them.
    """
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown feature families: {sorted(unknown)}")
    if not families:
        raise ValueError("at least one feature family is needed")
    bounds = bounded_frames(points, a0, mode)
    cells = project(points, bounds, keep=tuple(c for c in bounds.columns if c.startswith(("min_", "max_", "box_"))))
    grid = cell_code(("pc1", "pc2", "pc3"), F.col("box_size"))
    names = ["pc1", "pc2", "pc3"] if mode == "training" else ["x", "y", "z"]
    bins = bin_code([(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}")) for c in names])
    wanted = [(kind, code) for family, kind, code in (("grid", "g", grid), ("entropy", "e", bins))
              if family in families]
    row = bounds
    if wanted:
        marks = F.array(*[F.struct(F.lit(kind).alias("kind"), code.alias("code")) for kind, code in wanted])
        counts = (
            cells.select("snapshot_id", F.explode(marks).alias("_m"))
            .select("snapshot_id", "_m.kind", "_m.code")
            .filter(F.col("code").isNotNull())
            .groupBy("snapshot_id", "kind", "code")
            .agg(F.count("*").alias("k"))
        )
        code = F.when(F.col("kind") == "g", F.col("code"))
        k = F.when(F.col("kind") == "e", F.col("k"))
        aggregates = [c.alias(name) for name, c in cell_aggregates(code).items()]
        totals = counts.groupBy("snapshot_id").agg(
            *aggregates, entropy_from_counts(k, F.lit(2)).alias("entropy_spatial"))
        shaped = grid_columns(totals, epsilon)
        row = row.join(shaped, "snapshot_id", "left").withColumn(
            "entropy_spatial", F.when(F.col("n") >= 2, F.col("entropy_spatial")))
        for name in FAMILIES["grid"]:  # no cell inside the box: an empty grid
            row = row.withColumn(name, F.coalesce(name, F.lit(0.0)))
    row = row.withColumns({"moi_principal_3": moi_principal_3(), **radial_columns(F.col("n"))})
    if "clustering" in families:
        row = row.join(ms_bandwidth(points), "snapshot_id", "left")
        if mode == "training":  # distances do not change under rotation
            row = row.withColumn("ms_bandwidth", F.col("ms_bandwidth") / F.col("scale"))
    kept = {name for family in families for name in FAMILIES[family]}
    return row.select(
        "snapshot_id",
        *[(F.col(f) if f in kept else F.lit(None).cast("double")).alias(f) for f in FEATURES],
        F.col("n").alias("num_points"),
    )
