"""Centroids, principal axes, aligned clouds and grid box sizes, per snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voidscope.functions.geometry import with_principal_axes
from voidscope.functions.spread import attach, last_chunk
from voidscope.session import stage

# Lattice constant, smallest and largest clamped box, its margin, boxes of tiny clouds.
DEFAULT_A0 = 3.532
MIN_BOX, MAX_BOX, BOX_MARGIN = 1.5, 10.0, 1.5
TINY_BOX = {"training": 1.0, "extractor": 2.0}

MODES = ("training", "extractor")
COVARIANCE = ("sxx", "syy", "szz", "sxy", "sxz", "syz")


def centroid(points: DataFrame) -> DataFrame:
    return points.groupBy("snapshot_id").agg(
        F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz")
    )


def center(points: DataFrame) -> DataFrame:
    """Points relative to their snapshot's centroid."""
    means = stage(
        points.groupBy("snapshot_id").agg(
            F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"), last_chunk()
        ),
        "centroid",
    )
    return attach(points, means).select(
        "snapshot_id", "atom_id", *[(F.col(a) - F.col(f"c{a}")).alias(a) for a in "xyz"]
    )


def moments(points: DataFrame) -> DataFrame:
    """Count, centroid, sample covariance and raw extremes in one map-side combined pass."""
    pairs = {f"s{a}{b}": F.covar_samp(a, b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    return points.groupBy("snapshot_id").agg(
        F.count("*").alias("n"),
        *[F.avg(a).alias(f"c{a}") for a in "xyz"],
        *[c.alias(name) for name, c in pairs.items()],
        *[F.min(a).alias(f"min_{a}") for a in "xyz"],
        *[F.max(a).alias(f"max_{a}") for a in "xyz"],
        last_chunk(),
    )


def pca(points: DataFrame) -> DataFrame:
    """:func:`moments` plus eigenvalues ``l1 >= l2 >= l3`` and axes ``r11 .. r33``.

    Clouds of fewer than three points get the identity axes.
    """
    fitted = with_principal_axes(moments(points), COVARIANCE)
    small = F.col("n") < 3
    identity = {f"r{i}{j}": F.when(small, F.lit(1.0 if i == j else 0.0)).otherwise(F.col(f"r{i}{j}"))
                for i in (1, 2, 3) for j in (1, 2, 3)}
    return fitted.withColumns(identity)


def frames(points: DataFrame, a0: float = DEFAULT_A0, mode: str = "training") -> DataFrame:
    """Staged :func:`pca` rows with the length ``scale`` of the chosen feature mode.

    The training normalizer leaves clouds under three points unscaled, the extractor does not.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    scale: Column = F.lit(float(a0))
    if mode == "training":
        scale = F.when(F.col("n") < 3, F.lit(1.0)).otherwise(scale)
    return stage(pca(points).withColumn("scale", scale), "frames")


def project(points: DataFrame, framed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rotate centered points onto the principal axes of ``framed`` and divide by ``scale``."""
    joined = attach(points, framed)
    offset = [F.col(a) - F.col(f"c{a}") for a in "xyz"]
    axes = [
        ((offset[0] * F.col(f"r{k}1") + offset[1] * F.col(f"r{k}2") + offset[2] * F.col(f"r{k}3"))
         / F.col("scale")).alias(f"pc{k}")
        for k in (1, 2, 3)
    ]
    return joined.select("snapshot_id", "atom_id", "x", "y", "z", *axes, *keep)


def align(points: DataFrame, a0: float = DEFAULT_A0, mode: str = "training") -> DataFrame:
    return project(points, frames(points, a0, mode)).drop("x", "y", "z")


def box_size(extent: Column, n: Column, mode: str) -> Column:
    """Grid box edge from the largest aligned extent."""
    if mode == "extractor":
        sized = F.greatest(F.lit(MIN_BOX), F.least(extent * BOX_MARGIN, F.lit(MAX_BOX)))
    else:
        sized = extent
    return F.when(n < 3, F.lit(TINY_BOX[mode])).otherwise(sized)


def box_sizes(points: DataFrame, a0: float = DEFAULT_A0, mode: str = "training") -> DataFrame:
    aligned = project(points, frames(points, a0, mode), keep=("n",))
    extent = F.greatest(*[F.max(f"pc{k}") - F.min(f"pc{k}") for k in (1, 2, 3)])
    return aligned.groupBy("snapshot_id").agg(
        F.first("n").alias("n"), extent.alias("extent")
    ).select("snapshot_id", box_size(F.col("extent"), F.col("n"), mode).alias("box_size"))
