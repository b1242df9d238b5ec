"""Inertia, radial statistics and spatial entropy, per snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voidscope.functions.spread import attach
from voidscope.operators.alignment import moments, pca
from voidscope.session import stage

ENTROPY_BINS = 10
FLAT_DEVIATION = 1e-6


def moi_principal_3() -> Column:
    """Smallest inertia eigenvalue from the covariance eigenvalues: (n-1)(l2+l3)."""
    return F.when(F.col("n") >= 3, (F.col("n") - 1) * (F.col("l2") + F.col("l3")))


def moi_principal(points: DataFrame) -> DataFrame:
    return pca(points).select("snapshot_id", moi_principal_3().alias("moi_principal_3"))


def radius_from_centroid() -> Column:
    dx, dy, dz = (F.col(a) - F.col(f"c{a}") for a in "xyz")
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def radial_aggregates(radius: Column) -> dict[str, Column]:
    return {
        "_radius_mean": F.avg(radius),
        "_radius_std": F.stddev_pop(radius),
        "_radius_kurtosis": F.kurtosis(radius),
    }


def radial_columns(n: Column) -> dict[str, Column]:
    flat = F.col("_radius_std") < FLAT_DEVIATION
    return {
        "rdf_mean": F.when(n >= 2, F.col("_radius_mean")),
        "rdf_kurtosis": F.when(n >= 2, F.when(flat, F.lit(0.0)).otherwise(F.col("_radius_kurtosis"))),
    }


def radial_stats(points: DataFrame) -> DataFrame:
    joined = attach(points, stage(moments(points), "moments"))
    aggregates = [c.alias(k) for k, c in radial_aggregates(radius_from_centroid()).items()]
    grouped = joined.groupBy("snapshot_id").agg(F.first("n").alias("n"), *aggregates)
    return grouped.select("snapshot_id", *[c.alias(k) for k, c in radial_columns(F.col("n")).items()])


def bin_code(axes: list[tuple[Column, Column, Column]], bins: int = ENTROPY_BINS) -> Column:
    """Histogram bin over (value, low, high) axes; the last bin is closed, an empty range widens by 0.5."""
    code = F.lit(0)
    for value, low, high in axes:
        flat = low == high
        start = F.when(flat, low - 0.5).otherwise(low)
        width = F.when(flat, F.lit(1.0)).otherwise(high - low)
        code = code * bins + F.least(F.floor((value - start) / width * bins), F.lit(bins - 1))
    return code.cast("int")


def entropy_from_counts(count: Column, n: Column) -> Column:
    """Shannon entropy (nats) of shares count/n, as an aggregate over bins."""
    return F.when(F.max(n) >= 2, F.log(F.sum(count)) - F.sum(count * F.log(count)) / F.sum(count))


def spatial_entropy(points: DataFrame, bins: int = ENTROPY_BINS) -> DataFrame:
    joined = attach(points, stage(moments(points), "moments"))
    axes = [(F.col(a), F.col(f"min_{a}"), F.col(f"max_{a}")) for a in "xyz"]
    counts = joined.groupBy("snapshot_id", bin_code(axes, bins).alias("bin")).agg(
        F.count("*").alias("k"), F.first("n").alias("n"))
    return counts.groupBy("snapshot_id").agg(
        entropy_from_counts(F.col("k"), F.col("n")).alias("entropy_spatial"))
