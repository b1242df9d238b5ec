"""k-th neighbor distances and the mean-shift bandwidth on at most 500 sampled points per snapshot."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from voidscope.functions.spread import attach, last_chunk
from voidscope.operators.neighbors import nearest_other
from voidscope.session import stage

# Sample cap, neighbor share, smallest cloud, sampling multiplier (odd, below 2^31).
SAMPLE_CAP = 500
QUANTILE = 0.2
MIN_POINTS = 10
SCRAMBLE = 1597334677
LARGE = 1 << 17  # points from which a snapshot is thinned before sampling


def sample_key(atom_id: str = "atom_id") -> Column:
    """Repeatable pseudo-random order: multiplication modulo 2^32 permutes the ids."""
    return ((F.col(atom_id) % (1 << 32)) * F.lit(SCRAMBLE)) % (1 << 32)


def _first_by_key(points: DataFrame, cap: int) -> DataFrame:
    order = Window.partitionBy("snapshot_id").orderBy(sample_key(), "atom_id")
    return points.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= cap).drop("_rank")


def sample_points(points: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """The ``cap`` points of every snapshot with the smallest keys.

    Map tasks keep only their own first ``cap`` before the shuffle. In a large snapshot, points with a
    key beyond about eight times the expected limit are skipped first, so that the sum of all map tasks'
    shares stays small too; where fewer than ``cap`` points pass, the snapshot is sampled without it.
    """
    points = points.select("snapshot_id", "atom_id", "x", "y", "z")
    large = stage(
        points.groupBy("snapshot_id").agg(F.count("*").alias("_n"), last_chunk())
        .filter(F.col("_n") > LARGE).withColumn("_limit", F.lit(2.0**32 * 8 * cap) / F.col("_n")).drop("_n"),
        "large")
    if large.isEmpty():
        return _first_by_key(points, cap)
    small = points.join(large.select("snapshot_id"), "snapshot_id", "left_anti")
    likely = attach(points, large).filter(sample_key() < F.col("_limit")).drop("_limit")
    sampled = stage(_first_by_key(likely, cap), "sampled")
    full = sampled.groupBy("snapshot_id").count().filter(F.col("count") == cap).select("snapshot_id")
    rest = points.join(
        large.select("snapshot_id").join(full, "snapshot_id", "left_anti"), "snapshot_id", "left_semi")
    return _first_by_key(small, cap).unionByName(sampled.join(full, "snapshot_id", "left_semi")).unionByName(
        _first_by_key(rest, cap))


def _sampled_clouds(points: DataFrame, cap: int) -> DataFrame:
    """One row per snapshot holding its sample as arrays, never longer than ``cap``."""
    return sample_points(points, cap).groupBy("snapshot_id").agg(
        F.sort_array(F.collect_list(F.struct("atom_id", "x", "y", "z"))).alias("_cloud")
    ).select(
        "snapshot_id",
        *[F.col(f"_cloud.{c}").alias(f"_{c}") for c in ("atom_id", "x", "y", "z")],
        F.size("_cloud").alias("n_sampled"),
    )


def _kth_distances(rank: Column) -> Column:
    """Array of k-th smallest distances inside each sample row, itself counted."""

    def kth(x: pd.Series, y: pd.Series, z: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for xs, ys, zs, at in zip(x, y, z, k):
            if at < 1 or at > len(xs):
                out.append(np.full(len(xs), np.nan))
                continue
            squared = sum(np.subtract.outer(c, c) ** 2 for c in (xs, ys, zs))
            out.append(np.sqrt(np.partition(squared, at - 1, axis=1)[:, at - 1]))
        return pd.Series(out)

    # a local function travels to the workers by value, so they need not have this package
    return F.pandas_udf(kth, ArrayType(DoubleType()))("_x", "_y", "_z", rank)


def neighbor_rank(n_sampled: Column, quantile: float = QUANTILE) -> Column:
    return F.greatest(F.lit(1), F.floor(n_sampled * quantile)).cast("int")


def knn_distance(points: DataFrame, k: int | None = None, cap: int = SAMPLE_CAP) -> DataFrame:
    """Distance from each sampled point to its k-th nearest sampled point, itself counted.

    ``k=None`` uses the bandwidth rank, a fifth of the sample.
    """
    rank = neighbor_rank(F.col("n_sampled")) if k is None else F.lit(k)
    distances = _sampled_clouds(points, cap).withColumn("_d", _kth_distances(rank))
    return distances.select(
        "snapshot_id", F.explode(F.arrays_zip(F.col("_atom_id"), F.col("_d"))).alias("_p")
    ).select("snapshot_id", F.col("_p._atom_id").alias("atom_id"),
             F.when(~F.isnan("_p._d"), F.col("_p._d")).alias("kth_distance"))


def sampled_bandwidth(points: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """Mean k-th neighbor distance of the sample (NULL under ten points)."""
    clouds = _sampled_clouds(points, cap).withColumn(
        "_d", _kth_distances(neighbor_rank(F.col("n_sampled"))))
    mean = F.aggregate("_d", F.lit(0.0), lambda s, d: s + d) / F.size("_d")
    return clouds.select(
        "snapshot_id", F.when(F.col("n_sampled") >= MIN_POINTS, mean).alias("ms_bandwidth"))


def ms_bandwidth(points: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """:func:`sampled_bandwidth`, or twice the mean nearest-neighbor distance of the whole cloud where
    the sample's k-th neighbors all coincide."""
    sampled = stage(sampled_bandwidth(points, cap), "bandwidth")
    flat = sampled.filter(F.col("ms_bandwidth") <= 0).select("snapshot_id")
    if flat.isEmpty():
        return sampled
    clouds = points.join(flat, "snapshot_id", "left_semi")
    fallback = nearest_other(clouds).groupBy("snapshot_id").agg(
        (2 * F.sum(F.col("distance") * F.col("copies")) / F.sum("copies")).alias("_fallback"))
    return sampled.join(fallback, "snapshot_id", "left").select(
        "snapshot_id", F.coalesce("_fallback", "ms_bandwidth").alias("ms_bandwidth"))
