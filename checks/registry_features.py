"""Registered feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixtures import cloud_embeddings, cloud_lineitem
from voidscope.operators import alignment, bandwidth, grid, shape
from voidscope.operators.catalog import FAMILIES
from voidscope.plans.features import snapshot_features


def rounded(df: DataFrame, digits: int = 6, **overrides: int) -> DataFrame:
    """Round every double column so that summation order does not show."""
    return df.select(*[
        F.round(c, overrides.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def boxed(points: DataFrame, mode: str = "training") -> DataFrame:
    from voidscope.plans.features import bounded_frames

    return alignment.project(points, bounded_frames(points, alignment.DEFAULT_A0, mode), keep=("box_size",))


def _grid(columns: list[str]):
    def run(spark, sf_dir):
        cells = grid.grid_cells(boxed(cloud_lineitem(spark, sf_dir)))
        return rounded(grid.grid_features(cells).select("snapshot_id", *columns))

    return run


QUERIES = {
    "centroid": lambda s, d: rounded(alignment.centroid(cloud_lineitem(s, d)), 7),
    "center": lambda s, d: rounded(alignment.center(cloud_lineitem(s, d)), 7),
    "pca_eigenvalues": lambda s, d: rounded(
        alignment.pca(cloud_lineitem(s, d)).select("snapshot_id", "l1", "l2", "l3")),
    "pca_aligned": lambda s, d: rounded(alignment.align(cloud_lineitem(s, d))),
    "box_size_extent": lambda s, d: rounded(alignment.box_sizes(cloud_lineitem(s, d), mode="training")),
    "box_size_clamped": lambda s, d: rounded(alignment.box_sizes(cloud_lineitem(s, d), mode="extractor")),
    "grid_cells": lambda s, d: grid.grid_cells(boxed(cloud_lineitem(s, d))),
    "grid_occupancy": _grid(FAMILIES["grid"][:5]),
    "grid_gradients": _grid(FAMILIES["grid"][5:10]),
    "grid_entropy": _grid(["grid_entropy"]),
    "grid_moi": _grid(["grid_moi_1", "grid_moi_2", "grid_moi_3"]),
    "moi_principal": lambda s, d: rounded(shape.moi_principal(cloud_lineitem(s, d)), 4),
    "radial_stats": lambda s, d: rounded(shape.radial_stats(cloud_lineitem(s, d))),
    "spatial_entropy": lambda s, d: rounded(shape.spatial_entropy(cloud_lineitem(s, d))),
    "knn_distance": lambda s, d: rounded(bandwidth.knn_distance(cloud_embeddings(s, d))),
    "ms_bandwidth": lambda s, d: rounded(bandwidth.ms_bandwidth(cloud_lineitem(s, d))),
    "features_training": lambda s, d: rounded(
        snapshot_features(cloud_lineitem(s, d), mode="training"), moi_principal_3=4),
    "features_families": lambda s, d: rounded(
        snapshot_features(cloud_lineitem(s, d), mode="extractor", families=("grid", "radial"))),
    "features_extractor": lambda s, d: rounded(
        snapshot_features(cloud_lineitem(s, d), mode="extractor"), moi_principal_3=4),
}
