"""Names, order and grouping of the snapshot features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Feature names in output order, grouped by family.
CATEGORIES = {
    "occupancy": ["occupancy_total", "occupancy_fraction", "occupancy_x_mean", "occupancy_y_mean",
                  "occupancy_z_mean"],
    "gradients": ["occupancy_gradient_x", "occupancy_gradient_y", "occupancy_gradient_z",
                  "occupancy_gradient_total", "occupancy_surface"],
    "grid_analysis": ["grid_entropy", "grid_moi_1", "grid_moi_2", "grid_moi_3"],
    "shape_analysis": ["moi_principal_3"],
    "radial_distribution": ["rdf_mean", "rdf_kurtosis"],
    "spatial_analysis": ["entropy_spatial", "ms_bandwidth"],
    "target": ["n_vacancies"],
}
TARGET = "n_vacancies"
FEATURES = [name for group, names in CATEGORIES.items() if group != "target" for name in names]

# Feature families that can be switched off, and the columns each one provides.
FAMILIES = {
    "grid": FEATURES[:14],
    "inertia": ["moi_principal_3"],
    "radial": ["rdf_mean", "rdf_kurtosis"],
    "entropy": ["entropy_spatial"],
    "clustering": ["ms_bandwidth"],
}


def feature_catalog(spark: SparkSession, include_target: bool = True) -> DataFrame:
    rows = [
        (name, group, ordinal)
        for ordinal, (name, group) in enumerate(
            (name, group) for group, names in CATEGORIES.items() for name in names)
        if include_target or name != TARGET
    ]
    return spark.createDataFrame(rows, "feature string, category string, ordinal int")


def catalog_statistics(features: DataFrame) -> DataFrame:
    """Catalog joined with filled-value counts and ranges of a feature dataset, one row per feature."""
    present = [c for c in [*FEATURES, TARGET] if c in features.columns]
    long = features.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in present
    ])).alias("_c")).select("_c.*")
    ranges = long.groupBy("feature").agg(
        F.count("value").alias("filled"), F.min("value").alias("low"), F.max("value").alias("high"))
    return feature_catalog(features.sparkSession).join(ranges, "feature", "left")
