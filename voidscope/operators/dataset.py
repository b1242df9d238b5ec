"""Feature datasets: targets, training columns, statistics, split, imputation and scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from voidscope.functions.ranking import exact_medians, smallest_flag
from voidscope.operators.catalog import FEATURES, TARGET

# Columns never used for training, default split and seed, atoms of the full crystal.
FORBIDDEN = ["n_vacancies", "n_atoms_surface", "vacancies", "file"]
BOOKKEEPING = ["num_points"]
TEST_SIZE = 0.2
SEED = 42
TOTAL_ATOMS = 16384


def vacancy_target(points: DataFrame, total_atoms: int = TOTAL_ATOMS) -> DataFrame:
    """Missing atoms of each snapshot against the full crystal."""
    return points.groupBy("snapshot_id").agg(
        (F.lit(total_atoms) - F.count("*")).cast("double").alias(TARGET))


def feature_dataset(features: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Output layout: ``file``, the features in catalog order (absent ones NULL), and the target if any."""
    joined = features if targets is None else features.join(targets, "snapshot_id", "left")
    if "snapshot_id" in joined.columns:
        joined = joined.withColumnRenamed("snapshot_id", "file")
    names = [*FEATURES, *([TARGET] if TARGET in joined.columns else []),
             *[c for c in BOOKKEEPING if c in joined.columns]]
    return joined.select("file", *[
        F.col(c) if c in joined.columns else F.lit(None).cast("double").alias(c) for c in names])


def missing(column: str, kind: str) -> Column:
    """NULL, or NaN in a floating column."""
    null = F.col(column).isNull()
    return null | F.isnan(column) if kind in ("double", "float") else null


def candidate_columns(dataset: DataFrame) -> list[str]:
    """Numeric columns that are neither forbidden nor bookkeeping."""
    dropped = {*FORBIDDEN, *BOOKKEEPING}
    return [f.name for f in dataset.schema.fields
            if f.name not in dropped and isinstance(f.dataType, NumericType)]


def training_columns(dataset: DataFrame) -> list[str]:
    """:func:`candidate_columns` that hold at least one value, found in one aggregate row."""
    if TARGET not in dataset.columns:
        raise ValueError(f"the dataset has no {TARGET} column")
    names = candidate_columns(dataset)
    kinds = dict(dataset.dtypes)
    filled = dataset.agg(*[F.count(F.when(~missing(c, kinds[c]), 1)).alias(c) for c in names]).first()
    return [c for c in names if filled[c] > 0]


def training_frame(dataset: DataFrame) -> DataFrame:
    """``file``, the training columns and the target as double."""
    kinds = dict(dataset.dtypes)
    return dataset.select("file", *[
        F.when(~missing(c, kinds[c]), F.col(c).cast("double")).alias(c) for c in training_columns(dataset)
    ], F.col(TARGET).cast("double").alias(TARGET))


def missing_count(dataset: DataFrame) -> DataFrame:
    """Missing cells over all training columns."""
    names, kinds = training_columns(dataset), dict(dataset.dtypes)
    per_row = sum((missing(c, kinds[c]).cast("long") for c in names), F.lit(0).cast("long"))
    return dataset.agg(F.sum(per_row).alias("missing_cells"), F.count("*").alias("samples"))


def dataset_stats(dataset: DataFrame) -> DataFrame:
    """Target range, mean and sample deviation, and occupancy ranges."""
    return dataset.agg(
        F.min(TARGET).alias("vacancies_min"), F.max(TARGET).alias("vacancies_max"),
        F.avg(TARGET).alias("vacancies_mean"), F.stddev_samp(TARGET).alias("vacancies_std"),
        F.min("occupancy_total").alias("occupancy_total_min"),
        F.max("occupancy_total").alias("occupancy_total_max"),
        F.min("occupancy_fraction").alias("occupancy_fraction_min"),
        F.max("occupancy_fraction").alias("occupancy_fraction_max"),
    )


def split(dataset: DataFrame, test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """Add ``is_test`` to exactly ``ceil(test_size * n)`` rows, repeatably by ``md5(seed:file)``."""
    wanted = math.ceil(test_size * dataset.count())
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("file").cast("string")))
    return smallest_flag(dataset, key, ["file"], wanted, "is_test")


def fit_medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    return exact_medians(train, columns)


def impute(dataset: DataFrame, medians: dict[str, float]) -> DataFrame:
    return dataset.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items()})


def fit_scaling(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column gets deviation 1."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                    *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
                    *[F.min(c).alias(f"l_{c}") for c in columns],
                    *[F.max(c).alias(f"h_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"], 1.0 if row[f"l_{c}"] == row[f"h_{c}"] or not row[f"s_{c}"] else row[f"s_{c}"])
            for c in columns}


def standard_scale(dataset: DataFrame, scaling: dict[str, tuple[float, float]]) -> DataFrame:
    return dataset.withColumns({
        c: (F.col(c) - F.lit(mean)) / F.lit(deviation) for c, (mean, deviation) in scaling.items()})


def fit_preprocessing(train: DataFrame, columns: list[str]):
    """Medians and scaling of the training rows; columns without a training value get neither."""
    medians = fit_medians(train, columns)
    return medians, fit_scaling(impute(train, medians), [c for c in columns if c in medians])
