"""Feature dataset and point cloud files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from voidscope.operators.catalog import FEATURES, TARGET


def write_features(dataset: DataFrame, path: str, kind: str = "parquet", ordered: bool = False) -> None:
    """Write ``file`` plus features, one output file per task.

    ``ordered`` cuts the rows into ranges of ``file`` and sorts each, so that the files in the order of their
    names hold all rows in the order of ``file``.
    """
    if ordered:
        dataset = dataset.repartitionByRange("file").sortWithinPartitions("file")
    writer = dataset.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def read_features_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read a feature CSV with a header; an empty cell or NaN becomes NULL.

    Without ``schema`` the header row gives the columns: ``file`` is text, everything else double.
    """
    if schema is None:
        names = spark.read.option("header", True).csv(path).columns
        schema = StructType([
            StructField(n, StringType() if n == "file" else DoubleType()) for n in names])
    if TARGET not in schema.names:
        raise ValueError(f"the dataset has no {TARGET} column")
    frame = spark.read.schema(schema).option("header", True).csv(path)
    return frame.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, DoubleType)
        else F.col(f.name) for f in schema.fields])


def feature_schema(key: StringType | None = None) -> StructType:
    """``file``, the 19 features and the target."""
    return StructType([StructField("file", key or StringType()),
                       *[StructField(n, DoubleType()) for n in [*FEATURES, TARGET]]])


def write_points(points: DataFrame, path: str) -> None:
    """Write a point cloud (x, y, z only) as Parquet.

    Rows keep their partitions: a large snapshot stays spread over many files, and the snapshot column's
    statistics let readers skip files.
    """
    points.select("snapshot_id", "atom_id", "x", "y", "z").write.mode("overwrite").parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
