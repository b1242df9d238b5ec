"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text handled at a time inside a task, in bytes (one longer text is handled alone).
SLICE_BYTES = 4 << 20
_STEPS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, parts: int) -> Column:
    """``crc32(id as text) mod parts``; NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(fold(id_col, parts) == part, F.lit(False))


def bounded_sample(rows: DataFrame, stratum: str, id_col: str, limit: int) -> DataFrame:
    """At most ``limit`` rows per value of ``stratum``, those with the smallest hashed ids.

    Counts per stratum give a hash threshold that thins the rows where they are read; only about
    ``1.3 * limit`` rows of each stratum are shuffled to be ranked.
    """
    sizes = rows.groupBy(stratum).count().collect()  # one row per label value
    place = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(_STEPS))
    keep = F.lit(False)
    for value, n in sizes:
        share = min(_STEPS, int(_STEPS * (1.3 * limit + 50) / n))
        keep = keep | (F.col(stratum).eqNullSafe(F.lit(value)) & (place < share))
    ranked = Window.partitionBy(stratum).orderBy(place, id_col)
    return (
        rows.filter(keep).withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= limit).drop("_rank")
    )


def texts(column: pa.Array) -> list[str]:
    """A text column as Python strings, NULL as the empty text."""
    return pc.fill_null(column, "").to_pylist()


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``limit`` bytes of text each."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    start = 0
    for end in [*cuts.tolist(), batch.num_rows]:
        yield batch.slice(start, end - start)
        start = end


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of consecutive runs of ``values`` of the given lengths; zero for an empty run."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(values, starts, axis=0)
    return out
