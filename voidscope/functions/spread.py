"""Joining per-snapshot rows to points without letting one large snapshot fill one task.

``atom_id`` is the 0-based row position inside a snapshot, so ``atom_id >> 20`` cuts every snapshot
into chunks of about a million atoms. A per-snapshot row is repeated once per chunk and the join
runs on ``(snapshot_id, chunk)``: no join key ever holds more than one chunk of atoms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BITS = 20


def chunk(atom_id: str = "atom_id") -> Column:
    return F.shiftright(F.col(atom_id), CHUNK_BITS)


def last_chunk() -> Column:
    """Aggregate that a per-snapshot table must carry to be used with :func:`attach`."""
    return F.max(chunk()).alias("last_chunk")


def spread(per_snapshot: DataFrame) -> DataFrame:
    """One row per (snapshot, chunk)."""
    chunks = F.sequence(F.lit(0).cast("long"), F.col("last_chunk"))
    return per_snapshot.withColumn("chunk", F.explode(chunks)).drop("last_chunk")


def attach(points: DataFrame, per_snapshot: DataFrame) -> DataFrame:
    """Join columns of ``per_snapshot`` (with ``last_chunk``) to every point."""
    return (
        points.withColumn("chunk", chunk())
        .join(spread(per_snapshot), ["snapshot_id", "chunk"])
        .drop("chunk")
    )


def with_last_chunk(points: DataFrame, per_snapshot: DataFrame) -> DataFrame:
    """Add ``last_chunk`` to a per-snapshot table that does not have it; snapshots without points go."""
    return per_snapshot.join(points.groupBy("snapshot_id").agg(last_chunk()), "snapshot_id")
