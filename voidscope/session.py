"""Shared-folder staging: cut lineage, survive executor loss, give Catalyst real sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="voidscope-"))
    return context.getCheckpointDir().rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/voidscope/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later plans scan the written table instead of recomputing it, and its file size lets Catalyst
    broadcast it when it is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffle otherwise.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_bytes(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; 0 where broadcasts are switched off."""
    text = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")).strip().lower()
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)(?:i?b)?", text).groups()
    return max(0, int(number) << 10 * " kmgt".index(unit or " "))
