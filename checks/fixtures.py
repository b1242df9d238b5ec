"""Adapters from the given test tables to point clouds, lattices, boxes and feature datasets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voidscope.functions.ranking import number_rows
from voidscope.plans.features import snapshot_features
from voidscope.session import stage, staging_path

TOTAL_ATOMS = 700
LATTICE_CELLS = (10, 10, 10)
LATTICE_SPACING = (5.0, 10.5, 2.0)
LATTICE_SHIFT = (0.7071067811865476, 1.4142135623730951, 0.3141592653589793)
BOX = (50.0, 105.0, 20.0)

_staged: dict[tuple[str, ...], DataFrame] = {}
_paths: dict[tuple[str, ...], str] = {}


def _once(spark: SparkSession, key: tuple[str, ...], build) -> DataFrame:
    """Ingest a raw table once per session; later queries scan the staged result."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _staged:
        _staged[key] = stage(build(), key[1])
    return _staged[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots by supplier; quantity, price and discount as coordinates."""

    def build() -> DataFrame:
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_shipdate"]
        rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", *order)
        return number_rows(rows, ["l_suppkey"], order, "atom_id").select(
            F.col("l_suppkey").alias("snapshot_id"),
            "atom_id",
            F.col("l_quantity").alias("x"),
            (F.col("l_extendedprice") / 1000).alias("y"),
            (F.col("l_discount") * 200).alias("z"),
        )

    return _once(spark, ("cloud_lineitem", sf_dir), build)


def cloud_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots by label; the first three vector components as coordinates."""
    component = [F.col("embedding")[i].cast("double").alias(axis) for i, axis in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("snapshot_id"), F.col("vec_id").alias("atom_id"), *component)


def cloud_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small clouds by customer: price and order number folded into coordinates between 0 and 10."""

    def build() -> DataFrame:
        rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
        key = F.col("o_orderkey")
        return number_rows(rows, ["o_custkey"], ["o_orderkey"], "atom_id").select(
            F.col("o_custkey").alias("snapshot_id"), "atom_id",
            (F.col("o_totalprice") % 1000 / 100).alias("x"), (key % 997 / 100).alias("y"), (key * 31 % 1009 / 100).alias("z"))

    return _once(spark, ("cloud_orders", sf_dir), build)


def boxes_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of edges between 3 and 8 that repeat along some axes, by customer number."""
    key = F.col("c_custkey")
    high = {"xhi": F.lit(3.0) + F.col("c_nationkey") * 0.2, "yhi": F.lit(4.0) + key % 5 * 0.5, "zhi": F.lit(5.0)}
    flags = {"px": key % 2 == 0, "py": key % 3 == 0, "pz": F.floor(key / 2) % 2 == 0}
    return table(spark, sf_dir, "customer").select(
        key.alias("snapshot_id"), *[F.lit(0.0).alias(f"{axis}lo") for axis in "xyz"],
        *[c.alias(n) for n, c in {**high, **flags}.items()])


def boxes_tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`boxes_customer` as tilted cells."""
    key = F.col("snapshot_id")
    return boxes_customer(spark, sf_dir).withColumns({
        "xy": key % 4 * 0.4, "xz": F.lit(-0.3), "yz": key % 3 * 0.5})


def boxes_solvent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`boxes_customer` of the customers that owe nothing; the others have no box."""
    keep = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("snapshot_id"))
    return boxes_customer(spark, sf_dir).drop("px", "py", "pz").join(keep, "snapshot_id", "left_semi")


CUBE_EDGE, CUBE_CELLS = 8.0, 4


def sites_cube(spark: SparkSession) -> DataFrame:
    """4x4x4 reference sites in a cube of edge 8."""
    index = (F.floor(F.col("id") / 16), F.floor(F.col("id") / 4) % 4, F.col("id") % 4)
    return spark.range(CUBE_CELLS**3).select(
        F.col("id").alias("site_id"), *[(i * 2.0 + 0.75).alias(axis) for axis, i in zip("xyz", index)])


def cube_box() -> dict[str, float]:
    return {f"{a}{end}": CUBE_EDGE if end == "hi" else 0.0 for a in "xyz" for end in ("lo", "hi")}


def sites_lattice(spark: SparkSession) -> DataFrame:
    """10x10x10 reference sites with a different spacing per axis."""
    i, j, k = F.floor(F.col("id") / 100), F.floor(F.col("id") / 10) % 10, F.col("id") % 10
    return spark.range(1000).select(
        F.col("id").alias("site_id"),
        *[(index * step + shift).alias(axis)
          for axis, index, step, shift in zip("xyz", (i, j, k), LATTICE_SPACING, LATTICE_SHIFT)],
    )


def boxes_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = 1 + F.col("s_suppkey") * 1e-4
    low = {f"{axis}lo": F.lit(0.0) for axis in "xyz"}
    high = {f"{axis}hi": F.lit(edge) * factor for axis, edge in zip("xyz", BOX)}
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("snapshot_id"), *[c.alias(n) for n, c in {**low, **high}.items()])


def reference_box() -> dict[str, float]:
    return {"xlo": 0.0, "xhi": BOX[0], "ylo": 0.0, "yhi": BOX[1], "zlo": 0.0, "zhi": BOX[2]}


def feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor features of :func:`cloud_lineitem` with a count-based target and some missing values."""

    def build() -> DataFrame:
        features = snapshot_features(cloud_lineitem(spark, sf_dir), mode="extractor")
        return features.select(
            F.col("snapshot_id").alias("file"),
            *[c for c in features.columns if c not in ("snapshot_id", "rdf_kurtosis", "num_points")],
            F.when(F.col("snapshot_id") % 7 != 0, F.col("rdf_kurtosis")).alias("rdf_kurtosis"),
            (F.lit(float(TOTAL_ATOMS)) - F.col("num_points")).alias("n_vacancies"),
        )

    return _once(spark, ("feature_set", sf_dir), build)


def stand_in_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeatable predictions around the target, every fifth snapshot in the test split."""
    return feature_set(spark, sf_dir).select(
        F.col("file").alias("snapshot_id"),
        F.col("n_vacancies").alias("label"),
        (F.col("n_vacancies") + (F.col("file") * 37) % 11 - 5).alias("prediction"),
        F.when(F.col("file") % 5 == 0, "test").otherwise("train").alias("split"),
    )


def importance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in importances: share of the absolute correlation with the target."""
    features = [c for c in feature_set(spark, sf_dir).columns if c not in ("file", "n_vacancies")]
    row = feature_set(spark, sf_dir).agg(*[
        F.abs(F.coalesce(F.nanvl(F.corr(c, "n_vacancies"), F.lit(0.0)), F.lit(0.0))).alias(c) for c in features])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("weight")) for c in features])).alias("_f")).select("_f.*")
    total = row.select(sum((F.col(c) for c in features), F.lit(0.0))).first()[0]
    return long.select("feature", F.round(F.col("weight") / total, 9).alias("importance"))


def _write_folders(lines: DataFrame, keys: list[str], path: str) -> None:
    """Write ``value`` of ``lines(keys, value)``, sorted by ``keys`` inside its partitions, as one text file per key, in
    the folders of ``partitionBy(keys)``.

    Spark's writer makes every folder and file in several calls of its file system, on a local one with a process for each
    permission; with a file per snapshot that takes longer than the rows. Stores that Arrow does not know keep it.
    """
    try:
        system, root = pa.fs.FileSystem.from_uri(re.sub(r"^file:/*", "/", path))
    except pa.ArrowException:
        lines.write.partitionBy(*keys).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out, written = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(k).to_pylist() for k in keys]
            differs = np.zeros(batch.num_rows, bool)
            differs[0] = True
            for column in names:
                differs[1:] |= np.array([a != b for a, b in zip(column, column[1:])], bool)
            starts = np.flatnonzero(differs)
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(column[start] for column in names)
                if key != current:
                    if out is not None:
                        out.close()
                    folder = "/".join([root, *[
                        f"{k}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for k, v in zip(keys, key)]])
                    system.create_dir(folder, recursive=True)
                    current, out, written = key, system.open_output_stream(f"{folder}/part-00000.txt"), written + 1
                text = "\n".join(batch.column("value").slice(start, end - start).fill_null("").to_pylist())  # as Spark writes NULL
                out.write(f"{text}\n".encode())
        if out is not None:
            out.close()
        yield pa.record_batch({"files": pa.array([written], pa.int64())})

    system.create_dir(root, recursive=True)
    lines.mapInArrow(write, "files long").agg(F.sum("files")).collect()


DUMP_NAME = r"snapshot_id=(\d+/piece=\d+)/"


def dump_text(spark: SparkSession, sf_dir: str) -> str:
    """Write :func:`cloud_lineitem` as dump files and return their directory.

    A snapshot is cut into pieces of about a million atoms, each a complete dump. Of the snapshots, id
    modulo 10 = 3 lack the z column, = 7 have a word among the numbers, = 9 have no atoms section.
    """
    key = (spark.sparkContext.applicationId, "dump_text", sf_dir)
    if key not in _paths:
        atoms = cloud_lineitem(spark, sf_dir).withColumn("piece", F.shiftright("atom_id", 20))
        kind = F.col("snapshot_id") % 10
        z = F.when(kind == 3, "").when((kind == 7) & (F.col("atom_id") % 100 == 5), " oops").otherwise(
            F.concat(F.lit(" "), F.col("z").cast("string")))
        body = atoms.filter(kind != 9).select(
            "snapshot_id", "piece", F.col("atom_id").alias("place"),
            F.concat(F.concat_ws(" ", (F.col("atom_id") + 1).cast("string"), F.lit("1"),
                                 F.col("x").cast("string"), F.col("y").cast("string")), z).alias("value"))
        pieces = atoms.groupBy("snapshot_id", "piece").count().join(boxes_supplier(spark, sf_dir), "snapshot_id")
        header = F.concat(F.lit("ITEM: ATOMS id type x y"), F.when(kind == 3, "").otherwise(" z"))
        lines = [F.lit("ITEM: TIMESTEP"), F.lit("0"), F.lit("ITEM: NUMBER OF ATOMS"), F.col("count").cast("string"),
                 F.lit("ITEM: BOX BOUNDS pp pp pp"),
                 *[F.concat_ws(" ", F.col(f"{a}lo").cast("string"), F.col(f"{a}hi").cast("string")) for a in "xyz"],
                 F.when(kind != 9, header)]
        heads = pieces.select("snapshot_id", "piece", F.posexplode(F.array(*lines)).alias("at", "value")).select(
            "snapshot_id", "piece", (F.col("at") - len(lines)).cast("long").alias("place"), "value"
        ).filter(F.col("value").isNotNull())
        path = staging_path(spark, "dumps")
        lines = heads.unionByName(body).repartition("snapshot_id", "piece").sortWithinPartitions("snapshot_id", "piece", "place")
        _write_folders(lines.drop("place"), ["snapshot_id", "piece"], path)
        _paths[key] = path
    return _paths[key]


FRAME_NAME = r"nation=(\d+/piece=\d+)/"


def frame_text(spark: SparkSession, sf_dir: str) -> str:
    """Write :func:`cloud_orders` as dump files of many frames and return their directory.

    A file holds the customers of one nation, 16,384 customer numbers to a piece, one frame each, also those without
    orders; boxes as in :func:`boxes_customer`, tilted for every eleventh customer.
    """
    key = (spark.sparkContext.applicationId, "frame_text", sf_dir)
    if key not in _paths:
        nations = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("snapshot_id"), F.col("c_nationkey").alias("nation"),
            F.shiftright("c_custkey", 14).alias("piece"))
        atoms = cloud_orders(spark, sf_dir)
        counts = atoms.groupBy("snapshot_id").count()
        boxes = nations.join(boxes_customer(spark, sf_dir), "snapshot_id").join(counts, "snapshot_id", "left")
        tilted = F.col("snapshot_id") % 11 == 0
        words = F.concat_ws(" ", *[F.when(F.col(f"p{a}"), "pp").otherwise("ff") for a in "xyz"])
        lines = [F.lit("ITEM: TIMESTEP"), F.col("snapshot_id").cast("string"), F.lit("ITEM: NUMBER OF ATOMS"),
                 F.coalesce("count", F.lit(0)).cast("string"),
                 F.concat(F.lit("ITEM: BOX BOUNDS "), F.when(tilted, "xy xz yz ").otherwise(""), words),
                 *[F.concat(F.col(f"{a}lo").cast("string"), F.lit(" "), F.col(f"{a}hi").cast("string"),
                            F.when(tilted, " 0.25").otherwise("")) for a in "xyz"],
                 F.lit("ITEM: ATOMS id type x y z")]
        heads = boxes.select("nation", "piece", "snapshot_id", F.posexplode(F.array(*lines)).alias("at", "value")).select(
            "nation", "piece", "snapshot_id", (F.col("at") - len(lines)).cast("long").alias("place"), "value")
        body = atoms.join(nations, "snapshot_id").select(
            "nation", "piece", "snapshot_id", F.col("atom_id").alias("place"),
            F.concat_ws(" ", (F.col("atom_id") + 1).cast("string"), F.lit("1"), *[F.col(a).cast("string") for a in "xyz"]
                        ).alias("value"))
        path = staging_path(spark, "frames")
        heads.unionByName(body).repartition("nation", "piece").sortWithinPartitions(
            "nation", "piece", "snapshot_id", "place").drop("snapshot_id", "place").write.partitionBy(
            "nation", "piece").text(path)
        _paths[key] = path
    return _paths[key]
