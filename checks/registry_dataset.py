"""Registered dataset, evaluation, model and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from checks.fixtures import (
    DUMP_NAME,
    FRAME_NAME,
    TOTAL_ATOMS,
    cloud_lineitem,
    dump_text,
    feature_set,
    frame_text,
    importance_table,
    stand_in_predictions,
)
from checks.registry_defects import PROBE_RADIUS, analysis
from checks.registry_features import rounded
from voidscope.functions.ranking import number_rows
from voidscope.operators import catalog, dataset, evaluation
from voidscope.plans import model
from voidscope.plans.workflows import extract_dataset
from voidscope.session import staging_path
from voidscope.sources import datasets, dumps

TREES = 50  # per fold of the out-of-fold check


def _marked(spark, sf_dir):
    return dataset.split(dataset.training_frame(feature_set(spark, sf_dir)))


def _impute(spark, sf_dir):
    marked = _marked(spark, sf_dir)
    medians = dataset.fit_medians(marked.filter("not is_test"), catalog.FEATURES)
    return rounded(dataset.impute(marked, medians).drop("n_vacancies"), moi_principal_3=4)


def _scale(spark, sf_dir):
    marked = _marked(spark, sf_dir)
    medians, scaling = dataset.fit_preprocessing(marked.filter("not is_test"), catalog.FEATURES)
    return rounded(dataset.standard_scale(dataset.impute(marked, medians), scaling).drop("n_vacancies"), 5)


def _csv(spark, sf_dir):
    path = staging_path(spark, "feature-csv")
    datasets.write_features(dataset.feature_dataset(feature_set(spark, sf_dir)), path, "csv")
    return rounded(datasets.read_features_csv(spark, path, datasets.feature_schema(StringType())), moi_principal_3=4)


def _csv_sorted(spark, sf_dir):
    """Position of every row in the order in which the files of a sorted write are listed and read."""
    path = staging_path(spark, "feature-csv-sorted")
    datasets.write_features(
        dataset.feature_dataset(feature_set(spark, sf_dir)).repartition(7), path, "csv", ordered=True)
    rows = spark.read.option("header", True).csv(path).select(
        F.col("file").cast("long").alias("file"), F.col("_metadata.file_name").alias("part"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return number_rows(rows, [], ["part", "block", "at"], "position").select("file", "position")


def _points_file(spark, sf_dir):
    path = staging_path(spark, "points")
    datasets.write_points(cloud_lineitem(spark, sf_dir), path)
    return datasets.read_points(spark, path)


def _importance_files(spark, sf_dir):
    """The importance sink read back in the order of its files."""
    path = staging_path(spark, "importance")
    model.write_importance(importance_table(spark, sf_dir), path)
    rows = spark.read.option("header", True).csv(f"{path}/feature_importance").select(
        "feature", F.col("importance").cast("double").alias("importance"), F.col("_metadata.file_name").alias("part"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return rounded(number_rows(rows, [], ["part", "block", "at"], "position").select("feature", "importance", "position"))


def _frames(spark, sf_dir) -> dumps.DumpScan:
    return dumps.scan_dumps(spark, frame_text(spark, sf_dir), name_pattern=FRAME_NAME, first_frame=False)


def _frame_status(spark, sf_dir):
    scan = _frames(spark, sf_dir)
    boxes = scan.boxes().select(F.col("snapshot_id").alias("file"), "declared_atoms", *[f"{a}hi" for a in "xyz"],
                                F.concat_ws(" ", "boundary").alias("boundary"))
    boxed = scan.boxed_status.select("file", F.col("status").alias("boxed"), F.col("num_atoms").alias("boxed_atoms"))
    return rounded(scan.status.drop("columns").join(boxed, "file").join(boxes, "file", "left"), 9)


def _scan(spark, sf_dir) -> dumps.DumpScan:
    return dumps.scan_dumps(spark, dump_text(spark, sf_dir), name_pattern=DUMP_NAME)


def _whole(pieces):
    """Piece rows back under their snapshot."""
    parts = F.split("snapshot_id", "/piece=")
    return pieces.withColumns({
        "atom_id": F.col("atom_id") + F.shiftleft(parts[1].cast("long"), 20),
        "snapshot_id": parts[0].cast("long"),
    })


def _dump_folders(spark, sf_dir):
    """Named by path: one task's files have one name in many folders."""
    status = dumps.scan_dumps(spark, f"{dump_text(spark, sf_dir)}/*/*/*").status
    return status.select(F.regexp_extract("file", r"snapshot_id=(\d+/piece=\d+)/", 1).alias("file"), "status", "num_atoms")


def _dump_scan(spark, sf_dir):
    atoms = _whole(_scan(spark, sf_dir).atoms())
    return atoms.withColumn("id", F.col("extra")["id"]).drop("extra")


def _dump_snapshots(spark, sf_dir):
    return _scan(spark, sf_dir).snapshots().withColumn("columns", F.concat_ws(" ", "columns"))


def _box_scan(spark, sf_dir):
    return rounded(_scan(spark, sf_dir).boxes().drop("boundary"), 9)


def _surface_features(spark, sf_dir):
    dataset_rows, _ = extract_dataset(
        _scan(spark, sf_dir), mode="extractor", probe_radius=PROBE_RADIUS, total_atoms=TOTAL_ATOMS, periodic=False)
    return rounded(dataset_rows, moi_principal_3=4)


def _forest_predictions(spark, sf_dir):
    return model.train(feature_set(spark, sf_dir), mode="extractor")[1]


def _forest_importance(spark, sf_dir):
    return model.importance(model.train(feature_set(spark, sf_dir), mode="extractor")[0], spark)


def _forest_reload(spark, sf_dir):
    forest, predictions = model.train(feature_set(spark, sf_dir), mode="extractor")
    path = staging_path(spark, "model")
    model.save_model(forest, path, spark, evaluation.regression_metrics(predictions))
    again = model.load_model(path, spark)
    features = dataset.training_frame(feature_set(spark, sf_dir)).drop("n_vacancies")
    return model.score(again, features, mode="extractor").withColumnRenamed("file", "snapshot_id")


def _forest_info(spark, sf_dir):
    forest, predictions = model.train(feature_set(spark, sf_dir), mode="extractor")
    return model.model_info(forest, spark, evaluation.regression_metrics(predictions))


def _predictions(operator):
    return lambda s, d: operator(stand_in_predictions(s, d))


QUERIES = {
    "vacancy_target": lambda s, d: dataset.vacancy_target(cloud_lineitem(s, d)),
    "missing_count": lambda s, d: dataset.missing_count(feature_set(s, d)),
    "training_frame": lambda s, d: rounded(dataset.training_frame(feature_set(s, d)), moi_principal_3=4),
    "dataset_stats": lambda s, d: rounded(dataset.dataset_stats(feature_set(s, d))),
    "feature_catalog": lambda s, d: rounded(catalog.catalog_statistics(feature_set(s, d)), 4),
    "feature_csv": _csv,
    "feature_csv_sorted": _csv_sorted,
    "points_file": _points_file,
    "importance_files": _importance_files,
    "dump_frames": lambda s, d: _frames(s, d).atoms().drop("extra"),
    "dump_frames_status": _frame_status,
    "train_test_split": lambda s, d: _marked(s, d).select("file", "is_test"),
    "impute_median": _impute,
    "standard_scale": _scale,
    "regression_metrics": lambda s, d: rounded(evaluation.regression_metrics(stand_in_predictions(s, d))),
    "overfit_flag": lambda s, d: rounded(
        evaluation.overfit_flag(evaluation.regression_metrics(stand_in_predictions(s, d)))),
    "residuals": _predictions(evaluation.residuals),
    "residual_histogram": lambda s, d: rounded(evaluation.residual_histogram(stand_in_predictions(s, d))),
    "qq_points": lambda s, d: rounded(evaluation.qq_points(stand_in_predictions(s, d))),
    "qq_line": lambda s, d: rounded(evaluation.qq_line(evaluation.qq_points(stand_in_predictions(s, d)))),
    "feature_category": lambda s, d: rounded(evaluation.feature_category(importance_table(s, d))),
    "importance_topn": lambda s, d: rounded(evaluation.importance_topn(importance_table(s, d), 10)),
    "importance_by_category": lambda s, d: rounded(evaluation.importance_by_category(importance_table(s, d))),
    "method_comparison": lambda s, d: rounded(
        evaluation.method_comparison(stand_in_predictions(s, d), analysis(s, d).summary())),
    "dump_scan": _dump_scan,
    "dump_snapshots": _dump_snapshots,
    "box_scan": _box_scan,
    "boxed_status": lambda s, d: _scan(s, d).boxed_status,
    "dump_folders": _dump_folders,
    "boxed_scan": lambda s, d: _whole(_scan(s, d).boxed_atoms()),
    "surface_features": _surface_features,
    "run_summary": lambda s, d: dumps.run_summary(_scan(s, d).status),
    "failed_files": lambda s, d: dumps.failed_files(_scan(s, d).status),
    "forest_predictions": _forest_predictions,
    "forest_importance": _forest_importance,
    "forest_reload": _forest_reload,
    "forest_info": _forest_info,
    "oof_r2": lambda s, d: model.oof_r2(model.out_of_fold(feature_set(s, d), num_trees=TREES)),
}
