"""Random-forest regression on feature datasets: fit, score, out-of-fold check, persistence."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voidscope.operators.catalog import TARGET
from voidscope.operators.dataset import (
    FORBIDDEN,
    SEED,
    TEST_SIZE,
    fit_preprocessing,
    split,
    training_frame,
)
from voidscope.operators.evaluation import feature_category, regression_metrics
from voidscope.operators.forest import Trees, fit_trees, importances, load_trees, predict, save_trees
from voidscope.session import stage

# Forest size; the deepest tree.
NUM_TREES = 200
MAX_DEPTH = 30
MAX_BINS = 256
MODEL_TYPE = "RandomForest_Complete"


@dataclass(frozen=True)
class Forest:
    """Fitted preparation and trees with what is needed to score, explain and store them."""

    pipeline: PipelineModel
    trees: Trees
    feature_names: list[str]
    seed: int
    mode: str | None = None
    oof_r2: float | None = None


def _prepare(names: list[str], medians: dict[str, float], scaling: dict[str, tuple[float, float]]) -> SQLTransformer:
    """Imputation and scaling as one saved SELECT, fitted values written in."""
    scaled = ", ".join(
        f"(CAST(coalesce(nanvl(`{c}`, NULL), {medians[c]!r}D) AS DOUBLE) - {scaling[c][0]!r}D)"
        f" / {scaling[c][1]!r}D AS `scaled_{c}`"
        for c in names)
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


def fit_forest(
    train: DataFrame,
    names: list[str],
    num_trees: int = NUM_TREES,
    max_depth: int = MAX_DEPTH,
    max_bins: int = MAX_BINS,
    seed: int = SEED,
    mode: str | None = None,
) -> Forest:
    """Impute by training medians, scale, and grow the forest on the training rows."""
    medians, scaling = fit_preprocessing(train, names)
    names = [c for c in names if c in medians]
    prepare = _prepare(names, medians, scaling)
    assemble = VectorAssembler(inputCols=[f"scaled_{c}" for c in names], outputCol="features")
    pipeline = Pipeline(stages=[prepare, assemble]).fit(train)
    # a row is drawn by its name and content, wherever it is stored
    rows = pipeline.transform(train).select(
        F.xxhash64(F.col("file").cast("string") if "file" in train.columns else F.lit(0), F.col(TARGET), *names).alias("key"),
        F.col(TARGET).alias("label"), vector_to_array("features").alias("values"))
    return Forest(pipeline, fit_trees(rows, len(names), num_trees, max_depth, max_bins, seed), names, seed, mode)


def score(forest: Forest, features: DataFrame, mode: str | None = None) -> DataFrame:
    """Predictions for feature rows; refuses features made in another mode than the model's."""
    if mode and forest.mode and mode != forest.mode:
        raise ValueError(f"the model was trained on {forest.mode} features, not {mode}")
    kept = [c for c in features.columns if c not in forest.feature_names]
    # the number is unique in the written table, which both uses of it read
    rows = stage(forest.pipeline.transform(features).select(
        *kept, F.monotonically_increasing_id().alias("_row"), vector_to_array("features").alias("_values")), "to-score")
    found = predict(forest.trees, rows.select(F.col("_row").alias("key"), F.col("_values").alias("values")))
    return rows.join(found.withColumnRenamed("key", "_row"), "_row").select(*kept, "prediction")


def importance(forest: Forest, spark: SparkSession) -> DataFrame:
    """Importance per feature, names in assembler order."""
    rows = list(zip(forest.feature_names, importances(forest.trees)))
    return feature_category(spark.createDataFrame(rows, "feature string, importance double"))


def train(dataset: DataFrame, test_size: float = TEST_SIZE, seed: int = SEED, folds: int = 0, **forest_options):
    """Split, fit and score: the forest and ``snapshot_id, label, prediction, split`` rows.

    With ``folds`` the forest carries the out-of-fold R² of its training rows, which takes as many more fits.
    """
    prepared = stage(training_frame(dataset), "training")
    names = [c for c in prepared.columns if c not in ("file", TARGET)]
    marked = stage(split(prepared, test_size, seed), "split")
    learning = marked.filter(~F.col("is_test"))
    forest = fit_forest(learning, names, seed=seed, **forest_options)
    if folds:
        held = out_of_fold(learning.drop("is_test"), folds, seed, **forest_options)
        forest = replace(forest, oof_r2=oof_r2(held).first()["oof_r2"])
    predictions = score(forest, marked).select(
        F.col("file").alias("snapshot_id"), F.col(TARGET).alias("label"), "prediction",
        F.when(F.col("is_test"), "test").otherwise("train").alias("split"))
    return forest, predictions


def out_of_fold(dataset: DataFrame, folds: int = 5, seed: int = SEED, **forest_options) -> DataFrame:
    """Predictions of every row by a forest that has not seen it (hash folds)."""
    prepared = training_frame(dataset)
    names = [c for c in prepared.columns if c not in ("file", TARGET)]
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"fold{seed}:"), F.col("file").cast("string"))), 1, 8), 16, 10)
    marked = stage(prepared.withColumn("fold", (digits.cast("long") % folds).cast("int")), "folds")
    parts = None
    for fold in range(folds):
        held = marked.filter(F.col("fold") == fold)
        if held.isEmpty():
            continue
        forest = fit_forest(marked.filter(F.col("fold") != fold), names, seed=seed, **forest_options)
        scored = score(forest, held).select(
            F.col("file").alias("snapshot_id"), F.col(TARGET).alias("label"), "prediction", "fold")
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def oof_r2(predictions: DataFrame) -> DataFrame:
    """R² of out-of-fold predictions; stands in for the out-of-bag score Spark does not expose."""
    metrics = regression_metrics(predictions.withColumn("split", F.lit("oof")))
    return metrics.select(F.col("r2").alias("oof_r2"))


def model_info(forest: Forest, spark: SparkSession, metrics: DataFrame | None = None) -> DataFrame:
    """One metadata row."""
    rows = [] if metrics is None else [r.asDict() for r in metrics.collect()]  # one row per split
    return spark.createDataFrame(
        [(MODEL_TYPE, forest.trees.count, len(forest.feature_names), forest.feature_names, FORBIDDEN,
          forest.seed, forest.mode, forest.oof_r2, json.dumps(rows, sort_keys=True))],
        "model_type string, n_estimators int, n_features int, feature_names array<string>, "
        "forbidden_features array<string>, random_state int, mode string, oof_r2 double, metrics string")


def write_importance(ranked: DataFrame, path: str) -> None:
    """Importances, largest first over the files in the order of their names, below ``path``."""
    ranked.orderBy(F.desc("importance"), "feature").write.mode("overwrite").option("header", True).csv(f"{path}/feature_importance")


def save_model(forest: Forest, path: str, spark: SparkSession, metrics: DataFrame | None = None) -> None:
    """Store the pipeline, the trees, their metadata, importances and feature names below ``path``."""
    forest.pipeline.write().overwrite().save(f"{path}/pipeline")
    save_trees(forest.trees, f"{path}/trees", spark)
    model_info(forest, spark, metrics).write.mode("overwrite").json(f"{path}/metadata")
    write_importance(importance(forest, spark), path)
    names = spark.createDataFrame([(n,) for n in forest.feature_names], "value string").coalesce(1)
    names.write.mode("overwrite").text(f"{path}/feature_names")


def load_model(path: str, spark: SparkSession) -> Forest:
    schema = ("n_features int, feature_names array<string>, random_state int, mode string, oof_r2 double")
    info = spark.read.schema(schema).json(f"{path}/metadata").first()
    return Forest(PipelineModel.load(f"{path}/pipeline"), load_trees(f"{path}/trees", spark), list(info["feature_names"]), info["random_state"],
                  info["mode"], info["oof_r2"])
