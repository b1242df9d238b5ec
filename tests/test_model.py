"""Dataset preparation, metrics and the forest."""

import math

import numpy as np
import pytest

from voidscope.operators import dataset, evaluation
from voidscope.plans import model


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(160):
        a, b, c = rng.normal(size=3)
        rows.append((f"f{i:03d}", float(a), float(b) if i % 9 else None, float(c) if i % 13 else float("nan"), 3.0,
                     None, "text", 5, float(10 * a + 3 * b + 50)))
    return spark.createDataFrame(
        rows, "file string, grid_a double, hull_b double, rdf_c double, flat double, hollow double, "
              "note string, num_points int, n_vacancies double")


def test_training_columns(table):
    assert dataset.training_columns(table) == ["grid_a", "hull_b", "rdf_c", "flat"]
    row = dataset.missing_count(table).first()
    assert row["missing_cells"] == 18 + 13 and row["samples"] == 160
    with pytest.raises(ValueError):
        dataset.training_columns(table.drop("n_vacancies"))


def test_split(table):
    marked = dataset.split(table, 0.2, 42)
    tests = {r["file"] for r in marked.filter("is_test").collect()}
    assert len(tests) == math.ceil(0.2 * 160)
    again = {r["file"] for r in dataset.split(table.repartition(5), 0.2, 42).filter("is_test").collect()}
    assert tests == again != {r["file"] for r in dataset.split(table, 0.2, 7).filter("is_test").collect()}


def test_preprocessing(table):
    frame = dataset.training_frame(table)
    medians, scaling = dataset.fit_preprocessing(frame, ["grid_a", "hull_b", "rdf_c", "flat"])
    rows = frame.collect()
    for name in medians:
        values = np.array([r[name] for r in rows if r[name] is not None])
        assert medians[name] == pytest.approx(np.median(values))
        filled = np.r_[values, np.full(len(rows) - len(values), medians[name])]
        assert scaling[name][0] == pytest.approx(filled.mean())
        assert scaling[name][1] == pytest.approx(filled.std() or 1.0)
    scaled = dataset.standard_scale(dataset.impute(frame, medians), scaling)
    assert all(r["flat"] == 0 for r in scaled.collect())


def _predictions(spark, rows):
    return spark.createDataFrame(rows, "snapshot_id long, label double, prediction double, split string")


def test_metrics(spark):
    rows = [(i, float(y), float(p), "train" if i < 4 else "test")
            for i, (y, p) in enumerate([(1, 1.5), (2, 2), (4, 3), (8, 9), (5, 5), (5, 7)])]
    got = {r["split"]: r for r in evaluation.regression_metrics(_predictions(spark, rows)).collect()}
    y, p = np.array([1, 2, 4, 8.0]), np.array([1.5, 2, 3, 9])
    assert got["train"]["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got["train"]["mae"] == pytest.approx(np.abs(y - p).mean())
    assert got["train"]["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["train"]["mape"] == pytest.approx(np.abs((y - p) / (y + 1e-10)).mean() * 100)
    assert got["test"]["r2"] == 0.0  # constant target
    flag = evaluation.overfit_flag(evaluation.regression_metrics(_predictions(spark, rows))).first()
    assert flag["overfit"] and flag["overfit_percent"] == pytest.approx(100)


def test_histogram_and_qq(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(v), 0.0, "test") for i, v in enumerate(rng.normal(size=101))]
    predictions = _predictions(spark, rows)
    counts, edges = np.histogram([r[1] for r in rows], bins=30)
    got = evaluation.residual_histogram(predictions).orderBy("bin").collect()
    assert [r["n"] for r in got] == list(counts)
    assert np.allclose([r["low"] for r in got], edges[:-1])
    points = evaluation.qq_points(predictions).orderBy("position").collect()
    assert [r["ordered"] for r in points] == sorted(r[1] for r in rows)
    assert points[50]["theoretical"] == pytest.approx(0, abs=1e-12)
    assert points[0]["theoretical"] == pytest.approx(-points[100]["theoretical"])
    same = evaluation.residual_histogram(_predictions(spark, [(0, 1.0, 1.0, "test")])).collect()
    assert len(same) == 30 and sum(r["n"] for r in same) == 1


def test_importance_tables(spark):
    table = spark.createDataFrame(
        [("grid_entropy", 0.4), ("hull_area", 0.1), ("moi_principal_3", 0.2), ("rdf_mean", 0.05),
         ("entropy_spatial", 0.1), ("ms_bandwidth", 0.05), ("total_energy", 0.05), ("other", 0.05)],
        "feature string, importance double")
    labels = {r["feature"]: r["category"] for r in evaluation.feature_category(table).collect()}
    assert labels["grid_entropy"].endswith("Grid3D") and labels["entropy_spatial"].endswith("Entropía")
    assert labels["total_energy"].endswith("Energía") and labels["other"].endswith("Otro")
    top = evaluation.importance_topn(table, 3).orderBy("position").collect()
    assert [r["feature"] for r in top] == ["grid_entropy", "moi_principal_3", "entropy_spatial"]
    assert top[-1]["cumulative"] == pytest.approx(0.7)
    assert evaluation.importance_by_category(table).first()["importance"] == pytest.approx(0.4)


def test_method_comparison(spark):
    predictions = _predictions(spark, [(1, 0.0, 10.2, "test"), (2, 0.0, 11.0, "test"), (3, 0.0, 20.0, "test"),
                                       (4, 0.0, 3.0, "test")])
    summary = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 0)], "snapshot_id long, n_vacancies long")
    rows = {r["snapshot_id"]: r for r in evaluation.method_comparison(predictions, summary).collect()}
    assert [rows[i]["verdict"] for i in (1, 2, 3, 4)] == [
        "excellent", "good", "significant difference", "excellent"]
    assert rows[4]["relative_percent"] == 0 and rows[2]["difference"] == pytest.approx(1.0)


def test_forest_round_trip(spark, table, tmp_path):
    forest, predictions = model.train(table, num_trees=30, mode="training")
    metrics = evaluation.regression_metrics(predictions)
    scores = {r["split"]: r["r2"] for r in metrics.collect()}
    assert scores["train"] > 0.9 and scores["test"] > 0.5
    ranked = model.importance(forest, spark).orderBy("importance", ascending=False).collect()
    assert ranked[0]["feature"] == "grid_a" and sum(r["importance"] for r in ranked) == pytest.approx(1)
    path = str(tmp_path / "model")
    model.save_model(forest, path, spark, metrics)
    loaded = model.load_model(path, spark)
    assert loaded.feature_names == forest.feature_names and loaded.mode == "training"
    features = table.drop("n_vacancies")
    first = {r["file"]: r["prediction"] for r in model.score(forest, features).collect()}
    second = {r["file"]: r["prediction"] for r in model.score(loaded, features).collect()}
    assert first == second and len(first) == 160
    with pytest.raises(ValueError):
        model.score(loaded, features, mode="extractor")
    info = model.model_info(forest, spark, metrics).first()
    assert info["n_estimators"] == 30 and info["n_features"] == 4 and "rmse" in info["metrics"]
    folds = model.out_of_fold(table, folds=3, num_trees=10)
    assert folds.count() == 160 and 0.3 < model.oof_r2(folds).first()["oof_r2"] <= 1
