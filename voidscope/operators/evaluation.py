"""Regression metrics, residual diagnostics, importance tables and the method comparison.

Predictions come as ``snapshot_id, label, prediction, split``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voidscope.functions.ranking import number_rows

MAPE_EPSILON = 1e-10
OVERFIT_LIMIT = 10.0
HISTOGRAM_BINS = 30

# Category label of a feature by the first matching part of its name.
CATEGORY_LABELS = [
    (("occupancy", "grid", "fragment"), "📊 Grid3D"),
    (("hull",), "🔷 ConvexHull"),
    (("moi",), "⚖️ Momentos"),
    (("rdf",), "📍 Radial"),
    (("entropy",), "🌀 Entropía"),
    (("bandwidth",), "🔍 Bandwidth"),
    (("energy",), "⚡ Energía"),
]
OTHER_CATEGORY = "❓ Otro"

# Agreement limits in percent and their verdicts.
VERDICTS = ((5.0, "excellent"), (15.0, "good"))
OTHER_VERDICT = "significant difference"

# Wichura's AS 241 coefficients (numerator, denominator), low order first.
CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
     3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """RMSE, MAE, R² and MAPE (percent) per split."""
    error = F.col("label") - F.col("prediction")
    sums = predictions.groupBy("split").agg(
        F.sum(error * error).alias("_sse"), F.avg(error * error).alias("_mse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.var_pop("label") * F.count("label")).alias("_sst"),
        (F.avg(F.abs(error / (F.col("label") + MAPE_EPSILON))) * 100).alias("mape"),
    )
    flat = F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)
    return sums.select(
        "split", F.sqrt("_mse").alias("rmse"), "mae",
        F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).otherwise(flat).alias("r2"), "mape")


def overfit_flag(metrics: DataFrame) -> DataFrame:
    """Relative drop of R² from train to test in percent, flagged above 10."""
    wide = metrics.agg(
        F.max(F.when(F.col("split") == "train", F.col("r2"))).alias("r2_train"),
        F.max(F.when(F.col("split") == "test", F.col("r2"))).alias("r2_test"))
    drop = (F.col("r2_train") - F.col("r2_test")) / F.col("r2_train") * 100
    return wide.withColumn("overfit_percent", F.when(F.col("r2_train") > 0, drop).otherwise(0.0)).withColumn(
        "overfit", F.col("overfit_percent") > OVERFIT_LIMIT)


def residuals(predictions: DataFrame) -> DataFrame:
    """Residual and absolute error next to each prediction."""
    residual = F.col("label") - F.col("prediction")
    return predictions.select("snapshot_id", "split", "label", "prediction",
                              residual.alias("residual"), F.abs(residual).alias("absolute_error"))


def residual_histogram(predictions: DataFrame, split: str = "test", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts of residuals in equal bins over their range, empty bins included; the last one is closed."""
    values = residuals(predictions.filter(F.col("split") == split)).select("residual")
    lo, hi = values.agg(F.min("residual"), F.max("residual")).first()
    if lo is None:
        lo = hi = 0.0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.floor((F.col("residual") - lo) / F.lit(hi - lo) * bins)
    counts = values.groupBy(F.least(place, F.lit(bins - 1)).cast("long").alias("bin")).agg(
        F.count("*").alias("n"))
    return values.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select(
        F.col("bin").cast("int").alias("bin"), (F.lit(lo) + F.col("bin") * width).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _ratio(coefficients, x: Column) -> Column:
    top, bottom = (reduce(lambda s, c: s * x + F.lit(c), reversed(part[:-1]), F.lit(part[-1]))
                   for part in coefficients)
    return top / bottom


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function (AS 241)."""
    q = p - 0.5
    tail = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    outer = F.when(tail <= 5, _ratio(MIDDLE, tail - 1.6)).otherwise(_ratio(FAR, tail - 5))
    return F.when(F.abs(q) <= 0.425, q * _ratio(CENTRAL, 0.180625 - q * q)).otherwise(
        F.when(q < 0, -outer).otherwise(outer))


def qq_points(predictions: DataFrame, split: str = "test") -> DataFrame:
    """Ordered residuals against normal quantiles of Filliben's order-statistic medians."""
    values = residuals(predictions.filter(F.col("split") == split)).select("snapshot_id", "residual")
    ranked = number_rows(values, [], ["residual", "snapshot_id"], "position")
    total = F.lit(values.count()).cast("double")
    i = F.col("position") + 1
    top = F.pow(F.lit(0.5), 1 / total)
    median = F.when(i == total, top).when(i == 1, 1 - top).otherwise((i - 0.3175) / (total + 0.365))
    return ranked.select("snapshot_id", i.alias("position"), F.col("residual").alias("ordered"),
                         normal_quantile(median).alias("theoretical"))


def qq_line(points: DataFrame) -> DataFrame:
    """Least-squares line through the Q-Q points and its correlation."""
    return points.agg(
        F.regr_slope("ordered", "theoretical").alias("slope"),
        F.regr_intercept("ordered", "theoretical").alias("intercept"),
        F.corr("ordered", "theoretical").alias("r"))


def category_of(feature: Column) -> Column:
    """Category label of a feature name; the first matching rule wins."""
    label = None
    for parts, name in CATEGORY_LABELS:
        hit = reduce(lambda a, b: a | b, [feature.contains(p) for p in parts])
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(OTHER_CATEGORY)


def feature_category(importance: DataFrame) -> DataFrame:
    return importance.withColumn("category", category_of(F.col("feature")))


def importance_topn(importance: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most important features with rank and running sum."""
    top = feature_category(importance).orderBy(F.desc("importance"), "feature").limit(n)
    order = Window.orderBy(F.desc("importance"), "feature")  # over n rows
    return top.select(
        F.row_number().over(order).alias("position"), "feature", "category", "importance",
        F.sum("importance").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def importance_by_category(importance: DataFrame) -> DataFrame:
    return feature_category(importance).groupBy("category").agg(
        F.sum("importance").alias("importance"), F.count("*").alias("features")).orderBy(F.desc("importance"))


def method_comparison(predictions: DataFrame, ws_summary: DataFrame) -> DataFrame:
    """Learned against geometric vacancy counts per snapshot, with a verdict on the relative difference.

    A snapshot with only one of the two counts keeps its row, without difference and verdict.
    """
    joined = predictions.select("snapshot_id", F.col("prediction").alias("ml_vacancies")).join(
        ws_summary.select("snapshot_id", F.col("n_vacancies").alias("ws_vacancies")), "snapshot_id", "full")
    difference = F.col("ml_vacancies") - F.col("ws_vacancies")
    relative = F.when(F.col("ws_vacancies") > 0, difference / F.col("ws_vacancies") * 100).when(difference.isNotNull(), 0.0)
    compared = joined.withColumns({"difference": difference, "relative_percent": relative})
    verdict = None
    for limit, name in VERDICTS:
        close = F.abs("relative_percent") < limit
        verdict = F.when(close, name) if verdict is None else verdict.when(close, name)
    return compared.withColumn("verdict", verdict.when(F.col("relative_percent").isNotNull(), OTHER_VERDICT))
