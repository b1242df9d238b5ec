"""DuckDB text for dataset, evaluation, importance and source queries."""

from __future__ import annotations

from checks.oracle_defects import BOXES, NEAR, OCCUPIED, ORDERED, SITES, SURFACE, WRAPPED, assigned
from checks.oracle_features import CLOUD, GRID_COLUMNS, feature_parts, feature_set, rounded, with_
from voidscope.operators.catalog import CATEGORIES, FEATURES
from voidscope.operators.evaluation import CENTRAL, FAR, MIDDLE

# Fixed values, written out here so that the texts do not depend on the package they check.
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
VERDICTS = ((5.0, "excellent"), (15.0, "good"))
OTHER_VERDICT = "significant difference"

COUNTED = """
feature_set AS (SELECT snapshot_id AS file, CAST(700 - count(*) AS DOUBLE) AS n_vacancies
                FROM cloud GROUP BY snapshot_id)"""

PREDICTIONS = """
predictions AS (
  SELECT file AS snapshot_id, n_vacancies AS label, n_vacancies + (file * 37) % 11 - 5 AS prediction,
         CASE WHEN file % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM feature_set)"""

METRICS = """
metrics AS (
  SELECT split, sqrt(avg(power(label - prediction, 2))) AS rmse, avg(abs(label - prediction)) AS mae,
         1 - sum(power(label - prediction, 2)) / sum(power(label - mean, 2)) AS r2,
         avg(abs((label - prediction) / (label + 1e-10))) * 100 AS mape
  FROM predictions JOIN (SELECT split, avg(label) AS mean FROM predictions GROUP BY split) USING (split)
  GROUP BY split)"""

SPLIT = """
marked AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(file AS VARCHAR)))
            <= ceil(0.2 * count(*) OVER ()) AS is_test FROM feature_set)"""

_MEDIANS = "medians AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in FEATURES) + \
    " FROM marked WHERE NOT is_test)"
_IMPUTED = "imputed AS (SELECT file, is_test, " + ", ".join(
    f"coalesce({c}, m_{c}) AS {c}" for c in FEATURES) + " FROM marked, medians)"
_SCALING = "scaling AS (SELECT " + ", ".join(
    f"avg({c}) AS a_{c}, CASE WHEN min({c}) = max({c}) THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
    for c in FEATURES) + " FROM imputed WHERE NOT is_test)"
_SCALED = "scaled AS (SELECT file, is_test, " + ", ".join(
    f"({c} - a_{c}) / s_{c} AS {c}" for c in FEATURES) + " FROM imputed, scaling)"

_WEIGHTS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(abs(CASE WHEN isnan(r) THEN 0 ELSE r END), 0) AS weight "
    f"FROM (SELECT corr({c}, n_vacancies) AS r FROM feature_set)" for c in FEATURES)
IMPORTANCE = f"""
weights AS ({_WEIGHTS}),
importance AS (SELECT feature, round(weight / (SELECT sum(weight) FROM weights), 9) AS importance FROM weights)"""

CATEGORY = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(feature, '{p}')" for p in parts) + f" THEN '{name}'"
    for parts, name in CATEGORY_LABELS) + f" ELSE '{OTHER_CATEGORY}' END"

_CATALOG = "catalog(feature, category, ordinal) AS (VALUES " + ", ".join(
    f"('{name}', '{group}', {ordinal})" for ordinal, (name, group) in enumerate(
        (name, group) for group, names in CATEGORIES.items() for name in names)) + ")"
_RANGES = "ranges AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS filled, min({c}) AS low, max({c}) AS high FROM feature_set"
    for c in [*FEATURES, "n_vacancies"]) + ")"


def _poly(part, x: str) -> str:
    text = repr(part[-1]) + "::DOUBLE"
    for c in reversed(part[:-1]):
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def _ratio(coefficients, x: str) -> str:
    return f"{_poly(coefficients[0], x)} / {_poly(coefficients[1], x)}"


_QQ = f"""
residuals AS (SELECT snapshot_id, label - prediction AS residual FROM predictions WHERE split = 'test'),
ranked AS (
  SELECT snapshot_id, residual, row_number() OVER (ORDER BY residual, snapshot_id) AS i,
         CAST(count(*) OVER () AS DOUBLE) AS n FROM residuals),
placed AS (
  SELECT *, CASE WHEN i = n THEN power(0.5, 1 / n) WHEN i = 1 THEN 1 - power(0.5, 1 / n)
                 ELSE (i - 0.3175) / (n + 0.365) END AS p FROM ranked),
tails AS (SELECT *, p - 0.5 AS q, sqrt(-ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END)) AS t FROM placed),
qq AS (
  SELECT snapshot_id, i AS position, residual AS ordered,
         CASE WHEN abs(q) <= 0.425 THEN q * {_ratio(CENTRAL, "(0.180625 - q * q)")}
              ELSE sign(q) * CASE WHEN t <= 5 THEN {_ratio(MIDDLE, "(t - 1.6)")}
                                  ELSE {_ratio(FAR, "(t - 5)")} END END AS theoretical
  FROM tails)"""

_VERDICT = "CASE " + " ".join(
    f"WHEN abs(relative_percent) < {limit} THEN '{name}'" for limit, name in VERDICTS) + \
    f" ELSE '{OTHER_VERDICT}' END"

_DUMPED = """
pieces AS (
  SELECT snapshot_id, atom_id >> 20 AS piece, count(*) AS n,
         max(CASE WHEN atom_id % 100 = 5 THEN 1 ELSE 0 END) AS worded
  FROM cloud GROUP BY ALL),
dumped AS (
  SELECT CAST(snapshot_id AS VARCHAR) || '/piece=' || CAST(piece AS VARCHAR) AS file, snapshot_id, n,
         CASE WHEN snapshot_id % 10 = 9 THEN 'no atoms section'
              WHEN snapshot_id % 10 = 3 THEN 'missing x, y or z'
              WHEN snapshot_id % 10 = 7 AND worded = 1 THEN 'bad value'
              ELSE 'ok' END AS status
  FROM pieces)"""

_FEATURED = feature_set()

# the same texts over the whole cloud, then everything else over the surface of the good dumps
_WHOLE = [text.replace("cloud", "every") for text in (CLOUD, _DUMPED, NEAR, SURFACE)]
_SURFACE_CLOUD = """
cloud AS (
  SELECT * FROM every SEMI JOIN surface USING (snapshot_id, atom_id)
  SEMI JOIN (SELECT snapshot_id FROM dumped WHERE status = 'ok') USING (snapshot_id))"""

FRAMES = """
frames AS (
  SELECT c_custkey, c_nationkey || '/piece=' || (c_custkey // 16384) || '#' ||
         (row_number() OVER (PARTITION BY c_nationkey, c_custkey // 16384 ORDER BY c_custkey) - 1) AS snapshot_id,
         round(3 + c_nationkey * 0.2::DOUBLE, 9) AS xhi, round(4 + c_custkey % 5 * 0.5::DOUBLE, 9) AS yhi,
         5::DOUBLE AS zhi, c_custkey % 11 = 0 AS tilted,
         CASE WHEN c_custkey % 2 = 0 THEN 'pp ' ELSE 'ff ' END || CASE WHEN c_custkey % 3 = 0 THEN 'pp ' ELSE 'ff ' END ||
         CASE WHEN c_custkey // 2 % 2 = 0 THEN 'pp' ELSE 'ff' END AS boundary
  FROM customer)"""

ORACLES = {
    "points_file": with_([CLOUD], "SELECT snapshot_id, atom_id, x, y, z FROM cloud"),
    "importance_files": with_([*_FEATURED, IMPORTANCE], """
SELECT feature, round(importance, 6) AS importance, row_number() OVER (ORDER BY importance DESC, feature) - 1 AS position
FROM importance"""),
    "feature_csv_sorted": with_([CLOUD, COUNTED], """
SELECT file, row_number() OVER (ORDER BY file) - 1 AS position FROM feature_set"""),
    "dump_frames": with_([ORDERED, FRAMES], """
SELECT f.snapshot_id, atom_id, x, y, z FROM cloud c JOIN frames f ON c.snapshot_id = f.c_custkey"""),
    "dump_frames_status": with_([ORDERED, FRAMES], """
SELECT f.snapshot_id AS file, 'ok' AS status, CAST(count(atom_id) AS BIGINT) AS num_atoms,
       CASE WHEN any_value(tilted) THEN 'tilted box' ELSE 'ok' END AS boxed,
       CAST(CASE WHEN any_value(tilted) THEN 0 ELSE count(atom_id) END AS BIGINT) AS boxed_atoms,
       CASE WHEN NOT any_value(tilted) THEN CAST(count(atom_id) AS BIGINT) END AS declared_atoms,
       CASE WHEN NOT any_value(tilted) THEN any_value(xhi) END AS xhi,
       CASE WHEN NOT any_value(tilted) THEN any_value(yhi) END AS yhi,
       CASE WHEN NOT any_value(tilted) THEN any_value(zhi) END AS zhi,
       CASE WHEN NOT any_value(tilted) THEN any_value(boundary) END AS boundary
FROM frames f LEFT JOIN cloud c ON c.snapshot_id = f.c_custkey GROUP BY f.snapshot_id"""),
    "vacancy_target": with_([CLOUD], """
SELECT snapshot_id, CAST(16384 - count(*) AS DOUBLE) AS n_vacancies FROM cloud GROUP BY snapshot_id"""),
    "missing_count": with_(_FEATURED, "SELECT CAST(" + " + ".join(
        f"(count(*) - count({c}))" for c in FEATURES) + """ AS BIGINT) AS missing_cells, count(*) AS samples
FROM feature_set"""),
    "training_frame": with_(_FEATURED, f"""
SELECT file, {rounded(FEATURES, moi_principal_3=4)}, n_vacancies FROM feature_set"""),
    "dataset_stats": with_(feature_set(bandwidth=False), """
SELECT min(n_vacancies) AS vacancies_min, max(n_vacancies) AS vacancies_max,
       round(avg(n_vacancies), 6) AS vacancies_mean, round(stddev_samp(n_vacancies), 6) AS vacancies_std,
       min(occupancy_total) AS occupancy_total_min, max(occupancy_total) AS occupancy_total_max,
       min(occupancy_fraction) AS occupancy_fraction_min, max(occupancy_fraction) AS occupancy_fraction_max
FROM feature_set"""),
    "feature_catalog": with_([*_FEATURED, _CATALOG, _RANGES], """
SELECT feature, category, CAST(ordinal AS INTEGER) AS ordinal, filled, round(low, 4) AS low, round(high, 4) AS high
FROM catalog LEFT JOIN ranges USING (feature)"""),
    "feature_csv": with_(_FEATURED, f"""
SELECT CAST(file AS VARCHAR) AS file, {rounded(FEATURES, moi_principal_3=4)}, n_vacancies FROM feature_set"""),
    "train_test_split": with_([CLOUD, COUNTED, SPLIT], "SELECT file, is_test FROM marked"),
    "impute_median": with_([*_FEATURED, SPLIT, _MEDIANS, _IMPUTED], f"""
SELECT file, is_test, {rounded(FEATURES, moi_principal_3=4)} FROM imputed"""),
    "standard_scale": with_([*_FEATURED, SPLIT, _MEDIANS, _IMPUTED, _SCALING, _SCALED], f"""
SELECT file, is_test, {rounded(FEATURES, 5)} FROM scaled"""),
    "regression_metrics": with_([CLOUD, COUNTED, PREDICTIONS, METRICS], f"""
SELECT split, {rounded("rmse, mae, r2, mape")} FROM metrics"""),
    "overfit_flag": with_([CLOUD, COUNTED, PREDICTIONS, METRICS], """
SELECT round(a, 6) AS r2_train, round(b, 6) AS r2_test,
       round(CASE WHEN a > 0 THEN (a - b) / a * 100 ELSE 0 END, 6) AS overfit_percent,
       CASE WHEN a > 0 THEN (a - b) / a * 100 ELSE 0 END > 10 AS overfit
FROM (SELECT max(CASE WHEN split = 'train' THEN r2 END) AS a, max(CASE WHEN split = 'test' THEN r2 END) AS b
      FROM metrics)"""),
    "residuals": with_([CLOUD, COUNTED, PREDICTIONS], """
SELECT snapshot_id, split, label, prediction, label - prediction AS residual,
       abs(label - prediction) AS absolute_error FROM predictions"""),
    "residual_histogram": with_([CLOUD, COUNTED, PREDICTIONS], """
SELECT CAST(b.range AS INTEGER) AS bin, round(lo + b.range * (hi - lo) / 30, 6) AS low,
       round(lo + (b.range + 1) * (hi - lo) / 30, 6) AS high, count(snapshot_id) AS n
FROM (SELECT min(label - prediction) AS lo, max(label - prediction) AS hi FROM predictions
      WHERE split = 'test') s CROSS JOIN range(30) b
LEFT JOIN predictions ON split = 'test'
     AND least(floor((label - prediction - lo) / (hi - lo) * 30), 29) = b.range
GROUP BY ALL"""),
    "qq_points": with_([CLOUD, COUNTED, PREDICTIONS, _QQ], """
SELECT snapshot_id, position, ordered, round(theoretical, 6) AS theoretical FROM qq"""),
    "qq_line": with_([CLOUD, COUNTED, PREDICTIONS, _QQ], """
SELECT round(regr_slope(ordered, theoretical), 6) AS slope,
       round(regr_intercept(ordered, theoretical), 6) AS intercept,
       round(corr(ordered, theoretical), 6) AS r FROM qq"""),
    "feature_category": with_([*_FEATURED, IMPORTANCE], f"""
SELECT feature, round(importance, 6) AS importance, {CATEGORY} AS category FROM importance"""),
    "importance_topn": with_([*_FEATURED, IMPORTANCE], f"""
SELECT CAST(row_number() OVER w AS INTEGER) AS position, feature, {CATEGORY} AS category,
       round(importance, 6) AS importance,
       round(sum(importance) OVER (ORDER BY importance DESC, feature
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative
FROM importance WINDOW w AS (ORDER BY importance DESC, feature) QUALIFY row_number() OVER w <= 10"""),
    "importance_by_category": with_([*_FEATURED, IMPORTANCE], f"""
SELECT {CATEGORY} AS category, round(sum(importance), 6) AS importance, count(*) AS features
FROM importance GROUP BY ALL"""),
    "method_comparison": with_(
        [CLOUD, COUNTED, PREDICTIONS, SITES, BOXES, WRAPPED, assigned(), OCCUPIED, """
ws AS (SELECT snapshot_id, 1000 - count(*) AS ws_vacancies FROM occupied GROUP BY snapshot_id)""", """
compared AS (
  SELECT snapshot_id, prediction AS ml_vacancies, ws_vacancies, prediction - ws_vacancies AS difference,
         CASE WHEN ws_vacancies > 0 THEN (prediction - ws_vacancies) / ws_vacancies * 100 ELSE 0 END
           AS relative_percent
  FROM predictions JOIN ws USING (snapshot_id))"""], f"""
SELECT snapshot_id, ml_vacancies, ws_vacancies, difference, round(relative_percent, 6) AS relative_percent,
       {_VERDICT} AS verdict FROM compared"""),
    "dump_scan": with_([CLOUD, _DUMPED], """
SELECT snapshot_id, atom_id, x, y, z, CAST(atom_id + 1 AS DOUBLE) AS id
FROM cloud SEMI JOIN (SELECT snapshot_id FROM dumped WHERE status = 'ok') USING (snapshot_id)"""),
    "dump_snapshots": with_([CLOUD, _DUMPED], """
SELECT file AS snapshot_id, 'id type x y z' AS columns, n AS num_atoms FROM dumped WHERE status = 'ok'"""),
    "box_scan": with_([CLOUD, _DUMPED, BOXES], """
SELECT file AS snapshot_id, n AS declared_atoms, 0.0::DOUBLE AS xlo, round(lx, 9) AS xhi, 0.0::DOUBLE AS ylo, round(ly, 9) AS yhi,
       0.0::DOUBLE AS zlo, round(lz, 9) AS zhi FROM dumped JOIN boxes USING (snapshot_id)"""),
    "boxed_scan": with_([CLOUD, _DUMPED], """
SELECT snapshot_id, atom_id, x, y, z FROM cloud
SEMI JOIN (SELECT snapshot_id FROM dumped WHERE status = 'ok') USING (snapshot_id)"""),
    "boxed_status": with_([CLOUD, _DUMPED], """
SELECT file, status, CAST(CASE WHEN status = 'no atoms section' THEN 0 ELSE n END AS BIGINT) AS num_atoms FROM dumped"""),
    "dump_folders": with_([CLOUD, _DUMPED], """
SELECT file, status, CAST(CASE WHEN status = 'no atoms section' THEN 0 ELSE n END AS BIGINT) AS num_atoms FROM dumped"""),
    "surface_features": with_([*_WHOLE, _SURFACE_CLOUD, *feature_parts("extractor")[1:]], f"""
SELECT file, {rounded(GRID_COLUMNS)}, round(moi_principal_3, 4) AS moi_principal_3,
       {rounded("rdf_mean, rdf_kurtosis, entropy_spatial")}, round(bw, 6) AS ms_bandwidth,
       CAST(700 - dumped.n AS DOUBLE) AS n_vacancies
FROM dumped JOIN occupancy USING (snapshot_id) JOIN gradients USING (snapshot_id)
  JOIN grid_moi USING (snapshot_id) JOIN moi USING (snapshot_id) JOIN radial USING (snapshot_id)
  JOIN entropy USING (snapshot_id) JOIN bandwidth USING (snapshot_id)"""),
    "run_summary": with_([CLOUD, _DUMPED], "SELECT status, count(*) AS files FROM dumped GROUP BY status"),
    "failed_files": with_([CLOUD, _DUMPED], """
SELECT file, status FROM dumped WHERE status != 'ok' ORDER BY file LIMIT 10"""),
}
