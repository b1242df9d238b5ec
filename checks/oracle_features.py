"""DuckDB text for the feature operators, written against the raw tables."""

from __future__ import annotations

CLOUD = """
cloud AS (
  SELECT l_suppkey AS snapshot_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
                            l_quantity, l_discount, l_shipdate) - 1 AS atom_id,
         l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 200 AS z
  FROM lineitem)"""

EMBEDDED = """
cloud AS (
  SELECT CAST(label AS BIGINT) AS snapshot_id, vec_id AS atom_id, CAST(embedding[1] AS DOUBLE) AS x,
         CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z
  FROM embeddings)"""

MOMENTS = """
moments AS (
  SELECT snapshot_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz,
         covar_samp(x, x) AS a, covar_samp(y, y) AS b, covar_samp(z, z) AS c,
         covar_samp(x, y) AS d, covar_samp(x, z) AS e, covar_samp(y, z) AS f
  FROM cloud GROUP BY snapshot_id)"""


def eigenvalues(source: str, target: str) -> str:
    """CTEs adding l1 >= l2 >= l3 to a table with matrix entries a b c (diagonal) d e f (xy xz yz)."""
    return f"""
{target}_q AS (SELECT *, (a + b + c) / 3 AS q FROM {source}),
{target}_p AS (
  SELECT *, sqrt((power(a - q, 2) + power(b - q, 2) + power(c - q, 2)
                  + 2 * (d * d + e * e + f * f)) / 6) AS p FROM {target}_q),
{target}_r AS (
  SELECT *, CASE WHEN p > 0 THEN greatest(-1.0, least(1.0,
      ((a - q) * (b - q) * (c - q) + 2 * d * e * f - (a - q) * f * f - (b - q) * e * e - (c - q) * d * d)
      / (2 * p * p * p))) ELSE 0 END AS r FROM {target}_p),
{target} AS (
  SELECT *, q + 2 * p * cos(acos(r) / 3) AS l1, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS l3,
         3 * q - (q + 2 * p * cos(acos(r) / 3)) - (q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3)) AS l2
  FROM {target}_r)"""


def _axis(k: int) -> str:
    """Unit eigenvector k as the longest cross product of two rows of (A - l_k I), largest entry positive."""
    el = f"l{k}"
    rows = [(f"(a - {el})", "d", "e"), ("d", f"(b - {el})", "f"), ("e", "f", f"(c - {el})")]

    def cross(u, v):
        return (f"({u[1]}*{v[2]} - {u[2]}*{v[1]})", f"({u[2]}*{v[0]} - {u[0]}*{v[2]})",
                f"({u[0]}*{v[1]} - {u[1]}*{v[0]})")

    lists = ", ".join("[" + ", ".join(cross(rows[i], rows[j])) + "]" for i, j in ((0, 1), (0, 2), (1, 2)))
    return f"list_sort([{{'s': list_dot_product(t, t), 'v': t}} FOR t IN [{lists}]])[3].v AS v{k}"


AXES = "eig_axes AS (SELECT *, " + ", ".join(_axis(k) for k in (1, 2, 3)) + """ FROM eig),
frame AS (
  SELECT * EXCLUDE (v1, v2, v3),
  """ + ",\n  ".join(
    f"""v{k}[{i}] / sqrt(list_dot_product(v{k}, v{k}))
     * CASE WHEN list_max([abs(t) FOR t IN v{k}]) = list_max(v{k}) THEN 1 ELSE -1 END AS r{k}{i}"""
    for k in (1, 2, 3) for i in (1, 2, 3)) + """
  FROM eig_axes)"""


def aligned(scale: str = "3.532") -> str:
    parts = ", ".join(
        f"((x - cx) * r{k}1 + (y - cy) * r{k}2 + (z - cz) * r{k}3) / {scale} AS p{k}" for k in (1, 2, 3))
    return f"aligned AS (SELECT snapshot_id, atom_id, x, y, z, {parts} FROM cloud JOIN frame USING (snapshot_id))"


def boxes(mode: str) -> str:
    extent = "greatest(max(p1) - min(p1), max(p2) - min(p2), max(p3) - min(p3))"
    size = extent if mode == "training" else f"greatest(1.5, least(1.5 * {extent}, 10.0))"
    return f"box AS (SELECT snapshot_id, {size} AS s FROM aligned GROUP BY snapshot_id)"


CELLS = """
placed AS (
  SELECT snapshot_id, CAST(floor((p1 + s / 2) / (s / 10)) AS INTEGER) AS ix,
         CAST(floor((p2 + s / 2) / (s / 10)) AS INTEGER) AS iy,
         CAST(floor((p3 + s / 2) / (s / 10)) AS INTEGER) AS iz
  FROM aligned JOIN box USING (snapshot_id)),
cells AS (
  SELECT DISTINCT * FROM placed
  WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 9 AND iz BETWEEN 0 AND 9)"""

OCCUPANCY = """
occupancy AS (
  SELECT snapshot_id, CAST(count(*) AS DOUBLE) AS occupancy_total, count(*) / 1000 AS occupancy_fraction,
         count(*) / 100 AS occupancy_x_mean, count(*) / 100 AS occupancy_y_mean,
         count(*) / 100 AS occupancy_z_mean, -ln(1 / count(*) + 1e-12) AS grid_entropy
  FROM cells GROUP BY snapshot_id)"""

# a full 0/1 grid per snapshot, then the sum of absolute differences along each axis
GRADIENTS = """
dense AS (
  SELECT s.snapshot_id, i.range AS ix, j.range AS iy, k.range AS iz,
         CASE WHEN cells.ix IS NULL THEN 0 ELSE 1 END AS v
  FROM (SELECT DISTINCT snapshot_id FROM cells) s, range(10) i, range(10) j, range(10) k
  LEFT JOIN cells ON cells.snapshot_id = s.snapshot_id AND cells.ix = i.range AND cells.iy = j.range
                 AND cells.iz = k.range),
steps AS (
  SELECT snapshot_id,
         abs(v - lag(v) OVER (PARTITION BY snapshot_id, iy, iz ORDER BY ix)) AS gx,
         abs(v - lag(v) OVER (PARTITION BY snapshot_id, ix, iz ORDER BY iy)) AS gy,
         abs(v - lag(v) OVER (PARTITION BY snapshot_id, ix, iy ORDER BY iz)) AS gz
  FROM dense),
gradients AS (
  SELECT snapshot_id, CAST(sum(gx) AS DOUBLE) AS occupancy_gradient_x,
         CAST(sum(gy) AS DOUBLE) AS occupancy_gradient_y, CAST(sum(gz) AS DOUBLE) AS occupancy_gradient_z,
         CAST(sum(gx) + sum(gy) + sum(gz) AS DOUBLE) AS occupancy_gradient_total,
         CAST(sum(gx) + sum(gy) + sum(gz) AS DOUBLE) AS occupancy_surface
  FROM steps GROUP BY snapshot_id)"""

# inertia tensor entries of the centered cell indices
GRID_MOI = """
inertia AS (
  SELECT snapshot_id,
         count(*) * (var_pop(iy) + var_pop(iz)) AS a, count(*) * (var_pop(ix) + var_pop(iz)) AS b,
         count(*) * (var_pop(ix) + var_pop(iy)) AS c, -count(*) * covar_pop(ix, iy) AS d,
         -count(*) * covar_pop(ix, iz) AS e, -count(*) * covar_pop(iy, iz) AS f
  FROM cells GROUP BY snapshot_id),
""" + eigenvalues("inertia", "inertia_eig") + """,
grid_moi AS (
  SELECT snapshot_id, l1 AS grid_moi_1, l2 AS grid_moi_2, greatest(l3, 0) AS grid_moi_3 FROM inertia_eig)"""

MOI = """
moi AS (SELECT snapshot_id, (n - 1) * (l2 + l3) AS moi_principal_3 FROM eig)"""

RADIAL = """
radius AS (
  SELECT snapshot_id, sqrt(power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2)) AS d
  FROM cloud JOIN moments USING (snapshot_id)),
radial AS (
  SELECT snapshot_id, avg(d) AS rdf_mean,
         CASE WHEN stddev_pop(d) < 1e-6 THEN 0 ELSE kurtosis_pop(d) END AS rdf_kurtosis
  FROM radius GROUP BY snapshot_id)"""


def entropy(source: str, axes: tuple[str, str, str]) -> str:
    spans = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in axes)
    bins = ", ".join(
        f"least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 10), 9) AS b_{c}" for c in axes)
    keys = ", ".join(f"b_{c}" for c in axes)
    return f"""
span AS (SELECT snapshot_id, {spans} FROM {source} GROUP BY snapshot_id),
binned AS (SELECT snapshot_id, {bins} FROM {source} JOIN span USING (snapshot_id)),
bin_counts AS (SELECT snapshot_id, {keys}, count(*) AS k FROM binned GROUP BY ALL),
entropy AS (
  SELECT snapshot_id, -sum(k / n * ln(k / n)) AS entropy_spatial
  FROM bin_counts JOIN (SELECT snapshot_id, count(*) AS n FROM {source} GROUP BY snapshot_id)
       USING (snapshot_id)
  GROUP BY snapshot_id)"""


# distances of every sampled point to the sample, the one at rank floor(n/5)
KNN = """
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY snapshot_id
      ORDER BY ((atom_id % 4294967296) * 1597334677) % 4294967296, atom_id) AS pick FROM cloud),
sample AS (SELECT * FROM ordered WHERE pick <= 500),
sample_size AS (SELECT snapshot_id, CAST(greatest(1, floor(count(*) * 0.2)) AS INTEGER) AS k, count(*) AS m
                FROM sample GROUP BY snapshot_id),
knn AS (
  SELECT a.snapshot_id, a.atom_id,
         list_sort(list(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)))) AS ds
  FROM sample a JOIN sample b ON a.snapshot_id = b.snapshot_id GROUP BY ALL),
kth AS (SELECT snapshot_id, atom_id, ds[k] AS kth_distance, m FROM knn JOIN sample_size USING (snapshot_id)),
bandwidth AS (SELECT snapshot_id, CASE WHEN max(m) >= 10 THEN avg(kth_distance) END AS bw
              FROM kth GROUP BY snapshot_id)"""

def rounded(columns: str | list[str], digits: int = 6, **overrides: int) -> str:
    """Select list that rounds each named column."""
    names = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else columns
    return ", ".join(f"round({c}, {overrides.get(c, digits)}) AS {c}" for c in names)


GRID_COLUMNS = """occupancy_total, occupancy_fraction, occupancy_x_mean, occupancy_y_mean, occupancy_z_mean,
  occupancy_gradient_x, occupancy_gradient_y, occupancy_gradient_z, occupancy_gradient_total,
  occupancy_surface, grid_entropy, grid_moi_1, grid_moi_2, grid_moi_3"""

_EIG = [MOMENTS, eigenvalues("moments", "eig")]


def with_(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select


def feature_parts(mode: str, bandwidth: bool = True) -> list[str]:
    source, axes = ("aligned", ("p1", "p2", "p3")) if mode == "training" else ("cloud", ("x", "y", "z"))
    return [CLOUD, *_EIG, AXES, aligned(), boxes(mode), CELLS, OCCUPANCY, GRADIENTS, GRID_MOI, MOI, RADIAL,
            entropy(source, axes)] + ([KNN] if bandwidth else [])


_JOINED = """FROM moments JOIN occupancy USING (snapshot_id) JOIN gradients USING (snapshot_id)
  JOIN grid_moi USING (snapshot_id) JOIN moi USING (snapshot_id) JOIN radial USING (snapshot_id)
  JOIN entropy USING (snapshot_id)"""


def features(mode: str) -> str:
    divisor = "3.532" if mode == "training" else "1"
    return with_(feature_parts(mode), f"""
SELECT snapshot_id, {rounded(GRID_COLUMNS)}, round(moi_principal_3, 4) AS moi_principal_3,
       {rounded("rdf_mean, rdf_kurtosis, entropy_spatial")}, round(bw / {divisor}, 6) AS ms_bandwidth, n AS num_points
{_JOINED} JOIN bandwidth USING (snapshot_id)""")


def feature_set(bandwidth: bool = True) -> list[str]:
    """CTEs ending in feature_set(file, features.., n_vacancies)."""
    bw = ", bw AS ms_bandwidth" if bandwidth else ""
    join = "JOIN bandwidth USING (snapshot_id)" if bandwidth else ""
    return [*feature_parts("extractor", bandwidth), f"""
feature_set AS (
  SELECT snapshot_id AS file, {GRID_COLUMNS}, moi_principal_3, rdf_mean,
         CASE WHEN snapshot_id % 7 != 0 THEN rdf_kurtosis END AS rdf_kurtosis, entropy_spatial{bw},
         CAST(700 - n AS DOUBLE) AS n_vacancies
  {_JOINED} {join})"""]


ORACLES = {
    "centroid": with_([CLOUD, MOMENTS], """
SELECT snapshot_id, n, round(cx, 7) AS cx, round(cy, 7) AS cy, round(cz, 7) AS cz FROM moments"""),
    "center": with_([CLOUD, MOMENTS], """
SELECT snapshot_id, atom_id, round(x - cx, 7) AS x, round(y - cy, 7) AS y, round(z - cz, 7) AS z
FROM cloud JOIN moments USING (snapshot_id)"""),
    "pca_eigenvalues": with_([CLOUD, *_EIG], """
SELECT snapshot_id, round(l1, 6) AS l1, round(l2, 6) AS l2, round(l3, 6) AS l3 FROM eig"""),
    "pca_aligned": with_([CLOUD, *_EIG, AXES, aligned()], """
SELECT snapshot_id, atom_id, round(p1, 6) AS pc1, round(p2, 6) AS pc2, round(p3, 6) AS pc3 FROM aligned"""),
    "box_size_extent": with_([CLOUD, *_EIG, AXES, aligned(), boxes("training")],
                             "SELECT snapshot_id, round(s, 6) AS box_size FROM box"),
    "box_size_clamped": with_([CLOUD, *_EIG, AXES, aligned(), boxes("extractor")],
                              "SELECT snapshot_id, round(s, 6) AS box_size FROM box"),
    "grid_cells": with_([CLOUD, *_EIG, AXES, aligned(), boxes("training"), CELLS],
                        "SELECT snapshot_id, ix, iy, iz FROM cells"),
    "grid_occupancy": with_([CLOUD, *_EIG, AXES, aligned(), boxes("training"), CELLS, OCCUPANCY],
                            "SELECT * EXCLUDE (grid_entropy) FROM occupancy"),
    "grid_entropy": with_([CLOUD, *_EIG, AXES, aligned(), boxes("training"), CELLS, OCCUPANCY],
                          "SELECT snapshot_id, round(grid_entropy, 6) AS grid_entropy FROM occupancy"),
    "grid_gradients": with_([CLOUD, *_EIG, AXES, aligned(), boxes("training"), CELLS, GRADIENTS],
                            "SELECT * FROM gradients"),
    "grid_moi": with_([CLOUD, *_EIG, AXES, aligned(), boxes("training"), CELLS, GRID_MOI],
                      f"SELECT snapshot_id, {rounded('grid_moi_1, grid_moi_2, grid_moi_3')} FROM grid_moi"),
    "moi_principal": with_([CLOUD, *_EIG, MOI], "SELECT snapshot_id, round(moi_principal_3, 4) AS moi_principal_3 FROM moi"),
    "radial_stats": with_([CLOUD, MOMENTS, RADIAL], f"SELECT snapshot_id, {rounded('rdf_mean, rdf_kurtosis')} FROM radial"),
    "spatial_entropy": with_([CLOUD, entropy("cloud", ("x", "y", "z"))], "SELECT snapshot_id, round(entropy_spatial, 6) AS entropy_spatial FROM entropy"),
    "knn_distance": with_([EMBEDDED, KNN], """
SELECT snapshot_id, atom_id, round(kth_distance, 6) AS kth_distance FROM kth"""),
    "ms_bandwidth": with_([CLOUD, KNN], "SELECT snapshot_id, round(bw, 6) AS ms_bandwidth FROM bandwidth"),
    "features_training": features("training"),
    "features_extractor": features("extractor"),
    "features_families": with_(feature_parts("extractor", bandwidth=False), f"""
SELECT snapshot_id, {rounded(GRID_COLUMNS)}, CAST(NULL AS DOUBLE) AS moi_principal_3, {rounded("rdf_mean, rdf_kurtosis")},
       CAST(NULL AS DOUBLE) AS entropy_spatial, CAST(NULL AS DOUBLE) AS ms_bandwidth, n AS num_points
{_JOINED}"""),
}
