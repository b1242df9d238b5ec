"""DuckDB text for boxes, nearest sites, Wigner-Seitz tables and surfaces."""

from __future__ import annotations

from checks.oracle_features import CLOUD, EMBEDDED, with_

SITES = """
sites AS (
  SELECT range AS site_id, (range // 100) * 5.0::DOUBLE + 0.7071067811865476::DOUBLE AS x,
         ((range // 10) % 10) * 10.5::DOUBLE + 1.4142135623730951::DOUBLE AS y,
         (range % 10) * 2.0::DOUBLE + 0.3141592653589793::DOUBLE AS z
  FROM range(1000))"""

BOXES = """
boxes AS (
  SELECT s_suppkey AS snapshot_id, 50 * (1 + s_suppkey * 1e-4) AS lx, 105 * (1 + s_suppkey * 1e-4) AS ly,
         20 * (1 + s_suppkey * 1e-4) AS lz FROM supplier)"""

WRAPPED = """
wrapped AS (
  SELECT snapshot_id, atom_id, lx, ly, lz,
         x - lx / 2 - lx * round_even((x - lx / 2) / lx, 0) AS x,
         y - ly / 2 - ly * round_even((y - ly / 2) / ly, 0) AS y,
         z - lz / 2 - lz * round_even((z - lz / 2) / lz, 0) AS z
  FROM cloud JOIN boxes USING (snapshot_id)),
ref AS (
  SELECT site_id, x - 25 - 50 * round_even((x - 25) / 50, 0) AS x,
         y - 52.5 - 105 * round_even((y - 52.5) / 105, 0) AS y,
         z - 10 - 20 * round_even((z - 10) / 20, 0) AS z FROM sites)"""


def assigned(affine: bool = False) -> str:
    """All atoms against all sites, minimum image in the atoms' box."""
    scaled = {a: f"r.{a} * (l{a} / {edge})" if affine else f"r.{a}"
              for a, edge in (("x", "50.0"), ("y", "105.0"), ("z", "20.0"))}
    image = " + ".join(
        f"power(({scaled[a]} - w.{a}) - l{a} * round_even(({scaled[a]} - w.{a}) / l{a}, 0), 2)" for a in "xyz")
    return f"""
assigned AS (
  SELECT snapshot_id, atom_id, min({{'d2': {image}, 'site_id': site_id}}) AS best
  FROM wrapped w, ref r GROUP BY snapshot_id, atom_id)"""


OPEN = """
assigned AS (
  SELECT snapshot_id, atom_id,
         min({'d2': power(r.x - w.x, 2) + power(r.y - w.y, 2) + power(r.z - w.z, 2), 'site_id': site_id}) AS best
  FROM cloud w, sites r GROUP BY snapshot_id, atom_id)"""

OCCUPIED = """
occupied AS (SELECT snapshot_id, best.site_id AS site_id, count(*) AS k, min(atom_id) AS first_atom
             FROM assigned GROUP BY ALL)"""

NEAR = """
near AS (
  SELECT a.snapshot_id, a.atom_id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz,
         power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2) AS dd
  FROM cloud a JOIN cloud b ON a.snapshot_id = b.snapshot_id AND a.atom_id != b.atom_id
  WHERE dd < 144 AND dd > 0)"""

ORDERED = """
cloud AS (
  SELECT o_custkey AS snapshot_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS atom_id,
         CAST(o_totalprice AS DOUBLE) % 1000 / 100 AS x, CAST(o_orderkey % 997 AS DOUBLE) / 100 AS y,
         CAST(o_orderkey * 31 % 1009 AS DOUBLE) / 100 AS z FROM orders)"""

def imaged(reach: float) -> str:
    """Every point with every image of itself and of the others closer than ``reach``."""
    return IMAGED.replace("6.25", f"{reach * reach:g}")


# Whole boxes -2 to 2 along the axes that repeat, which covers a reach of 5 for edges of 3 and more.
IMAGED = """
flagged AS (
  SELECT c_custkey AS snapshot_id, 3 + c_nationkey * 0.2::DOUBLE AS lx, 4 + c_custkey % 5 * 0.5::DOUBLE AS ly,
         5::DOUBLE AS lz, c_custkey % 2 = 0 AS px, c_custkey % 3 = 0 AS py, c_custkey // 2 % 2 = 0 AS pz FROM customer),
home AS (
  SELECT snapshot_id, atom_id, lx, ly, lz, px, py, pz,
         CASE WHEN px THEN x - lx / 2 - lx * round_even((x - lx / 2) / lx, 0) ELSE x END AS x,
         CASE WHEN py THEN y - ly / 2 - ly * round_even((y - ly / 2) / ly, 0) ELSE y END AS y,
         CASE WHEN pz THEN z - lz / 2 - lz * round_even((z - lz / 2) / lz, 0) ELSE z END AS z
  FROM cloud JOIN flagged USING (snapshot_id)),
images AS (
  SELECT snapshot_id, atom_id AS other_id, i.range - 2 AS ix, j.range - 2 AS iy, k.range - 2 AS iz,
         x + (i.range - 2) * lx AS x, y + (j.range - 2) * ly AS y, z + (k.range - 2) * lz AS z
  FROM home, range(5) i, range(5) j, range(5) k
  WHERE (px OR i.range = 2) AND (py OR j.range = 2) AND (pz OR k.range = 2)),
paired AS (
  SELECT a.snapshot_id, a.atom_id, other_id, ix, iy, iz, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz,
         power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2) AS dd
  FROM home a JOIN images b ON a.snapshot_id = b.snapshot_id
  WHERE dd < 6.25 AND (a.atom_id != other_id OR ix != 0 OR iy != 0 OR iz != 0)),
near AS (SELECT * FROM paired WHERE dd > 0)"""


def surface_text(radius: float) -> str:
    """Tables from ``near`` to ``surface``.

    An atom is exposed when a probe ball touching it holds no other atom. Ball centers tried: one on the circle
    shared with each neighbor, and both crossings of every two circles, nearest neighbors first.
    """
    square = f"{radius * radius:g}"
    return SURFACE.replace("36", square).replace("power(6 -", f"power({radius:g} -")


SURFACE = """
nearby AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, atom_id ORDER BY dd) AS r FROM near),
lists AS (
  SELECT snapshot_id, atom_id, list({'x': dx, 'y': dy, 'z': dz} ORDER BY r) AS others,
         list({'x': dx, 'y': dy, 'z': dz} ORDER BY r) FILTER (r <= 6) AS first
  FROM nearby GROUP BY ALL),
circles AS (
  SELECT snapshot_id, atom_id, dx / 2 + px / l * h AS zx, dy / 2 + py / l * h AS zy, dz / 2 + pz / l * h AS zz
  FROM (SELECT *, sqrt(px * px + py * py + pz * pz) AS l, sqrt(36 - dd / 4) AS h
        FROM (SELECT *, CASE WHEN abs(dx) <= abs(dy) THEN 0 ELSE dz END AS px,
                     CASE WHEN abs(dx) <= abs(dy) THEN -dz ELSE 0 END AS py,
                     CASE WHEN abs(dx) <= abs(dy) THEN dy ELSE -dx END AS pz FROM nearby)) WHERE l > 0),
crossed AS (
  SELECT u.snapshot_id, u.atom_id, u.dd AS uu, v.dd AS vv, u.dx AS ux, u.dy AS uy, u.dz AS uz,
         v.dx AS vx, v.dy AS vy, v.dz AS vz, u.dy * v.dz - u.dz * v.dy AS wx,
         u.dz * v.dx - u.dx * v.dz AS wy, u.dx * v.dy - u.dy * v.dx AS wz
  FROM nearby u JOIN nearby v ON u.snapshot_id = v.snapshot_id AND u.atom_id = v.atom_id AND u.r < v.r),
feet AS (
  SELECT *, wx * wx + wy * wy + wz * wz AS ww,
         ((wy * uz - wz * uy) * vv + (vy * wz - vz * wy) * uu) / (2 * ww) AS fx,
         ((wz * ux - wx * uz) * vv + (vz * wx - vx * wz) * uu) / (2 * ww) AS fy,
         ((wx * uy - wy * ux) * vv + (vx * wy - vy * wx) * uu) / (2 * ww) AS fz
  FROM crossed WHERE wx * wx + wy * wy + wz * wz > 1e-12 * uu * vv),
rises AS (
  SELECT *, sqrt((36 - fx * fx - fy * fy - fz * fz) / ww) AS k FROM feet
  WHERE fx * fx + fy * fy + fz * fz <= 36),
candidates AS (
  SELECT snapshot_id, atom_id, fx + wx * k AS zx, fy + wy * k AS zy, fz + wz * k AS zz FROM rises
  UNION ALL SELECT snapshot_id, atom_id, fx - wx * k, fy - wy * k, fz - wz * k FROM rises
  UNION ALL SELECT * FROM circles),
hopeful AS (
  SELECT snapshot_id, atom_id, zx, zy, zz FROM candidates JOIN lists USING (snapshot_id, atom_id)
  WHERE list_min([power(zx - n.x, 2) + power(zy - n.y, 2) + power(zz - n.z, 2) FOR n IN first])
        >= power(6 - 1e-7, 2)),
exposed AS (
  SELECT DISTINCT snapshot_id, atom_id FROM hopeful JOIN lists USING (snapshot_id, atom_id)
  WHERE list_min([power(zx - n.x, 2) + power(zy - n.y, 2) + power(zz - n.z, 2) FOR n IN others])
        >= power(6 - 1e-7, 2)),
surface AS (
  SELECT * FROM exposed
  UNION ALL SELECT snapshot_id, atom_id FROM cloud ANTI JOIN near USING (snapshot_id, atom_id))"""

_PERIODIC = [CLOUD, SITES, BOXES, WRAPPED, assigned(), OCCUPIED]
_AFFINE = [CLOUD, SITES, BOXES, WRAPPED, assigned(affine=True), OCCUPIED]

NEAREST = """
SELECT snapshot_id, atom_id, best.site_id AS site_id, round(sqrt(best.d2), 6) AS distance FROM assigned"""

SUMMARY = """
SELECT snapshot_id, 1000 - count(*) AS n_vacancies, CAST(sum(k) - count(*) AS BIGINT) AS n_interstitials,
       CAST(1000 AS BIGINT) AS n_reference_sites, CAST(sum(k) AS BIGINT) AS n_defective_atoms,
       round((1000 - count(*)) / 1000, 6) AS vacancy_concentration,
       round((sum(k) - count(*)) / 1000, 6) AS interstitial_concentration,
       round((max(lx * ly * lz) - 105000) / 105000, 6) AS volumetric_strain
FROM occupied JOIN boxes USING (snapshot_id) GROUP BY snapshot_id"""

ORACLES = {
    "pbc_wrap": with_([CLOUD, SITES, BOXES, WRAPPED], """
SELECT snapshot_id, atom_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM wrapped"""),
    "affine_map": with_([CLOUD, SITES, BOXES, WRAPPED], """
SELECT snapshot_id, site_id, round(x * (lx / 50.0), 6) AS x, round(y * (ly / 105.0), 6) AS y,
       round(z * (lz / 20.0), 6) AS z FROM ref, boxes"""),
    "strain": with_([BOXES], """
SELECT snapshot_id, round(lx * ly * lz, 4) AS volume,
       round((lx * ly * lz - 105000) / 105000, 6) AS volumetric_strain FROM boxes"""),
    "nearest_site_pbc": with_([CLOUD, SITES, BOXES, WRAPPED, assigned()], NEAREST),
    "nearest_site_affine": with_([CLOUD, SITES, BOXES, WRAPPED, assigned(affine=True)], NEAREST),
    "nearest_site_open": with_([CLOUD, SITES, OPEN], NEAREST),
    "radius_pairs": with_([CLOUD], """
SELECT a.snapshot_id, a.atom_id, b.atom_id AS other_id,
       round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)), 6) AS distance
FROM (SELECT *, floor(y / 4) AS row FROM cloud) a
JOIN (SELECT *, unnest([floor(y / 4) - 1, floor(y / 4), floor(y / 4) + 1]) AS row FROM cloud) b
  ON a.snapshot_id = b.snapshot_id AND a.row = b.row AND a.atom_id < b.atom_id
WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) < 16"""),
    "radius_pairs_pbc": with_([CLOUD, SITES, BOXES, WRAPPED], """
SELECT a.snapshot_id, a.atom_id, b.atom_id AS other_id, round(sqrt(d2), 6) AS distance
FROM (SELECT *, floor(y / 4) AS row FROM wrapped) a
JOIN (SELECT *, unnest(list_distinct(flatten(
        [[floor((y + k * ly) / 4) + j FOR j IN [-1, 0, 1]] FOR k IN [-1, 0, 1]]))) AS row FROM wrapped) b
  ON a.snapshot_id = b.snapshot_id AND a.row = b.row AND a.atom_id < b.atom_id,
     LATERAL (SELECT power((a.x - b.x) - a.lx * round_even((a.x - b.x) / a.lx, 0), 2)
                   + power((a.y - b.y) - a.ly * round_even((a.y - b.y) / a.ly, 0), 2)
                   + power((a.z - b.z) - a.lz * round_even((a.z - b.z) / a.lz, 0), 2) AS d2)
WHERE d2 < 16"""),
    "radius_pairs_embedded": with_([EMBEDDED], """
SELECT a.snapshot_id, a.atom_id, b.atom_id AS other_id,
       round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)), 6) AS distance
FROM cloud a JOIN cloud b ON a.snapshot_id = b.snapshot_id AND a.atom_id < b.atom_id
WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) < 0.01"""),
    "surface_atoms": with_([CLOUD, NEAR, SURFACE], "SELECT snapshot_id, atom_id FROM surface"),
    "surface_distance": with_([CLOUD, NEAR, SURFACE], """
SELECT a.snapshot_id, a.atom_id, round(min(sqrt(
         power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))), 6) AS surface_distance
FROM cloud a JOIN (SELECT * FROM cloud SEMI JOIN surface USING (snapshot_id, atom_id)) b
     ON a.snapshot_id = b.snapshot_id
GROUP BY ALL HAVING surface_distance < 4"""),
    "radius_pairs_images": with_([ORDERED, imaged(2.5)], """
SELECT snapshot_id, atom_id, other_id, ix, iy, iz, round(sqrt(dd), 6) AS distance FROM paired
WHERE atom_id < other_id OR (atom_id = other_id AND (ix > 0 OR (ix = 0 AND (iy > 0 OR (iy = 0 AND iz > 0)))))"""),
    "radius_pairs_tilted": with_([ORDERED, imaged(2.5).split("home AS (")[0].rstrip().rstrip(",")], """
, folded_z AS (
  SELECT snapshot_id, atom_id, lx, ly, lz, px, py, pz, snapshot_id % 4 * 0.4::DOUBLE AS xy, -0.3::DOUBLE AS xz,
         snapshot_id % 3 * 0.5::DOUBLE AS yz, x, y, z,
         CASE WHEN pz THEN round_even((z - lz / 2) / lz, 0) ELSE 0 END AS n
  FROM cloud JOIN flagged USING (snapshot_id)),
folded_y AS (
  SELECT * EXCLUDE (n, x, y, z), x - n * xz AS x, y - n * yz AS y, CASE WHEN pz THEN z - lz / 2 - lz * n ELSE z END AS z,
         CASE WHEN py THEN round_even((y - n * yz - ly / 2) / ly, 0) ELSE 0 END AS n FROM folded_z),
folded_x AS (
  SELECT * EXCLUDE (n, x, y), x - n * xy AS x, CASE WHEN py THEN y - ly / 2 - ly * n ELSE y END AS y,
         CASE WHEN px THEN round_even((x - n * xy - lx / 2) / lx, 0) ELSE 0 END AS n FROM folded_y),
home AS (SELECT * EXCLUDE (n, x), CASE WHEN px THEN x - lx / 2 - lx * n ELSE x END AS x FROM folded_x),
images AS (
  SELECT snapshot_id, atom_id AS other_id, i.range - 3 AS ix, j.range - 3 AS iy, k.range - 3 AS iz,
         x + (i.range - 3) * lx + (j.range - 3) * xy + (k.range - 3) * xz AS x,
         y + (j.range - 3) * ly + (k.range - 3) * yz AS y, z + (k.range - 3) * lz AS z
  FROM home, range(7) i, range(7) j, range(7) k
  WHERE (px OR i.range = 3) AND (py OR j.range = 3) AND (pz OR k.range = 3))
SELECT a.snapshot_id, a.atom_id, other_id, ix, iy, iz, round(sqrt(dd), 6) AS distance
FROM home a JOIN images b ON a.snapshot_id = b.snapshot_id,
     LATERAL (SELECT power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2) AS dd)
WHERE dd < 6.25 AND (a.atom_id < other_id OR (a.atom_id = other_id AND
      (ix > 0 OR (ix = 0 AND (iy > 0 OR (iy = 0 AND iz > 0))))))"""),
    "surface_atoms_slab": with_([ORDERED, imaged(5), surface_text(2.5)], "SELECT snapshot_id, atom_id FROM surface"),
    "surface_distance_slab": with_([ORDERED, imaged(5), surface_text(2.5)], """
SELECT a.snapshot_id, a.atom_id, round(min(sqrt(
         power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))), 6) AS surface_distance
FROM home a JOIN (SELECT * FROM images SEMI JOIN (SELECT snapshot_id, atom_id AS other_id FROM surface)
                  USING (snapshot_id, other_id)) b ON a.snapshot_id = b.snapshot_id
GROUP BY ALL HAVING surface_distance < 1"""),
    "ws_summary_complete": with_([ORDERED], """
, sized AS (
  SELECT c_custkey AS snapshot_id, 3 + c_nationkey * 0.2::DOUBLE AS lx, 4 + c_custkey % 5 * 0.5::DOUBLE AS ly,
         5::DOUBLE AS lz FROM customer WHERE c_acctbal >= 0),
folded AS (
  SELECT snapshot_id, atom_id, lx, ly, lz, x - lx / 2 - lx * round_even((x - lx / 2) / lx, 0) AS x,
         y - ly / 2 - ly * round_even((y - ly / 2) / ly, 0) AS y, z - lz / 2 - lz * round_even((z - lz / 2) / lz, 0) AS z
  FROM cloud JOIN sized USING (snapshot_id)),
cube AS (
  SELECT range AS site_id, (range // 16) * 2.0::DOUBLE + 0.75 - 4 AS x, (range // 4 % 4) * 2.0::DOUBLE + 0.75 - 4 AS y,
         (range % 4) * 2.0::DOUBLE + 0.75 - 4 AS z FROM range(64)),
taken AS (
  SELECT snapshot_id, atom_id,
         min({'d2': power((s.x * (lx / 8) - f.x) - lx * round_even((s.x * (lx / 8) - f.x) / lx, 0), 2)
                    + power((s.y * (ly / 8) - f.y) - ly * round_even((s.y * (ly / 8) - f.y) / ly, 0), 2)
                    + power((s.z * (lz / 8) - f.z) - lz * round_even((s.z * (lz / 8) - f.z) / lz, 0), 2),
              'site_id': site_id}) AS best
  FROM folded f, cube s GROUP BY ALL),
counted AS (SELECT snapshot_id, count(*) AS atoms, count(DISTINCT best.site_id) AS filled FROM taken GROUP BY 1),
known AS (SELECT snapshot_id FROM cloud UNION SELECT snapshot_id FROM sized),
judged AS (
  SELECT k.snapshot_id, s.lx * s.ly * s.lz AS v, coalesce(atoms, 0) AS atoms, coalesce(filled, 0) AS filled,
         CASE WHEN s.lx IS NULL THEN 'no box' WHEN atoms IS NULL THEN 'no atoms' ELSE 'ok' END AS status
  FROM known k LEFT JOIN sized s ON k.snapshot_id = s.snapshot_id LEFT JOIN counted c ON k.snapshot_id = c.snapshot_id)
SELECT snapshot_id, status, CASE WHEN v > 0 THEN 64 - filled END AS n_vacancies,
       CASE WHEN v > 0 THEN atoms - filled END AS n_interstitials, CAST(64 AS BIGINT) AS n_reference_sites,
       CASE WHEN v > 0 THEN atoms END AS n_defective_atoms,
       CASE WHEN v > 0 THEN round((64 - filled) / 64, 6) END AS vacancy_concentration,
       CASE WHEN v > 0 THEN round((atoms - filled) / 64, 6) END AS interstitial_concentration,
       round((v - 512) / 512, 6) AS volumetric_strain
FROM judged"""),
    "ws_occupancy": with_(_PERIODIC, """
SELECT s.snapshot_id, site_id, coalesce(k, 0) AS occupancy
FROM (SELECT DISTINCT snapshot_id FROM wrapped) s CROSS JOIN sites
LEFT JOIN occupied USING (snapshot_id, site_id)"""),
    "ws_vacancies": with_(_PERIODIC, """
SELECT s.snapshot_id, site_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z
FROM (SELECT DISTINCT snapshot_id FROM wrapped) s CROSS JOIN ref
ANTI JOIN occupied USING (snapshot_id, site_id)"""),
    "ws_vacancies_affine": with_(_AFFINE, """
SELECT b.snapshot_id, site_id, round(x * (lx / 50.0), 6) AS x, round(y * (ly / 105.0), 6) AS y,
       round(z * (lz / 20.0), 6) AS z
FROM (SELECT * FROM boxes SEMI JOIN wrapped USING (snapshot_id)) b CROSS JOIN ref
ANTI JOIN occupied USING (snapshot_id, site_id)"""),
    "ws_interstitials": with_(_PERIODIC, """
SELECT snapshot_id, atom_id, site_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z
FROM (SELECT snapshot_id, atom_id, best.site_id AS site_id,
             row_number() OVER (PARTITION BY snapshot_id, best.site_id ORDER BY atom_id) AS place
      FROM assigned) JOIN wrapped USING (snapshot_id, atom_id)
WHERE place > 1"""),
    "ws_summary": with_(_PERIODIC, SUMMARY),
    "ws_summary_affine": with_(_AFFINE, SUMMARY),
}
