"""Surface atoms: those a probe ball of radius R can touch without holding another atom.

The centers of such balls lie on the sphere of radius R around the atom, outside the R-balls of its
neighbors. If the sphere is not fully covered, then some circle cut by a neighbor, or some crossing of
two such circles, is uncovered; so checking those finitely many centers decides exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType

from voidscope.operators.images import LENGTHS, SHIFT, folded, offsets_within, with_images
from voidscope.operators.neighbors import (
    AXES,
    CELL,
    POINT,
    SLACK,
    Setting,
    near_cells,
    nearest,
    numbered_groups,
    own_cells,
    whole_snapshots,
)
from voidscope.session import stage

PROBE_RADIUS = 2.0
SURFACE_DISTANCE = 2.0
TOLERANCE = 1e-7
CROWDED = 256  # atoms per cell of edge 4R beyond which neighbors are not listed but found on demand
FIRST_NEIGHBORS = 8
WHOLE = 1 << 14  # points and images of a snapshot up to which it is judged in one task
QUERY, OTHER, IMAGE = 1, 2, 4  # what a row of such a snapshot is
_CHUNK = 1 << 13  # rows of whole snapshots looked at together
_PAIRS = 1 << 18  # candidate pairs
_ROWS = 1 << 16  # neighbor rows
_TURNS = 12  # directions tried per atom
_WORK = 1 << 18  # centers times neighbors looked at together
_TRIED = 8  # open centers per atom and round compared with all its neighbors
WITNESSES = 63  # uncovered centers tried per atom and round


def _geometry(radius: float):
    """Numpy helpers over one atom's neighbor offsets, shipped to the workers by value."""

    corners = {}

    def pairs(count):
        if count not in corners:
            corners[count] = np.triu_indices(count, 1)
        return corners[count]

    def cross(u, v):
        return np.stack([u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]])

    def centers(near):
        """Ball centers on every neighbor's circle and on every crossing of two circles."""
        near = near.T
        squared = (near * near).sum(axis=0)
        away = np.eye(3)[:, np.argmin(np.abs(near), axis=0)]
        side = cross(near, away)
        side *= np.sqrt(np.maximum(radius**2 - squared / 4, 0) / (side * side).sum(axis=0))
        i, j = pairs(near.shape[1])
        u, v = near[:, i], near[:, j]
        w = cross(u, v)
        ww, uu, vv = (w * w).sum(axis=0), squared[i], squared[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            foot = (cross(w, u) * vv + cross(v, w) * uu) / (2 * ww)
            left = radius**2 - (foot * foot).sum(axis=0)
            real = (ww > 1e-12 * uu * vv) & (left >= 0)
        foot, rise = foot[:, real], w[:, real] * np.sqrt(left[real] / ww[real])
        return np.concatenate([near / 2 + side, foot + rise, foot - rise], axis=1).T

    def uncovered(candidates, near):
        """Centers, all at distance R, that no neighbor holds."""
        gaps = radius**2 + (near * near).sum(axis=1) - 2 * candidates @ near.T
        return candidates[gaps.min(axis=1) >= (radius - TOLERANCE) ** 2]

    def offsets(x, y, z):
        near = np.stack([x, y, z], axis=1)
        return near[(near * near).sum(axis=1) > 0]  # an atom at the same place covers nothing more

    return centers, uncovered, offsets


def _exposure(radius: float):
    """Function (neighbor offsets by axis, starts of the runs of each atom, none empty) -> exposed, for many atoms at once."""
    # of a center at distance R from the atom and a neighbor at n: its squared distance to the neighbor less R^2 is n.n - 2 n.c
    least = (radius - TOLERANCE) ** 2 - radius**2
    corners = {}

    def pairs(count):
        if count not in corners:
            corners[count] = np.triu_indices(count, 1)
        return corners[count]

    def cross(u, v):
        out = np.empty(u.shape)
        for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
            np.multiply(u[b], v[c], out=out[a])
            out[a] -= u[c] * v[b]
        return out

    def heads(of):
        """Starts of the runs of equal values."""
        return np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of

    def probed(near, squared, starts, sizes):
        """Atoms proved exposed by a direction in no cap, and the caps in the way of the directions tried.

        The first direction points away from the neighbors; each next one is moved out of the deepest cap.
        """
        exposed, deepest = np.zeros(len(starts), bool), np.zeros(near.shape[1], bool)
        norm = np.sqrt(squared)
        edge, unit = np.minimum(norm / (2 * radius), 1.0), near / norm
        along = -np.add.reduceat(unit * (1 - edge), starts, axis=1)
        row, atom = np.arange(near.shape[1]), np.arange(len(starts))
        for turn in range(_TURNS):
            length = np.sqrt((along * along).sum(axis=0))
            along[:, length < 1e-9] = [[1.0], [0.0], [0.0]]
            along /= np.where(length < 1e-9, 1.0, length)
            depth = -edge
            for a in range(3):
                depth += unit[a] * np.repeat(along[a], sizes)
            begins = np.cumsum(sizes) - sizes
            most = np.maximum.reduceat(depth, begins)
            free = most <= 0
            exposed[atom[free]] = True
            if free.all() or turn == _TURNS - 1:
                break
            hit = np.flatnonzero(depth == np.repeat(np.where(free, np.inf, most), sizes))
            of = np.searchsorted(begins, hit, side="right") - 1
            first = heads(of)
            hit, of = hit[first], of[first]
            deepest[row[hit]] = True
            along[:, of] -= (most[of] * 1.3 + 0.02) * unit[:, hit]
            kept = ~free
            rows = np.repeat(kept, sizes)
            along, atom, sizes = along[:, kept], atom[kept], sizes[kept]
            unit, edge, row = unit[:, rows], edge[rows], row[rows]
        return exposed, deepest

    def open_centers(near, squared):
        """Centers on every neighbor's circle and on every crossing of two that no neighbor of the same atom holds, by
        rows of equally many neighbors: numbers of the rows, ascending, and the centers."""
        _, rows, count = near.shape
        away = np.eye(3)[:, np.argmin(np.abs(near), axis=0)]
        side = cross(near, away)
        side *= np.sqrt(np.maximum(radius**2 - squared / 4, 0) / (side * side).sum(axis=0))
        side += near / 2

        def kept(centers, real):
            gaps = np.matmul(near.transpose(1, 2, 0), centers.transpose(1, 0, 2))
            gaps *= -2
            gaps += squared[:, :, None]
            row, at = np.nonzero((gaps.min(axis=1) >= least) & real)
            return row, centers[:, row, at]

        found = [kept(side, True)]
        first, second = pairs(count)
        step = max(1, _WORK // (2 * rows * count))
        for i, j in ((first[s:s + step], second[s:s + step]) for s in range(0, len(first), step)):
            u, v, uu, vv = near[:, :, i], near[:, :, j], squared[:, i], squared[:, j]
            w = cross(u, v)
            ww = (w * w).sum(axis=0)
            foot, more = cross(w, u), cross(v, w)
            foot *= vv / (2 * ww)
            more *= uu / (2 * ww)
            foot += more
            left = radius**2 - (foot * foot).sum(axis=0)
            real = (ww > 1e-12 * uu * vv) & (left >= 0)
            w *= np.sqrt(left / ww)
            found.append(kept(np.concatenate([foot + w, foot - w], axis=2), np.concatenate([real, real], axis=1)))
        row, centers = (np.concatenate(f, axis=-1) for f in zip(*found))
        order = np.argsort(row, kind="stable")
        return row[order], centers[:, order]

    def spread_out(of):
        """A few places of each run of equal values."""
        first = heads(of)
        counts = np.diff(np.r_[first, len(of)])
        at = np.arange(len(of)) - np.repeat(first, counts)
        counts = np.repeat(counts, counts)
        return (at == 0) | (at * _TRIED // counts != (at - 1) * _TRIED // counts)

    def settle(near, squared, starts, sizes, chosen):
        """Exactly, by the crossings of the circles of the ``chosen`` neighbors: if these leave no center, they cover the
        sphere; a center they leave proves the atom exposed or names a neighbor to choose."""
        exposed, todo = np.zeros(len(starts), bool), np.arange(len(starts))
        while len(todo):
            counts = np.add.reduceat(chosen, starts)
            todo = todo[np.argsort(counts[todo], kind="stable")]
            listed, again, begin = np.flatnonzero(chosen), [], 0
            begins = np.cumsum(counts) - counts
            while begin < len(todo):
                # rows of about as many neighbors; shorter ones repeat their last neighbor, which changes nothing
                wanted = counts[todo[begin:]]
                end = int(np.searchsorted(wanted, wanted[0] + max(2, wanted[0] // 8), side="right"))
                end = max(1, min(end, int(_WORK // int(wanted[end - 1]) ** 3)))
                some, width = todo[begin:begin + end], wanted[end - 1]
                begin += end
                rows = listed[begins[some, None] + np.minimum(np.arange(width), counts[some, None] - 1)]
                row, centers = open_centers(near[:, rows], squared[rows])
                if not len(row):
                    continue
                tried = spread_out(row)
                atom, centers = some[row[tried]], centers[:, tried]
                size = sizes[atom]
                first = np.cumsum(size) - size
                at = np.arange(size.sum()) - np.repeat(first - starts[atom], size)
                gaps = squared[at]
                for a in range(3):
                    gaps -= near[a, at] * np.repeat(2 * centers[a], size)
                lowest = np.minimum.reduceat(gaps, first)
                hit = np.flatnonzero(gaps == np.repeat(lowest, size))
                of = np.searchsorted(first, hit, side="right") - 1
                clear = lowest >= least
                clear[of[chosen[at[hit]]]] = True  # a chosen one holds it by rounding alone
                exposed[atom[clear]] = True
                held = ~exposed[atom]
                chosen[at[hit[held[of]]]] = True
                again.append(atom[held][heads(atom[held])])
            todo = np.concatenate(again) if again else todo[:0]
        return exposed

    def some(near, starts):
        sizes = np.diff(np.r_[starts, near.shape[1]])
        squared = near[0] * near[0] + near[1] * near[1] + near[2] * near[2]
        exposed, deepest = probed(near, squared, starts, sizes)
        if exposed.all():
            return exposed
        rows = np.repeat(~exposed, sizes)
        sizes = sizes[~exposed]
        near, squared, deepest = near[:, rows], squared[rows], deepest[rows]
        starts = np.cumsum(sizes) - sizes
        left = squared.copy()
        for _ in range(FIRST_NEIGHBORS):
            hit = np.flatnonzero(left == np.repeat(np.minimum.reduceat(left, starts), sizes))
            hit = hit[heads(np.searchsorted(starts, hit, side="right"))]
            left[hit] = np.inf
            deepest[hit] = True
        exposed[~exposed] = settle(near, squared, starts, sizes, deepest)
        return exposed

    def run(near, starts):
        """Slices of atoms with a bounded number of neighbor rows."""
        ends = np.r_[starts[1:], near.shape[1]]
        answers, begin = [], 0
        with np.errstate(divide="ignore", invalid="ignore"):
            while begin < len(starts):
                end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + _ROWS, side="right")))
                answers.append(some(near[:, starts[begin]:ends[end - 1]], starts[begin:end] - starts[begin]))
                begin = end
        return np.concatenate(answers) if answers else np.zeros(0, bool)

    return run


def _is_exposed(radius: float) -> Column:
    offsets, decide = _geometry(radius)[2], _exposure(radius)

    def exposed(xs: pd.Series, ys: pd.Series, zs: pd.Series) -> pd.Series:
        near = [offsets(x, y, z) for x, y, z in zip(xs, ys, zs)]
        sizes = np.array([len(n) for n in near], int)
        answer = sizes == 0
        if not answer.all():
            some = sizes[~answer]
            answer[~answer] = decide(np.concatenate([n for n in near if len(n)]).T, np.cumsum(some) - some)
        return pd.Series(answer)

    return F.pandas_udf(exposed, BooleanType())("_dx", "_dy", "_dz")


def _cell_keys(group: np.ndarray, places: np.ndarray, edge: float) -> tuple[np.ndarray, int, int] | None:
    """A number for the cell of each place that grows by 1 along z, and the steps along x and y. None if it is too large."""
    columns, spans = [], []
    for a in range(3):
        values, at = np.unique(np.clip(np.floor(places[:, a] / edge), -(2.0**62), 2.0**62).astype(np.int64), return_inverse=True)
        packed = np.r_[1, 1 + np.cumsum(np.minimum(np.diff(values), 2))]  # wide gaps are narrowed, neighbors stay neighbors
        columns.append(packed[at])
        spans.append(int(packed[-1]) + 2)
    if (int(group.max()) + 1) * spans[0] * spans[1] * spans[2] >= 1 << 62:
        return None
    along_y, along_x = spans[2], spans[1] * spans[2]
    return ((group * spans[0] + columns[0]) * spans[1] + columns[1]) * spans[2] + columns[2], along_x, along_y


def _uncovered_rows(group: np.ndarray, ids: np.ndarray, places: np.ndarray, kind: np.ndarray, reach: float, decide) -> np.ndarray:
    """Which rows are query rows of exposed atoms, by their neighbors in the same group (numbers from 0, ascending)."""
    answer = (kind & QUERY) > 0
    real = np.isfinite(places).all(axis=1)
    asked = np.flatnonzero(answer)
    there = np.flatnonzero(real & ((kind & OTHER) > 0))
    if not len(asked) or not len(there):
        return answer
    asked = asked[np.lexsort((ids[asked], group[asked]))]
    both = np.r_[asked, there]
    found = _cell_keys(group[both], np.where(real[both, None], places[both], 0.0), reach * (1 + SLACK))
    if found is None:
        for g in np.unique(group[asked]):
            part = np.flatnonzero(group == g)
            answer[part] = _uncovered_rows(np.zeros(len(part), int), ids[part], places[part], kind[part], reach, decide)
        return answer
    keys, along_x, along_y = found
    mine, theirs = keys[:len(asked)], keys[len(asked):]
    order = np.argsort(theirs, kind="stable")
    theirs, there = theirs[order], there[order]
    own, beside = (np.ascontiguousarray(places[r].T) for r in (asked, there))
    columns = mine[:, None] + np.array([x * along_x + y * along_y for x in (-1, 0, 1) for y in (-1, 0, 1)])
    low, high = np.searchsorted(theirs, columns - 1), np.searchsorted(theirs, columns + 1, side="right")
    counts = np.where(real[asked, None], high - low, 0)
    # rows of one key are judged together
    new = np.r_[True, (group[asked[1:]] != group[asked[:-1]]) | (ids[asked[1:]] != ids[asked[:-1]])]
    heads = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    total = np.cumsum(np.add.reduceat(counts.sum(axis=1), heads))
    exposed, begin = np.ones(len(heads), bool), 0
    while begin < len(heads):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + _PAIRS, side="right")))
        rows = np.arange(heads[begin], heads[end] if end < len(heads) else len(asked))
        some = counts[rows].ravel()
        at = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some - low[rows].ravel(), some)
        each = counts[rows].sum(axis=1)
        offset = [beside[a][at] - np.repeat(own[a][rows], each) for a in range(3)]
        squared = offset[0] * offset[0] + offset[1] * offset[1] + offset[2] * offset[2]
        # an atom at the same place covers nothing more
        near = np.flatnonzero((squared < reach**2) & (squared > 0))
        other, query = there[at[near]], np.repeat(rows, each)[near]
        apart = (ids[other] != ids[asked[query]]) | ((kind[other] & IMAGE) > 0)
        near, of = near[apart], number[query[apart]]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
        exposed[of[starts]] = decide(np.stack([o[near] for o in offset]), starts)
        begin = end
    answer[asked] = exposed[number]
    return answer


def _in_task(rows: DataFrame, radius: float) -> DataFrame:
    """Keys of the exposed atoms of ``rows(snapshot_id, atom_id, x, y, z, kind)``, every snapshot in one task."""
    decide, reach = _exposure(radius), 2 * radius

    def judged(table: pa.Table) -> pa.Table:
        ids, kind = table.column("atom_id").to_numpy(), table.column("kind").to_numpy()
        places = np.stack([table.column(a).to_numpy().astype(float) for a in AXES], axis=1)
        with np.errstate(invalid="ignore", over="ignore"):
            kept = _uncovered_rows(numbered_groups(table), ids, places, kind, reach, decide)
        return table.select(POINT).filter(pa.array(kept))

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return whole_snapshots(rows, judged, ", ".join(f"{c} {types[c]}" for c in POINT), _CHUNK)


def _free_centers(radius: float) -> Column:
    """Up to WITNESSES uncovered centers given the neighbors known so far; eight corners without any."""
    centers, uncovered, offsets = _geometry(radius)

    def free(xs: pd.Series, ys: pd.Series, zs: pd.Series) -> pd.Series:
        corners = np.array([[a, b, c] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]) * radius / 3**0.5
        out = []
        for x, y, z in zip(xs, ys, zs):
            near = offsets(np.asarray(x, float), np.asarray(y, float), np.asarray(z, float))
            found = uncovered(centers(near), near) if len(near) else corners
            out.append([list(p) for p in found[:WITNESSES]])
        return pd.Series(out)

    return F.pandas_udf(free, ArrayType(ArrayType(DoubleType())))("_dx", "_dy", "_dz")


def surface_atoms(
    points: DataFrame, probe_radius: float = PROBE_RADIUS, boxes: DataFrame | None = None
) -> DataFrame:
    """Keys of the atoms on the surface. With ``boxes`` the snapshots repeat along the axes their flags say.

    Neighbors are points and images within two radii, so a box of any size and any mix of open and repeating axes
    is judged as the endless cloud it stands for.
    """
    reach = 2 * float(probe_radius)
    home = folded(points, boxes)
    others = with_images(home, reach)
    home = home.drop(*LENGTHS)
    counts = stage(own_cells(others, reach).groupBy("snapshot_id", *CELL).count(), "cells")
    crowded = stage(counts.filter(F.col("count") > CROWDED).drop("count"), "crowded")
    large = stage(
        counts.groupBy("snapshot_id").agg(F.sum("count").alias("_n")).filter(F.col("_n") > WHOLE).select("snapshot_id"), "large")
    if crowded.isEmpty():
        return _sparse(home, others, probe_radius, large, boxes is None)
    beside = stage(
        near_cells(home, reach, False).join(crowded, ["snapshot_id", *CELL], "left_semi")
        .select(*POINT).distinct(), "beside")
    # nothing in a crowded cell is within reach of the points away from them
    roomy = own_cells(others, reach).join(crowded, ["snapshot_id", *CELL], "left_anti").drop(*CELL)
    sparse = _sparse(home.join(beside, POINT, "left_anti"), roomy, probe_radius, large, False)
    dense = _on_demand(home.join(beside, POINT, "left_semi"), others, probe_radius)
    return sparse.unionByName(dense)


def _sparse(queries: DataFrame, others: DataFrame, radius: float, large: DataFrame, alike: bool) -> DataFrame:
    """Decide atoms away from crowded cells: snapshots in ``large`` from neighbor lists, the rest in one task each.
    ``alike`` says that the others are the queries."""
    found = []
    if not large.isEmpty():
        found.append(_listed(*(d.join(large, "snapshot_id", "left_semi") for d in (queries, others)), radius))
        queries, others = (d.join(large, "snapshot_id", "left_anti") for d in (queries, others))
    keyless = F.col("snapshot_id").isNull() | F.col("atom_id").isNull()  # such rows meet no other
    found.append(queries.filter(keyless).select(*POINT))
    places = [F.coalesce(F.col(a).cast("double"), F.lit(float("nan"))).alias(a) for a in AXES]
    own = queries.filter(~keyless).select(*POINT, *places)
    if alike:
        rows = own.withColumn("kind", F.lit(QUERY + OTHER))
    else:
        away = F.lit(False)
        for i in SHIFT:
            away = away | (F.col(i) != 0)
        near = others.withColumn("kind", F.when(away, F.lit(OTHER + IMAGE)).otherwise(F.lit(OTHER))).filter(
            F.col("snapshot_id").isNotNull() & (F.col("atom_id").isNotNull() | away))
        number = F.coalesce("atom_id", F.lit(0).cast(queries.schema["atom_id"].dataType)).alias("atom_id")
        rows = own.withColumn("kind", F.lit(QUERY)).unionByName(near.select("snapshot_id", number, *places, "kind"))
    result = _in_task(rows, float(radius))
    for part in found:
        result = result.unionByName(part)
    return result


def _listed(queries: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Decide atoms from their full neighbor list, at most eight uncrowded cells long."""
    lists = offsets_within(queries, others, 2 * float(radius), crowded=False).groupBy(*POINT).agg(
        F.collect_list(F.struct("dx", "dy", "dz")).alias("_n"))
    lists = lists.select(*POINT, *[F.col(f"_n.d{a}").alias(f"_d{a}") for a in AXES])
    covered = lists.filter(~_is_exposed(float(radius))).select(*POINT)
    return queries.select(*POINT).join(covered, POINT, "left_anti")


def _image_sites(others: DataFrame) -> DataFrame:
    """Points and images as sites of a nearest join, one per position; the id says whose image it is."""
    return others.groupBy("snapshot_id", *AXES).agg(F.min(F.struct("atom_id", *SHIFT)).alias("site_id"))


def _on_demand(queries: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Decide atoms in crowded places without listing their neighbors.

    Each round places probe balls at centers not covered by the neighbors known so far. A ball whose
    nearest atom is no closer than R proves the atom exposed; otherwise that nearest atom joins the
    known neighbors. No uncovered center left proves the atom interior.
    """
    radius = float(radius)
    sites = stage(_image_sites(others), "sites")
    # atoms at the same place share the answer of the first of them
    place = ["snapshot_id", *AXES]
    firsts = queries.groupBy(*place).agg(F.min("atom_id").alias("first"))
    groups = stage(queries.select(*POINT, *AXES).join(firsts, place).select(*POINT, *AXES, "first"), "groups")
    open_atoms = groups.filter("atom_id = first").select(*POINT, *AXES).withColumns(
        {f"_d{a}": F.array().cast("array<double>") for a in AXES})
    setting = Setting(["snapshot_id"], periodic=False, stretched=False)
    exposed = None
    while True:
        tried = stage(open_atoms.withColumn("_free", _free_centers(radius)), "tried")
        alive = tried.filter(F.size("_free") > 0)
        if alive.isEmpty():
            break
        probes = stage(alive.select(
            *POINT, *AXES, F.posexplode("_free").alias("_at", "_p")
        ).select(
            *POINT,
            (F.col("atom_id") * (WITNESSES + 1) + F.col("_at")).alias("probe_id"),
            *[F.col(a).alias(f"_c{a}") for a in AXES],
            *[(F.col(a) + F.col("_p")[i]).alias(a) for i, a in enumerate(AXES)],
        ), "probes")
        hits = nearest(
            probes.withColumnRenamed("atom_id", "owner").withColumnRenamed("probe_id", "atom_id"), sites, setting
        ).withColumnRenamed("atom_id", "probe_id")
        hits = probes.select("snapshot_id", "atom_id", "probe_id", *[f"_c{a}" for a in AXES]).join(
            hits, ["snapshot_id", "probe_id"])
        delta = {a: F.col(a) - F.col(f"_c{a}") for a in AXES}
        found = stage(
            hits.join(sites, ["snapshot_id", "site_id"])
            .groupBy(*POINT).agg(
                F.max("d2").alias("_clear"),
                F.collect_set(F.struct(*[delta[a].alias(a) for a in AXES])).alias("_hit")),
            "found")
        clear = found.filter(F.sqrt("_clear") >= radius - TOLERANCE).select(*POINT)
        exposed = clear if exposed is None else exposed.unionByName(clear)
        open_atoms = alive.drop("_free").join(
            found.filter(F.sqrt("_clear") < radius - TOLERANCE), POINT
        ).select(*POINT, *AXES, *[F.concat(f"_d{a}", F.col(f"_hit.{a}")).alias(f"_d{a}") for a in AXES])
    if exposed is None:
        return groups.select(*POINT).limit(0)
    chosen = exposed.withColumnRenamed("atom_id", "first")
    return groups.join(chosen, ["snapshot_id", "first"], "left_semi").select(*POINT)


def keep_selected(points: DataFrame, selected: DataFrame) -> DataFrame:
    """Points whose key is in ``selected``."""
    return points.join(selected.select(*POINT), POINT, "left_semi")


def within_surface(
    points: DataFrame,
    distance: float = SURFACE_DISTANCE,
    probe_radius: float = PROBE_RADIUS,
    boxes: DataFrame | None = None,
) -> DataFrame:
    """Atoms nearer than ``distance`` to a surface atom or an image of one, with that ``surface_distance``."""
    home = folded(points, boxes)
    chosen = stage(keep_selected(home, surface_atoms(points, probe_radius, boxes)), "surface")
    sites = with_images(chosen, distance).select("snapshot_id", *AXES, F.struct("atom_id", *SHIFT).alias("site_id"))
    # a surface atom is its own nearest one, so only the others are matched; a place that is no number has no distance
    own = chosen.filter(" and ".join(f"{a} - {a} = 0" for a in AXES)).select(*POINT).distinct().withColumn("d2", F.lit(0.0))
    others = stage(home.drop(*LENGTHS).join(own.select(*POINT), POINT, "left_anti"), "others")
    found = nearest(others, sites, Setting(["snapshot_id"], periodic=False, stretched=False)).select(*POINT, "d2")
    return found.unionByName(own).select(*POINT, F.sqrt("d2").alias("surface_distance")).filter(
        F.col("surface_distance") < distance)
