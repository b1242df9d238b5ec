"""Radius and nearest-neighbor joins on a cell grid, open or periodic.

Both joins bucket one side into cells of one or two reaches and repeat the other side into the cells its
reach touches (27 or 8), so the match is an equi-join on cell keys. The nearest join is exact for
any layout:

* shared sites are first repeated into every cell they can serve; a point, and its images near a face of the box, look
  up one cell each, in the task that reads them where the cells fit the broadcast threshold, and only the best site
  of each point is shuffled;
* a neighbor found within the reach is certified, because every site that close was a candidate;
* points without certificate repeat with twice the reach;
* what is left, and points next to crowded cells, descend a tree of bounding boxes level by level and
  keep only boxes that can still hold the nearest site;
* sites per snapshot meet their points in one task where both fit ``TASK_ROWS``, pruned against boxes there;
* a shared reference of at most ``TASK_SITES`` sites is small enough for the tasks that read the points: those far from
  it, and those without certificate, are pruned against its boxes there, without a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voidscope.functions.geometry import box_lengths, minimum_image, wrapped
from voidscope.functions.spread import attach, chunk, last_chunk, with_last_chunk
from voidscope.session import broadcast_bytes, stage

AXES = "xyz"
POINT = ["snapshot_id", "atom_id"]
START_REACH = 1.25  # in mean site spacings; the deepest hole of a close-packed lattice is at 0.8
REACH_ROUNDS = 2
SITE_BYTES = 64  # of one site in a broadcast table
CROWDED = 256  # sites per cell beyond which its surroundings go down the tree
LEAF = 32
MAX_DEPTH = 30
TASK_SITES = 1 << 13  # sites of a shared reference up to which far points are matched in the task that reads them
_TASK_CELLS = 1 << 15  # points times boxes looked at together there
TASK_ROWS = 1 << 14  # points and own sites of a snapshot up to which they are matched in one task
_CHUNK = 1 << 13  # rows of whole snapshots looked at together
CHUNKED_DEPTH = 3
SLACK = 1e-9
CELL_ROWS = 4096  # rows of one side in one cell of the radius join beyond which the cell is dealt to several tasks
AROUND = 27  # cells whose points can reach into one cell


def wrap_points(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Fold points into their snapshot's box (centered at the origin) and add ``lx, ly, lz``."""
    sized = stage(with_last_chunk(points, box_lengths(boxes)), "boxes")
    folded = attach(points, sized)
    return folded.select(*POINT, *[wrapped(a).alias(a) for a in AXES], *[f"l{a}" for a in AXES])


def wrap_sites(sites: DataFrame, ref_box: dict[str, float]) -> DataFrame:
    """Fold reference sites into the reference box."""
    return sites.withColumns({
        a: minimum_image(
            F.col(a) - (ref_box[f"{a}hi"] + ref_box[f"{a}lo"]) / 2,
            F.lit(float(ref_box[f"{a}hi"] - ref_box[f"{a}lo"])))
        for a in AXES
    })


def _steps(start: Column, stop: Column) -> Column:
    """Ascending integers, empty when ``stop < start``."""
    start, stop = start.cast("long"), stop.cast("long")
    return F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<long>"))


def _touched(u: Column, reach: Column, width: Column, low: Column | None, high: Column | None,
             period: Column | None) -> Column:
    """Cells of one axis that hold any (image of a) site within ``reach`` of ``u``."""
    reach = reach * (1 + SLACK)

    def around(value: Column) -> Column:
        first, final = F.floor((value - reach) / width), F.floor((value + reach) / width)
        if low is not None:
            first, final = F.greatest(first, F.floor(low / width)), F.least(final, F.floor(high / width))
        return _steps(first, final)

    if period is None:
        return around(u)
    shifts = _steps(F.ceil((low - reach - u) / period), F.floor((high + reach - u) / period))
    return F.array_distinct(F.flatten(F.transform(shifts, lambda s: around(u + s * period))))


def _into_cells(df: DataFrame, touched: dict[str, Column]) -> DataFrame:
    """One row per touched cell; the cell is NULL (and joins nothing) where none is.

    The outer form of explode keeps the optimizer from computing the cell lists once more in a filter.
    """
    df = df.withColumns({f"_t{a}": c for a, c in touched.items()})
    for a in AXES:
        df = df.withColumn(f"c{a}", F.explode_outer(f"_t{a}")).drop(f"_t{a}")
    return df


def _in_cells(df: DataFrame, width: Column) -> DataFrame:
    return df.withColumns({f"c{a}": F.floor(F.col(a) / width) for a in AXES})


CELL = [f"c{a}" for a in AXES]


# ---------------------------------------------------------------- radius join


def radius_pairs(
    points: DataFrame, radius: float, boxes: DataFrame | None = None, both: bool = False
) -> DataFrame:
    """Pairs of points of one snapshot closer than ``radius``: ``atom_id, other_id, distance``.

    Each pair appears once with ``atom_id < other_id``, or in both directions with ``both``. With
    ``boxes`` distances are minimum-image.
    """
    placed = wrap_points(points, boxes) if boxes is not None else points.select(*POINT, *AXES)
    close = pairs_within(placed, placed, radius, periodic=boxes is not None)
    if not both:
        close = close.filter(F.col("atom_id") < F.col("other_id"))
    return close.select(*POINT, "other_id", F.sqrt("d2").alias("distance"))


def near_cells(placed: DataFrame, radius: float, periodic: bool) -> DataFrame:
    """Repeat every point into the cells of edge ``2 * radius`` its radius touches."""
    bounds = {a: (-F.col(f"l{a}") / 2, F.col(f"l{a}") / 2, F.col(f"l{a}")) if periodic else (None, None, None)
              for a in AXES}
    reach = F.lit(float(radius))
    return _into_cells(placed, {a: _touched(F.col(a), reach, 2 * reach, *bounds[a]) for a in AXES})


def own_cells(placed: DataFrame, radius: float) -> DataFrame:
    """Cell of edge ``2 * radius`` that holds the point."""
    return _in_cells(placed, F.lit(2 * float(radius)))


def fullest(located: DataFrame) -> int:
    return located.groupBy("snapshot_id", *CELL).count().agg(F.max("count")).first()[0] or 0


def salted_join(repeated: DataFrame, located: DataFrame, most: int) -> DataFrame:
    """Join of ``repeated`` (with ``other_id``) and ``located`` (with ``atom_id``) on their cells; ``most`` is the
    largest number of points in one cell before they were repeated.

    Cells with more than ``CELL_ROWS`` rows on a side are cut: each side is dealt into lots by id and repeated for every
    lot of the other side, so no task pairs more than about ``CELL_ROWS`` rows with as many. All other cells
    join as they are.
    """
    keys = ["snapshot_id", *CELL]
    if most * AROUND <= CELL_ROWS:
        return repeated.join(located, keys)

    def full(side: DataFrame, name: str) -> DataFrame:
        counted = side.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > CELL_ROWS)
        return counted.select(*keys, F.ceil(F.col("n") / CELL_ROWS).cast("int").alias(name))

    crowded = stage(full(repeated, "_others").join(full(located, "_own"), keys, "full"), "crowded")
    if crowded.isEmpty():
        return repeated.join(located, keys)
    lots = {n: F.coalesce(F.col(n), F.lit(1)) for n in ("_others", "_own")}

    def dealt(side: DataFrame, row_id: str, own: str, other: str) -> DataFrame:
        """The side's own lot by id, and one copy of each row for every lot of the other side."""
        there = side.join(crowded, keys, "left")
        copies = F.sequence(F.lit(0), lots[other] - 1)
        return there.withColumn(f"{own}_lot", F.pmod(F.xxhash64(row_id), lots[own]).cast("int")).withColumn(
            f"{other}_lot", F.explode(copies)).drop("_others", "_own")

    return dealt(repeated, "other_id", "_others", "_own").join(
        dealt(located, "atom_id", "_own", "_others"), [*keys, "_others_lot", "_own_lot"]).drop("_others_lot", "_own_lot")


def pairs_within(queries: DataFrame, others: DataFrame, radius: float, periodic: bool) -> DataFrame:
    """Ordered pairs of different points closer than ``radius``, with the offset ``dx, dy, dz`` and ``d2``.

    The others are repeated, so all partners of a query point come from one task and a following
    aggregation per point combines them before its shuffle.
    """
    lengths = [f"l{a}" for a in AXES] if periodic else []
    repeated = near_cells(others, radius, periodic).select(
        "snapshot_id", F.col("atom_id").alias("other_id"), *[F.col(a).alias(f"o{a}") for a in AXES], *lengths, *CELL)
    # the side that is not repeated comes second and is narrower, so a small cloud is broadcast unrepeated
    located = own_cells(queries, radius).select(*POINT, *AXES, *CELL)
    most = fullest(located) if others is queries else max(fullest(located), fullest(own_cells(others, radius)))
    joined = salted_join(repeated, located, most).filter(F.col("atom_id") != F.col("other_id"))
    offset = {a: F.col(f"o{a}") - F.col(a) for a in AXES}
    if periodic:
        offset = {a: minimum_image(offset[a], F.col(f"l{a}")) for a in AXES}
    joined = joined.select(*POINT, "other_id", *[offset[a].alias(f"d{a}") for a in AXES])
    squared = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    return joined.withColumn("d2", squared).filter(F.col("d2") < float(radius) ** 2)


# ---------------------------------------------------------------- nearest join


@dataclass(frozen=True)
class Setting:
    """How queries (``x, y, z`` [, ``l*`` period][, ``s*`` stretch]) see sites keyed by ``by``."""

    by: list[str]
    periodic: bool
    stretched: bool
    exclude_self: bool = False
    few_sites: bool = False

    def stretch(self, a: str) -> Column:
        return F.col(f"s{a}") if self.stretched else F.lit(1.0)

    def own(self, a: str) -> Column:
        """Query coordinate in site units."""
        return F.col(a) / F.col(f"s{a}") if self.stretched else F.col(a)

    def period(self, a: str) -> Column | None:
        if not self.periodic:
            return None
        return F.col(f"l{a}") / F.col(f"s{a}") if self.stretched else F.col(f"l{a}")

    def delta(self, a: str, site: Column) -> Column:
        mapped = site * F.col(f"s{a}") if self.stretched else site
        difference = mapped - F.col(a)
        return minimum_image(difference, F.col(f"l{a}")) if self.periodic else difference

    def least_stretch(self) -> Column:
        return F.least(*[F.col(f"s{a}") for a in AXES]) if self.stretched else F.lit(1.0)

    def query_columns(self) -> list[str]:
        return [*POINT, *AXES, *([f"l{a}" for a in AXES] if self.periodic else []),
                *([f"s{a}" for a in AXES] if self.stretched else [])]


GRID_COLUMNS = [*[f"g_lo{a}" for a in AXES], *[f"g_hi{a}" for a in AXES], "g_reach", "g_edge"]


def _site_grid(sites: DataFrame, by: list[str]) -> DataFrame:
    """Extent of the sites, starting reach and root edge, overall or per snapshot."""
    extents = sites.groupBy(*by).agg(
        F.count("*").alias("_n"),
        *[F.min(a).alias(f"g_lo{a}") for a in AXES],
        *[F.max(a).alias(f"g_hi{a}") for a in AXES],
    ).filter(F.col("_n") > 0)
    spans = [F.col(f"g_hi{a}") - F.col(f"g_lo{a}") for a in AXES]
    extents = extents.withColumn("_span", F.greatest(*spans))
    safe = [F.greatest(s, F.col("_span") * 1e-3) for s in spans]
    spacing = F.cbrt(safe[0] * safe[1] * safe[2] / F.col("_n"))
    return extents.select(
        *by, "_n", *GRID_COLUMNS[:6],
        F.when(F.col("_span") > 0, spacing * START_REACH).otherwise(1.0).alias("g_reach"),
        F.when(F.col("_span") > 0, F.col("_span") * (1 + SLACK)).otherwise(1.0).alias("g_edge"),
    )


def _with_grid(df: DataFrame, grid: DataFrame, row: Row | None, row_id: str) -> DataFrame:
    """Attach the grid: one driver row for shared sites, a chunked join for sites per snapshot."""
    if row is not None:
        return df.withColumns({c: F.lit(row[c]) for c in GRID_COLUMNS})
    if row_id == "atom_id":
        return attach(df, stage(with_last_chunk(df, grid), "grid"))
    # the id of an image is a struct that starts with the atom's
    number = f"{row_id}.atom_id" if isinstance(df.schema[row_id].dataType, StructType) else row_id
    numbered = df.withColumn("atom_id", F.col(number))
    return attach(numbered, stage(with_last_chunk(numbered, grid), "grid")).drop("atom_id")


def _squared(setting: Setting, prefix: str) -> Column:
    deltas = [setting.delta(a, F.col(f"{prefix}{a}")) for a in AXES]
    return deltas[0] * deltas[0] + deltas[1] * deltas[1] + deltas[2] * deltas[2]


def _best(pairs: DataFrame) -> DataFrame:
    """Closest candidate per point, the lowest site id on a tie."""
    candidate = F.when(F.col("site_id").isNotNull(), F.struct("d2", "site_id"))
    return pairs.groupBy(*POINT).agg(F.min(candidate).alias("_b")).select(
        *POINT, F.col("_b.site_id").alias("site_id"), F.col("_b.d2").alias("d2"))


def _reach_round(queries: DataFrame, sites: DataFrame, setting: Setting, factor: float):
    """One cell join: (point, best site or NULL, certified), and the points next to crowded cells."""
    by = setting.by
    reach = F.col("g_reach") * factor
    # few sites are broadcast, where finer cells cost no shuffle and leave fewer candidates
    width = reach if setting.few_sites else 2 * reach
    placed = _in_cells(sites, width).select(
        *by, "site_id", *[F.col(a).alias(f"o{a}") for a in AXES], *CELL)
    if setting.few_sites:
        placed = F.broadcast(placed)
    touched = {
        a: _touched(setting.own(a), reach, width, F.col(f"g_lo{a}"), F.col(f"g_hi{a}"), setting.period(a))
        for a in AXES
    }
    crowded = stage(
        placed.groupBy(*by, *CELL).count().filter(F.col("count") > CROWDED).drop("count"), "crowded")
    beside = None
    if not crowded.isEmpty():
        beside = stage(
            _into_cells(queries, touched).join(crowded, [*by, *CELL], "left_semi").select(*POINT).distinct(),
            "beside")
        queries = queries.join(beside, POINT, "left_anti")
    pairs = _into_cells(queries, touched).join(placed, [*by, *CELL])
    if setting.exclude_self:
        pairs = pairs.filter(F.col("atom_id") != F.col("site_id"))
    sure = reach * setting.least_stretch()
    # only sites within reach can be certified; the empty candidate keeps points without any
    best = F.struct(_squared(setting, "o").alias("d2"), "site_id")
    close = pairs.select(*POINT, best.alias("best"), (sure * sure).alias("sure")).filter("best.d2 <= sure")
    alone = queries.select(*POINT).withColumn("best", F.lit(None).cast(close.schema["best"].dataType))
    return close.drop("sure").unionByName(alone).groupBy(*POINT).agg(F.min("best").alias("best")).select(
        *POINT, "best.site_id", "best.d2", F.col("best").isNotNull().alias("certified")), beside


def _image_cells(setting: Setting, grid: Row, a: str) -> Column:
    """Cells of one axis, of edge ``g_reach``, that hold the point or an image of it near the sites."""
    reach = float(grid["g_reach"])
    far = reach * (1 + SLACK)
    own, period = setting.own(a), setting.period(a)
    if period is None:
        return F.array(F.floor(own / reach))
    low, high = grid[f"g_lo{a}"] - far, grid[f"g_hi{a}"] + far
    shifts = _steps(F.ceil((low - own) / period), F.floor((high - own) / period))
    return F.array_distinct(F.transform(shifts, lambda n: F.floor((own + n * period) / reach)))


def _lacking(setting: Setting) -> Column:
    """Whether a query lacks a coordinate, a length or a stretch."""
    lacking = F.lit(False)
    for c in setting.query_columns()[len(POINT):]:
        lacking = lacking | F.col(c).isNull()
    return lacking


def _in_sight(setting: Setting, grid: Row) -> Column:
    """Whether the point or an image of it lies within the starting reach of the extent of the sites, or lacks a value."""
    far = float(grid["g_reach"]) * (1 + SLACK)
    seen = F.lit(True)
    for a in AXES:
        own, period = setting.own(a), setting.period(a)
        low, high = F.lit(grid[f"g_lo{a}"] - far), F.lit(grid[f"g_hi{a}"] + far)
        seen = seen & (own.between(low, high) if period is None
                       else F.ceil((low - own) / period) <= F.floor((high - own) / period))
    return _lacking(setting) | seen


def _lookup_round(queries: DataFrame, sites: DataFrame, setting: Setting, grid: Row) -> DataFrame:
    """(point, best site or NULL, certified) for shared sites: every cell holds the sites that serve it, so a point
    joins with the cell it lies in and, within reach of a face of its box, with those of its images.

    Cells that more than ``CROWDED`` sites serve hold a mark instead, and points that meet one get no certificate.
    """
    reach = float(grid["g_reach"])
    far = reach * (1 + SLACK)
    served = _into_cells(
        sites.select("site_id", *[F.col(a).alias(f"o{a}") for a in AXES]),
        {a: _steps(F.floor((F.col(f"o{a}") - far) / reach), F.floor((F.col(f"o{a}") + far) / reach)) for a in AXES})
    most, entries = served.groupBy(*CELL).count().agg(F.max("count"), F.sum("count")).first()
    if most > CROWDED:
        full = served.groupBy(*CELL).count().filter(F.col("count") > CROWDED).drop("count")
        served = served.join(full, CELL, "left_anti").unionByName(full, allowMissingColumns=True)
    if entries * SITE_BYTES <= broadcast_bytes(sites.sparkSession):
        served = F.broadcast(served)

    pairs = _into_cells(queries, {a: _image_cells(setting, grid, a) for a in AXES}).join(served, CELL)
    sure = F.lit(reach) * setting.least_stretch()
    squared = F.when(F.col("site_id").isNull(), F.lit(-1.0)).otherwise(_squared(setting, "o"))
    close = pairs.select(*POINT, F.struct(squared.alias("d2"), "site_id").alias("best"),
                         (sure * sure).alias("sure")).filter("best.d2 <= sure").drop("sure")
    alone = queries.select(*POINT).withColumn("best", F.lit(None).cast(close.schema["best"].dataType))
    return close.unionByName(alone).groupBy(*POINT).agg(F.min("best").alias("best")).select(
        *POINT, "best.site_id", "best.d2", F.col("best.site_id").isNotNull().alias("certified"))


def _leaf_boxes(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the places in which runs of at most ``LEAF`` lie close together, and the starts of the runs."""
    order, starts, waiting = [], [0], [np.arange(len(places))]
    while waiting:
        part = waiting.pop()
        if len(part) <= LEAF:
            order.append(part)
            starts.append(starts[-1] + len(part))
            continue
        along = places[part, np.ptp(places[part], axis=0).argmax()]
        part = part[np.argsort(along, kind="stable")]
        waiting += [part[:len(part) // 2], part[len(part) // 2:]]
    return np.concatenate(order), np.array(starts[:-1])


def _search(places: np.ndarray, ids: np.ndarray, periodic: bool):
    """Function (points, lengths, stretches) -> (site ids, squared distances) over the given sites, exact."""
    order, starts = _leaf_boxes(places)
    places, ids = places[order], ids[order]
    sizes = np.diff(np.r_[starts, len(places)])
    low, high = (f.reduceat(places, starts, axis=0) for f in (np.minimum, np.maximum))
    middle, half = (high + low) / 2, (high - low) / 2
    slack = (places.max(axis=0) - places.min(axis=0)).max() * SLACK
    step = max(1, _TASK_CELLS // len(starts))

    def image(delta, length):
        return delta - length * np.rint(delta / length) if periodic else delta

    def some(x, l, s):
        near, far = np.zeros((len(x), len(starts))), np.zeros((len(x), len(starts)))
        for a in range(3):
            length, stretch = l[:, a, None], s[:, a, None]
            apart, wide = np.abs(image(middle[:, a] * stretch - x[:, a, None], length)), half[:, a] * stretch
            least, most = np.maximum(0.0, apart - wide), apart + wide
            if periodic:
                most = np.minimum(most, length / 2)
            near += least * least
            far += most * most
        bound = np.sqrt(far.min(axis=1))
        bound = bound + (bound + slack * s.min(axis=1)) * SLACK + slack * s.min(axis=1)
        kept = ~(np.sqrt(near) > bound[:, None])  # also where the distance is not a number
        point, leaf = np.nonzero(kept)
        count = sizes[leaf]
        ends = np.cumsum(count)
        site = np.arange(ends[-1]) - np.repeat(ends - count - starts[leaf], count)
        point = np.repeat(point, count)
        squared = 0.0
        for a in range(3):
            delta = image(places[site, a] * s[point, a] - x[point, a], l[point, a])
            squared = squared + delta * delta
        squared = np.where(np.isnan(squared), np.inf, squared)
        first = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
        best = np.minimum.reduceat(squared, first)
        last = np.iinfo(ids.dtype).max
        return np.minimum.reduceat(np.where(squared == best[point], ids[site], last), first), best

    def run(x, l, s):
        with np.errstate(invalid="ignore"):
            parts = [some(x[i:i + step], l[i:i + step], s[i:i + step]) for i in range(0, len(x), step)]
        found, squared = (np.concatenate(p) for p in zip(*parts))
        return found, np.where(np.isnan(x).any(axis=1), np.nan, squared)

    return run


def _in_task(queries: DataFrame, sites: DataFrame, setting: Setting) -> DataFrame:
    """``site_id, d2`` of each query among at most ``TASK_SITES`` shared sites, in the task that reads the query."""
    rows = sites.select("site_id", *AXES).filter(
        " and ".join(f"{c} is not null and not isnan({c})" for c in AXES) + " and site_id is not null").collect()
    search = _search(np.array([[r[a] for a in AXES] for r in rows], float), np.array([r["site_id"] for r in rows]), setting.periodic)
    columns = setting.query_columns()
    groups = [[f"{p}{a}" for a in AXES] for p in ("", "l", "s")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, l, s = (
                np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in group], axis=1)
                if group[0] in columns else np.ones((batch.num_rows, 3)) for group in groups)
            if setting.periodic:  # a place that is no number cannot be folded and has no site
                real = np.isfinite(x).all(axis=1)
                if not real.all():
                    batch, x, l, s = batch.filter(pa.array(real)), x[real], l[real], s[real]
                    if not len(x):
                        continue
            found, squared = search(x, l, s)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in POINT), pa.array(found), pa.array(squared)], [*POINT, "site_id", "d2"])

    known = queries.select(*columns).filter(~_lacking(setting))
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *sites.schema]}
    return known.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in [*POINT, "site_id"]) + ", d2 double")


def _tree_descent(queries: DataFrame, sites: DataFrame, setting: Setting) -> DataFrame:
    """Exact nearest site for the given points by pruning bounding boxes from the root down."""
    by = setting.by
    unique = sites.groupBy(*by, *AXES, *GRID_COLUMNS).agg(F.min("site_id").alias("site_id"))
    depth = 0
    while True:
        edge = F.col("g_edge") / (1 << depth)
        leaves = unique.withColumns({f"c{a}": F.floor((F.col(a) - F.col(f"g_lo{a}")) / edge) for a in AXES})
        fullest = leaves.groupBy(*by, *CELL).count().agg(F.max("count")).first()[0] or 0
        if fullest <= LEAF or depth >= MAX_DEPTH:
            break
        # a full leaf of an even layout needs log8(count / LEAF) more halvings
        depth = min(MAX_DEPTH, depth + max(1, ((fullest // LEAF).bit_length() - 1) // 3))
    leaves = stage(leaves.select(*by, "site_id", *[F.col(a).alias(f"o{a}") for a in AXES], *CELL), "leaves")
    boxes = stage(leaves.groupBy(*by, *CELL).agg(
        F.count("*").alias("k"),
        *[F.min(f"o{a}").alias(f"lo{a}") for a in AXES],
        *[F.max(f"o{a}").alias(f"hi{a}") for a in AXES]), "boxes")

    frontier = queries.withColumns({c: F.lit(0).cast("long") for c in CELL})
    if setting.exclude_self:  # the point's own leaf, to recognize boxes holding nothing but the point
        edge = F.col("g_edge") / (1 << depth)
        frontier = frontier.withColumns(
            {f"own{a}": F.floor((F.col(a) - F.col(f"g_lo{a}")) / edge) for a in AXES})
    frontier = frontier.withColumn("_slack", F.col("g_edge") * SLACK * setting.least_stretch()).drop(*GRID_COLUMNS)
    point = Window.partitionBy(*POINT)
    for level in range(1, depth + 1):
        up = depth - level
        nodes = boxes.groupBy(*by, *[F.shiftright(c, up).alias(c) for c in CELL]).agg(
            F.sum("k").alias("k"),
            *[F.min(f"lo{a}").alias(f"lo{a}") for a in AXES],
            *[F.max(f"hi{a}").alias(f"hi{a}") for a in AXES],
        ).withColumns({f"p{a}": F.shiftright(f"c{a}", 1) for a in AXES}).withColumnsRenamed(
            {f"c{a}": f"n{a}" for a in AXES})
        parents = frontier.withColumnsRenamed({f"c{a}": f"p{a}" for a in AXES})
        keys = [*by, *[f"p{a}" for a in AXES]]
        if level <= CHUNKED_DEPTH and by:  # few boxes per snapshot: one copy for every chunk of its points
            sizes = queries.groupBy("snapshot_id").agg(last_chunk())
            nodes = nodes.join(sizes, "snapshot_id").withColumn(
                "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_chunk")))).drop("last_chunk")
            parents, keys = parents.withColumn("chunk", chunk()), [*keys, "chunk"]
        elif level <= CHUNKED_DEPTH:
            nodes = F.broadcast(nodes)  # at most 8^level rows
        grown = parents.join(nodes, keys).drop("chunk", *[f"p{a}" for a in AXES])
        near, far = F.lit(0.0), F.lit(0.0)
        for a in AXES:
            half = (F.col(f"hi{a}") - F.col(f"lo{a}")) / 2 * setting.stretch(a)
            apart = F.abs(setting.delta(a, (F.col(f"hi{a}") + F.col(f"lo{a}")) / 2))
            least, most = F.greatest(F.lit(0.0), apart - half), apart + half
            if setting.periodic:
                most = F.least(most, F.col(f"l{a}") / 2)
            near, far = near + least * least, far + most * most
        grown = grown.withColumns({"_near": F.sqrt(near), "_far": F.sqrt(far)})
        if setting.exclude_self:
            alone = F.col("k") == 1
            for a in AXES:
                alone = alone & (F.col(f"n{a}") == F.shiftright(f"own{a}", up))
            grown = grown.filter(~alone)
        kept = grown.withColumn("_bound", F.min("_far").over(point)).filter(
            F.col("_near") <= F.col("_bound") + F.col("_slack"))
        frontier = kept.drop("k", "_near", "_far", "_bound", *[f"{e}{a}" for e in ("lo", "hi") for a in AXES]
                             ).withColumnsRenamed({f"n{a}": f"c{a}" for a in AXES})
    pairs = frontier.join(leaves, [*by, *CELL])
    if setting.exclude_self:
        pairs = pairs.filter(F.col("atom_id") != F.col("site_id"))
    return _best(pairs.withColumn("d2", _squared(setting, "o")))


def whole_snapshots(
    rows: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str, chunk_rows: int
) -> DataFrame:
    """``answer`` of tables of whole snapshots, each in one task, of about ``chunk_rows`` rows or one larger snapshot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            waiting += batch.num_rows
            if waiting < chunk_rows:
                continue
            table = pa.Table.from_batches(held)
            last = table.column("snapshot_id")[-1]
            cut = pc.index(table.column("snapshot_id"), last).as_py()  # the last snapshot may go on in the next batch
            if cut:
                yield from answer(table.slice(0, cut)).combine_chunks().to_batches()
            held, waiting = table.slice(cut).to_batches(), 0 if cut else -chunk_rows // 2
        if held:
            yield from answer(pa.Table.from_batches(held)).combine_chunks().to_batches()

    spark = rows.sparkSession
    # a fixed number, since the work of a task is not told by its bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "snapshot_id").sortWithinPartitions("snapshot_id").mapInArrow(run, schema)


def numbered_groups(table: pa.Table) -> np.ndarray:
    """Numbers from 0 of the snapshots of a table in which each is one run of rows."""
    names = table.column("snapshot_id").combine_chunks()
    return np.cumsum(np.r_[False, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)])


def _ranks(ids: pa.ChunkedArray) -> np.ndarray:
    """Places of the ids in their order; ids may be structs."""
    ids = ids.combine_chunks()
    fields = ids.flatten() if pa.types.is_struct(ids.type) else [ids]
    names = [str(i) for i in range(len(fields))]
    order = pc.sort_indices(pa.table(fields, names), sort_keys=[(n, "ascending") for n in names])
    ranks = np.empty(len(ids), int)
    ranks[order.to_numpy()] = np.arange(len(ids))
    return ranks


def _among_few(x, l, s, places, ranks, first, count, periodic: bool):
    """(rank of the nearest site, squared distance) of each point among the run of sites of its snapshot."""
    ends = np.cumsum(count)
    found, best, begin = np.empty(len(x), int), np.empty(len(x)), 0
    while begin < len(x):
        before = ends[begin] - count[begin]
        end = max(begin + 1, int(np.searchsorted(ends, before + _TASK_CELLS, side="right")))
        size = count[begin:end]
        starts = np.cumsum(size) - size
        site = np.arange(size.sum()) - np.repeat(starts - first[begin:end], size)
        point = np.repeat(np.arange(begin, end), size)
        squared = 0.0
        for a in range(3):
            delta = places[site, a] * s[point, a] - x[point, a]
            if periodic:
                delta = delta - l[point, a] * np.rint(delta / l[point, a])
            squared = squared + delta * delta
        best[begin:end] = np.minimum.reduceat(squared, starts)
        tied = np.where(squared == best[point], ranks[site], np.iinfo(int).max)
        found[begin:end] = np.minimum.reduceat(tied, starts)
        begin = end
    return found, best


def _with_own_sites(queries: DataFrame, sites: DataFrame, setting: Setting) -> DataFrame:
    """``site_id, d2`` of each query among the sites of its snapshot, every snapshot in one task; all values are numbers."""
    columns = setting.query_columns()
    groups = [[f"{p}{a}" for a in AXES] for p in ("", "l", "s")]
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in [*queries.schema, *sites.schema]}
    rows = queries.filter(F.col("atom_id").isNotNull()).select(*columns, empty["site_id"], F.lit(False).alias("_site")).unionByName(
        sites.select("snapshot_id", "site_id", *[F.col(a).cast(queries.schema[a].dataType).alias(a) for a in AXES],
                     *[empty[c] for c in columns if c not in ("snapshot_id", *AXES)], F.lit(True).alias("_site")))

    def matched(table: pa.Table) -> pa.Table:
        group, at_site = numbered_groups(table), table.column("_site").to_numpy()
        asked, offered = table.filter(pa.array(~at_site)), table.filter(pa.array(at_site))
        places = np.stack([offered.column(a).to_numpy().astype(float) for a in AXES], axis=1)
        x, l, s = (np.stack([asked.column(c).to_numpy().astype(float) for c in part], axis=1)
                   if part[0] in columns else np.ones((len(asked), 3)) for part in groups)
        mine, theirs, ranks = group[~at_site], group[at_site], _ranks(offered.column("site_id"))
        first, end = np.searchsorted(theirs, mine), np.searchsorted(theirs, mine, side="right")
        count = end - first
        found, best = np.full(len(asked), -1), np.full(len(asked), np.inf)
        few = np.flatnonzero((count > 0) & (count <= 2 * LEAF))
        with np.errstate(over="ignore"):
            if len(few):
                found[few], best[few] = _among_few(
                    x[few], l[few], s[few], places, ranks, first[few], count[few], setting.periodic)
            many = np.flatnonzero(count > 2 * LEAF)
            for part in np.split(many, np.flatnonzero(np.diff(mine[many])) + 1) if len(many) else []:
                own = slice(first[part[0]], end[part[0]])
                found[part], best[part] = _search(places[own], ranks[own], setting.periodic)(x[part], l[part], s[part])
        # a repeated point has one answer
        number = asked.column("atom_id").to_numpy()
        order = np.lexsort((found, best, number, mine))
        new = np.r_[True, (np.diff(number[order]) != 0) | (np.diff(mine[order]) != 0)][:len(order)]
        kept = order[new & (count[order] > 0)]
        site = offered.column("site_id").take(pa.array(np.argsort(ranks)[found[kept]]))
        return asked.select(POINT).take(pa.array(kept)).append_column("site_id", site).append_column("d2", pa.array(best[kept]))

    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *sites.schema]}
    schema = ", ".join(f"{c} {types[c]}" for c in [*POINT, "site_id"]) + ", d2 double"
    return whole_snapshots(rows, matched, schema, _CHUNK)


def nearest(queries: DataFrame, sites: DataFrame, setting: Setting) -> DataFrame:
    """Exact nearest site of every query point: ``site_id`` and squared distance ``d2``.

    Sites per snapshot are matched in one task per snapshot where both sides are small and all their values numbers.
    """
    if not setting.by or setting.exclude_self:
        return _nearest_joined(queries, sites, setting)
    sites = sites.select(*setting.by, "site_id", *AXES)

    def odd(columns) -> Column:
        known = F.lit(True)
        for c in columns:
            known = known & F.coalesce(F.col(c) - F.col(c) == 0, F.lit(False))
        return F.max(~known)

    values = setting.query_columns()[len(POINT):]
    asked = queries.groupBy(*setting.by).agg(F.count("*").alias("_q"), odd(values).alias("_odd"))
    offered = sites.groupBy(*setting.by).agg(
        F.count("*").alias("_s"), (odd(AXES) | F.max(F.col("site_id").isNull())).alias("_strange"))
    large = stage(asked.join(offered, setting.by).filter(
        (F.col("_q") + F.col("_s") > TASK_ROWS) | F.col("_odd") | F.col("_strange")).select(*setting.by), "large")
    if large.isEmpty():
        return _with_own_sites(queries, sites, setting)
    few, rest = ([d.join(large, setting.by, how) for d in (queries, sites)] for how in ("left_anti", "left_semi"))
    return _with_own_sites(*few, setting).unionByName(_nearest_joined(*rest, setting))


def _nearest_joined(queries: DataFrame, sites: DataFrame, setting: Setting) -> DataFrame:
    """:func:`nearest` by joins on cells and a tree of boxes."""
    row = None
    if setting.by:
        grid = stage(_site_grid(sites, setting.by).drop("_n"), "grid")
    else:
        sites = stage(sites.select("site_id", *AXES), "sites")
        grid = _site_grid(sites, setting.by)
        row = grid.first()
        if row is None:
            raise ValueError("no reference sites")
        setting = replace(setting, few_sites=row["_n"] * SITE_BYTES <= broadcast_bytes(sites.sparkSession))
    queries = _with_grid(queries.select(*setting.query_columns()), grid, row, "atom_id")
    sites = _with_grid(sites.select(*setting.by, "site_id", *AXES), grid, row, "site_id")
    in_task = row is not None and row["_n"] <= TASK_SITES and setting.few_sites and not setting.exclude_self
    answers, descending, remaining, far = [], [], queries, None
    if in_task:
        seen = _in_sight(setting, row)
        remaining, far = queries.filter(seen), queries.filter(~seen)
    for turn in range(REACH_ROUNDS):
        beside = None
        if turn == 0 and not setting.by:
            best = _lookup_round(remaining, sites, setting, row)
        else:
            best, beside = _reach_round(remaining, sites, setting, 2.0**turn)
        best = stage(best, "nearest")
        answers.append(best.filter("certified"))
        if beside is not None:
            descending.append(beside)
        unsure = best.filter(~F.col("certified")).select(*POINT)
        if unsure.isEmpty():
            break
        remaining = queries.join(unsure, POINT, "left_semi")
        if in_task:
            break
        if turn == REACH_ROUNDS - 1:
            descending.append(unsure)
    found = [a.select(*POINT, "site_id", "d2") for a in answers]
    rest = None
    for more in descending:
        rest = more if rest is None else rest.unionByName(more)
    if in_task:
        found.append(_in_task(far if unsure.isEmpty() else far.unionByName(remaining), sites, setting))
        lacking = remaining.filter(_lacking(setting))
        if not unsure.isEmpty() and not lacking.isEmpty():
            found.append(_tree_descent(lacking, sites, setting))
    elif rest is not None:
        found.append(_tree_descent(queries.join(rest, POINT, "left_semi"), sites, setting))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    # a repeated point has one answer, wherever its rows were matched
    return _best(result) if in_task else result


def nearest_site(
    points: DataFrame,
    sites: DataFrame,
    boxes: DataFrame | None = None,
    ref_box: dict[str, float] | None = None,
    periodic: bool = True,
    affine: bool = False,
) -> DataFrame:
    """Assign every atom to its nearest reference site: ``site_id, distance``; ties take the lowest id.

    ``sites`` (``site_id, x, y, z``) is one reference for all snapshots, or one per snapshot if it has a
    ``snapshot_id``. ``periodic`` folds atoms into their own box and sites into ``ref_box`` and measures
    in the atoms' box; ``affine`` scales sites by box length over reference length per axis.
    """
    queries, placed, setting = prepare(points, sites, boxes, ref_box, periodic, affine)
    return nearest(queries, placed, setting).select(*POINT, "site_id", F.sqrt("d2").alias("distance"))


def prepare(points, sites, boxes, ref_box, periodic, affine):
    if (periodic or affine) and (boxes is None or ref_box is None):
        raise ValueError("periodic and affine matching need boxes and ref_box")
    by = ["snapshot_id"] if "snapshot_id" in sites.columns else []
    queries = points.select(*POINT, *AXES)
    if periodic:
        queries, sites = wrap_points(points, boxes), wrap_sites(sites, ref_box)
    elif affine:
        sized = stage(with_last_chunk(points, box_lengths(boxes)), "boxes")
        queries = attach(queries, sized).select(*POINT, *AXES, *[f"l{a}" for a in AXES])
    if affine:
        queries = queries.withColumns({
            f"s{a}": F.col(f"l{a}") / (ref_box[f"{a}hi"] - ref_box[f"{a}lo"]) for a in AXES})
    return queries, sites, Setting(by, periodic, affine)


def nearest_other(points: DataFrame) -> DataFrame:
    """Distance from every distinct position to the nearest other point of its snapshot.

    ``copies`` counts the atoms at the position; with more than one the distance is 0.
    """
    positions = stage(
        points.groupBy("snapshot_id", *AXES).agg(
            F.min("atom_id").alias("atom_id"), F.count("*").alias("copies")), "positions")
    single = positions.filter("copies = 1")
    sites = positions.select("snapshot_id", F.col("atom_id").alias("site_id"), *AXES)
    setting = Setting(["snapshot_id"], periodic=False, stretched=False, exclude_self=True)
    found = nearest(single, sites, setting)
    distances = found.select(*POINT, F.sqrt("d2").alias("distance"), F.lit(1).cast("long").alias("copies"))
    repeated = positions.filter("copies > 1").select(*POINT, F.lit(0.0).alias("distance"), "copies")
    return distances.unionByName(repeated)
