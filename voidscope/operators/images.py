"""Periodic images as rows, for boxes that repeat along some axes only.

Boxes may carry three flags ``px, py, pz``; without them every axis repeats. They may also be tilted, with ``xy, xz, yz``:
the second cell vector is (xy, ly, 0), the third (xz, yz, lz). A folded cloud has the box length of each repeating axis
in ``l*`` and NULL along open ones, and the tilts in ``t*``; folding along z, then y, then x takes a tilted cell to the
straight box of its three lengths, which repeats by the same vectors. Its images within a reach of the box are rows of their own, with the
shift ``ix, iy, iz`` in whole boxes. Joins with such rows are plain open ones: no minimum image is taken, and a box
smaller than the reach shows a neighbor as often as it is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voidscope.functions.geometry import box_lengths
from voidscope.functions.spread import attach, last_chunk
from voidscope.operators.neighbors import AXES, POINT, SLACK, fullest, near_cells, own_cells, salted_join
from voidscope.session import stage

FLAGS = [f"p{a}" for a in AXES]
TILTS = ["xy", "xz", "yz"]
LENGTHS = [*[f"l{a}" for a in AXES], *[f"t{t}" for t in TILTS]]
SHIFT = [f"i{a}" for a in AXES]
#: Axes in the order of folding, each with the others that its cell vector moves along.
VECTORS = {"z": ("x", "y"), "y": ("x",), "x": ()}


def with_flags(boxes: DataFrame, boundary: str = "boundary") -> DataFrame:
    """Flags from the boundary words of a dump (``pp``, ``ff``, ``ss`` ...): an axis repeats if its word starts with p."""
    return boxes.withColumns({
        f: F.coalesce(F.get(boundary, F.lit(i)).startswith("p"), F.lit(False)) for i, f in enumerate(FLAGS)})


def _periods(boxes: DataFrame) -> DataFrame:
    """``snapshot_id, l*, t*`` and the box centers; the length is NULL along an open axis or an empty one."""
    sized = box_lengths(boxes)
    flags = {f: F.col(f) if f in boxes.columns else F.lit(True) for f in FLAGS}
    return sized.select(
        "snapshot_id", *[((F.col(f"{a}hi") + F.col(f"{a}lo")) / 2).alias(f"m{a}") for a in AXES],
        *[F.when(flags[f"p{a}"] & (F.col(f"l{a}") > 0), F.col(f"l{a}")).alias(f"l{a}") for a in AXES],
        *[(F.coalesce(t, F.lit(0.0)) if t in boxes.columns else F.lit(0.0)).alias(f"t{t}") for t in TILTS])


def _moved(df: DataFrame, a: str, own: Column, boxes: Column) -> DataFrame:
    """``own`` as the new coordinate along ``a``, and the others moved by so many cell vectors of that axis."""
    return df.withColumns({a: own, **{o: F.col(o) + boxes * F.col(f"t{o}{a}") for o in VECTORS[a]}})


def folded(points: DataFrame, boxes: DataFrame | None) -> DataFrame:
    """``snapshot_id, atom_id, x, y, z, l*, t*``: points relative to the box center and folded along the axes that
    repeat, unchanged along the others. Snapshots without a box are open."""
    if boxes is None:
        none = {n: F.lit(None).cast("double") if n.startswith("l") else F.lit(0.0) for n in LENGTHS}
        return points.select(*POINT, *AXES, *[c.alias(n) for n, c in none.items()])
    sizes = points.groupBy("snapshot_id").agg(last_chunk())
    placed = attach(points.select(*POINT, *AXES), stage(sizes.join(_periods(boxes), "snapshot_id", "left"), "periods"))
    placed = placed.withColumns({f"t{t}": F.coalesce(f"t{t}", F.lit(0.0)) for t in TILTS})
    for a in VECTORS:
        length, apart = F.col(f"l{a}"), F.col(a) - F.col(f"m{a}")
        whole = F.when(length.isNull(), F.lit(0.0)).otherwise(F.rint(apart / length))
        placed = _moved(placed.withColumn("_whole", whole), a, F.when(length.isNull(), F.col(a)).otherwise(
            apart - length * F.col("_whole")), -F.col("_whole"))
    return placed.select(*POINT, *AXES, *LENGTHS)


def _shifts(a: str, reach: float) -> Column:
    """Whole boxes by which a point comes within ``reach`` of its box."""
    length, far = F.col(f"l{a}"), F.col(f"l{a}") / 2 + reach * (1 + SLACK)
    first, final = F.ceil((-far - F.col(a)) / length), F.floor((far - F.col(a)) / length)
    # a tilted neighbor box may lie wholly to one side, so the range need not hold 0; it is never empty
    return F.when(length.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, F.greatest(first, final)))


def with_images(home: DataFrame, reach: float) -> DataFrame:
    """The rows of :func:`folded` and their images within ``reach`` of the box, with ``ix, iy, iz``."""
    for a in VECTORS:
        home = home.withColumn(f"i{a}", F.explode(_shifts(a, float(reach))))
        there = F.when(F.col(f"l{a}").isNull(), F.col(a)).otherwise(F.col(a) + F.col(f"i{a}") * F.col(f"l{a}"))
        home = _moved(home, a, there, F.col(f"i{a}"))
    return home.select(*POINT, *AXES, *SHIFT)


def offsets_within(queries: DataFrame, others: DataFrame, radius: float, crowded: bool = True) -> DataFrame:
    """Ordered pairs of a query and another point or image closer than ``radius``: ``atom_id, other_id, ix, iy, iz``,
    the offset ``dx, dy, dz`` and ``d2``. A point is paired with its own images. ``crowded=False`` says that no cell
    is known to hold many points, so none is counted."""
    repeated = near_cells(others, radius, periodic=False).select(
        "snapshot_id", F.col("atom_id").alias("other_id"), *[F.col(a).alias(f"o{a}") for a in AXES], *SHIFT,
        *[f"c{a}" for a in AXES])
    located = own_cells(queries, radius).select(*POINT, *AXES, *[f"c{a}" for a in AXES])
    most = max(fullest(located), fullest(own_cells(others, radius))) if crowded else 0
    joined = salted_join(repeated, located, most)
    home = F.lit(True)
    for i in SHIFT:
        home = home & (F.col(i) == 0)
    joined = joined.filter((F.col("atom_id") != F.col("other_id")) | ~home)
    joined = joined.select(
        *POINT, "other_id", *SHIFT, *[(F.col(f"o{a}") - F.col(a)).alias(f"d{a}") for a in AXES])
    squared = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    return joined.withColumn("d2", squared).filter(F.col("d2") < float(radius) ** 2)


def radius_pairs_images(points: DataFrame, radius: float, boxes: DataFrame | None, both: bool = False) -> DataFrame:
    """Pairs of points and periodic images closer than ``radius``: ``atom_id, other_id, ix, iy, iz, distance``.

    The shift says which image of the other point is meant. Each pair stands once, with ``atom_id < other_id`` or, for a
    point and its own image, with the first shift that is not zero positive; with ``both`` in both directions.
    """
    home = folded(points, boxes)
    close = offsets_within(home, with_images(home, radius), radius)
    if not both:
        forward = F.struct(*SHIFT) > F.struct(*[F.lit(0).cast("long").alias(i) for i in SHIFT])
        close = close.filter(
            (F.col("atom_id") < F.col("other_id")) | ((F.col("atom_id") == F.col("other_id")) & forward))
    return close.select(*POINT, "other_id", *SHIFT, F.sqrt("d2").alias("distance"))
