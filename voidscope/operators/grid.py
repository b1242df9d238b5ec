"""10x10x10 occupancy grid: cells, occupancy, gradients, entropy and inertia."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voidscope.functions.geometry import with_eigenvalues

GRID = 10
GRID_EPSILON = 1e-12
_SCATTER = ("_cxx", "_cyy", "_czz", "_cxy", "_cxz", "_cyz")


def cell_code(coordinates: tuple[str, str, str], box: Column) -> Column:
    """``ix*100 + iy*10 + iz`` of the occupied cell, NULL outside the box."""
    index = [
        F.when(box > 0, F.floor((F.col(c) + box / 2) / (box / GRID))) for c in coordinates
    ]
    inside = index[0].between(0, GRID - 1) & index[1].between(0, GRID - 1) & index[2].between(0, GRID - 1)
    return F.when(inside, (index[0] * GRID + index[1]) * GRID + index[2]).cast("int")


def code_axes(code: Column) -> tuple[Column, Column, Column]:
    return F.floor(code / (GRID * GRID)), F.floor(code / GRID) % GRID, code % GRID


def grid_cells(aligned: DataFrame) -> DataFrame:
    """Distinct occupied cells of points carrying ``pc1..pc3`` and ``box_size``."""
    code = cell_code(("pc1", "pc2", "pc3"), F.col("box_size"))
    codes = aligned.select("snapshot_id", code.alias("code")).filter(F.col("code").isNotNull()).distinct()
    ix, iy, iz = code_axes(F.col("code"))
    return codes.select(
        "snapshot_id", ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), iz.cast("int").alias("iz")
    )


def cell_aggregates(code: Column) -> dict[str, Column]:
    """Aggregates over distinct occupied cell codes of one snapshot (at most 1000 of them)."""
    x, y, z = (axis.cast("long") for axis in code_axes(code))
    sums = {
        "_n": F.count(code),
        "_x": F.sum(x), "_y": F.sum(y), "_z": F.sum(z),
        "_xx": F.sum(x * x), "_yy": F.sum(y * y), "_zz": F.sum(z * z),
        "_xy": F.sum(x * y), "_xz": F.sum(x * z), "_yz": F.sum(y * z),
        "_codes": F.collect_set(code),
    }
    for name, axis in (("x", x), ("y", y), ("z", z)):
        edge = (axis == 0).cast("long") + (axis == GRID - 1).cast("long")
        sums[f"_neighbors_{name}"] = F.sum(2 - edge)
    return sums


def _adjacent(step: int, axis: int) -> Column:
    """Occupied neighbor pairs along an axis, from the array of occupied codes."""
    inner = F.filter("_codes", lambda c: code_axes(c)[axis] < GRID - 1)
    return F.size(F.array_intersect("_codes", F.transform(inner, lambda c: (c + step).cast("int"))))


def grid_columns(totals: DataFrame, epsilon: float = GRID_EPSILON) -> DataFrame:
    """Turn :func:`cell_aggregates` columns into the fourteen grid features."""
    total = F.col("occupancy_total")
    steps = {
        "occupancy_total": F.coalesce(F.col("_n"), F.lit(0)).cast("double"),
        "occupancy_fraction": total / GRID**3,
        **{f"occupancy_{axis}_mean": total / GRID**2 for axis in "xyz"},
    }
    for position, axis in enumerate("xyz"):
        changes = F.col(f"_neighbors_{axis}") - 2 * _adjacent(GRID ** (2 - position), position)
        steps[f"occupancy_gradient_{axis}"] = F.when(total > 0, changes.cast("double")).otherwise(0.0)
    steps["occupancy_gradient_total"] = (
        F.col("occupancy_gradient_x") + F.col("occupancy_gradient_y") + F.col("occupancy_gradient_z"))
    steps["occupancy_surface"] = F.col("occupancy_gradient_total")
    steps["grid_entropy"] = F.when(total > 0, -F.log(1 / total + epsilon)).otherwise(0.0)
    for name in _SCATTER:
        a, b = name[2], name[3]
        # integer sums: n * sum(ab) - sum(a) * sum(b) is exact before the one division
        steps[name] = F.when(
            total > 0, (F.col("_n") * F.col(f"_{a}{b}") - F.col(f"_{a}") * F.col(f"_{b}")) / total
        ).otherwise(0.0)
    df = totals.select("*", *[c.alias(name) for name, c in steps.items()])
    df = with_eigenvalues(df, _SCATTER, ("_e1", "_e2", "_e3"))
    trace = F.col("_cxx") + F.col("_cyy") + F.col("_czz")
    # a rod of cells has one zero moment; keep rounding from making it negative
    df = df.withColumns({
        f"grid_moi_{k}": F.greatest(F.lit(0.0), trace - F.col(f"_e{4 - k}")) for k in (1, 2, 3)})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def grid_features(cells: DataFrame, epsilon: float = GRID_EPSILON) -> DataFrame:
    """All grid features of a table of distinct cells (``snapshot_id, ix, iy, iz``)."""
    code = ((F.col("ix") * GRID + F.col("iy")) * GRID + F.col("iz")).cast("int")
    aggregates = [c.alias(name) for name, c in cell_aggregates(code).items()]
    return grid_columns(cells.groupBy("snapshot_id").agg(*aggregates), epsilon)
