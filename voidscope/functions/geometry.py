"""Box and 3x3 symmetric-matrix arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_lengths(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({
        "lx": F.col("xhi") - F.col("xlo"),
        "ly": F.col("yhi") - F.col("ylo"),
        "lz": F.col("zhi") - F.col("zlo"),
    })


def minimum_image(delta: Column, length: Column) -> Column:
    """Shortest periodic image; ``rint`` rounds half to even."""
    return delta - length * F.rint(delta / length)


def wrapped(axis: str) -> Column:
    """Coordinate relative to the box center, folded into one period."""
    center = (F.col(f"{axis}hi") + F.col(f"{axis}lo")) / 2
    return minimum_image(F.col(axis) - center, F.col(f"l{axis}"))


def volume(boxes: DataFrame) -> DataFrame:
    return box_lengths(boxes).withColumn("volume", F.col("lx") * F.col("ly") * F.col("lz"))


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _vec(name: str) -> list[Column]:
    return [F.col(f"{name}_{i}") for i in range(3)]


def _add(steps: dict[str, Column], name: str, parts) -> list[Column]:
    """Name the three parts of a vector as steps and return references to them."""
    steps.update({f"{name}_{i}": part for i, part in enumerate(parts)})
    return _vec(name)


def _with_steps(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """One SELECT whose later columns refer to earlier ones."""
    return df.select("*", *[c.alias(name) for name, c in steps.items()])


def _eigenvalue_steps(entries: tuple[str, ...], names: tuple[str, str, str]) -> dict[str, Column]:
    xx, yy, zz, xy, xz, yz = (F.col(c) for c in entries)
    q, p, phi = F.col("_q"), F.col("_p"), F.col("_phi")
    a, b, c = xx - q, yy - q, zz - q
    determinant = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    return {
        "_q": (xx + yy + zz) / 3,
        "_p": F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6),
        "_r": F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), determinant / (2 * p * p * p))))
        .when(p.isNotNull(), F.lit(0.0)),
        "_phi": F.acos("_r") / 3,
        names[0]: q + 2 * p * F.cos(phi),
        names[2]: q + 2 * p * F.cos(phi + 2 * math.pi / 3),
        names[1]: 3 * q - F.col(names[0]) - F.col(names[2]),
    }


def with_eigenvalues(df: DataFrame, entries: tuple[str, ...], names: tuple[str, str, str]) -> DataFrame:
    """Eigenvalues of a symmetric 3x3 matrix, largest first, by the trigonometric closed form.

    ``entries`` names the columns xx, yy, zz, xy, xz, yz.
    """
    return _with_steps(df, _eigenvalue_steps(entries, names)).drop("_q", "_p", "_r", "_phi")


def with_principal_axes(df: DataFrame, entries: tuple[str, ...]) -> DataFrame:
    """Add ``l1 >= l2 >= l3`` and unit axes ``r11 .. r33``; each axis has its largest component positive.

    The eigenvector of the better separated end of the spectrum comes from a cross product of matrix
    rows; the middle one is solved in the plane orthogonal to it. A triple root keeps the given axes.
    """
    steps = _eigenvalue_steps(entries, ("l1", "l2", "l3"))
    xx, yy, zz, xy, xz, yz = (F.col(c) for c in entries)
    steps["_top"] = F.col("_r") >= 0
    top = F.col("_top")
    steps["_e"] = F.when(top, F.col("l1")).otherwise(F.col("l3"))
    e = F.col("_e")
    rows = ([xx - e, xy, xz], [xy, yy - e, yz], [xz, yz, zz - e])
    crosses = []
    for name, (i, j) in {"_ca": (0, 1), "_cb": (0, 2), "_cc": (1, 2)}.items():
        vector = _add(steps, name, _cross(rows[i], rows[j]))
        steps[f"{name}_n"] = _dot(vector, vector)
        crosses.append((vector, F.col(f"{name}_n")))
    (ca, na), (cb, nb), (cc, nc) = crosses
    steps["_n"] = F.greatest(na, nb, nc)
    longest = [
        F.when(na >= F.greatest(nb, nc), ca[i]).when(nb >= nc, cb[i]).otherwise(cc[i]) / F.sqrt("_n")
        for i in range(3)
    ]
    v = _add(steps, "_v", [
        F.when(F.col("_n") > 0, longest[i]).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i in range(3)])
    wide = F.abs(v[0]) > F.abs(v[1])
    steps["_len"] = F.sqrt(F.when(wide, v[0] * v[0]).otherwise(v[1] * v[1]) + v[2] * v[2])
    length = F.col("_len")
    u = _add(steps, "_u", [
        F.when(wide, -v[2] / length).otherwise(0.0),
        F.when(wide, F.lit(0.0)).otherwise(v[2] / length),
        F.when(wide, v[0] / length).otherwise(-v[1] / length),
    ])
    w = _add(steps, "_w", _cross(v, u))

    def applied(t):
        return [xx * t[0] + xy * t[1] + xz * t[2], xy * t[0] + yy * t[1] + yz * t[2], xz * t[0] + yz * t[1] + zz * t[2]]

    au, aw = _add(steps, "_au", applied(u)), _add(steps, "_aw", applied(w))
    steps["_m00"] = _dot(u, au) - F.col("l2")
    steps["_m01"] = _dot(u, aw)
    steps["_m11"] = _dot(w, aw) - F.col("l2")
    m00, m01, m11 = F.col("_m00"), F.col("_m01"), F.col("_m11")
    left = F.abs(m00) >= F.abs(m11)
    steps["_su"] = F.when(left, m01).otherwise(m11)
    steps["_sw"] = F.when(left, -m00).otherwise(-m01)
    su, sw, sn = F.col("_su"), F.col("_sw"), F.col("_sn")
    steps["_sn"] = F.sqrt(su * su + sw * sw)
    middle = _add(steps, "_m", [
        F.when(sn > 0, (su * u[i] + sw * w[i]) / sn).otherwise(u[i]) for i in range(3)])
    other = _add(steps, "_o", _cross(v, middle))
    axes = {
        1: [F.when(top, v[i]).otherwise(other[i]) for i in range(3)],
        2: middle,
        3: [F.when(top, other[i]).otherwise(v[i]) for i in range(3)],
    }
    for k, axis in axes.items():
        x, y, z = _add(steps, f"_a{k}", axis)
        largest = (
            F.when((F.abs(x) >= F.abs(y)) & (F.abs(x) >= F.abs(z)), x).when(F.abs(y) >= F.abs(z), y).otherwise(z)
        )
        steps[f"_s{k}"] = F.when(largest < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        for i, part in enumerate((x, y, z)):
            steps[f"r{k}{i + 1}"] = F.col(f"_s{k}") * part
    return _with_steps(df, steps).drop(*[name for name in steps if name.startswith("_")])
