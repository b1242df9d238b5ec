"""Numpy brute force and small builders shared by the tests."""

import numpy as np

POINTS = "snapshot_id long, atom_id long, x double, y double, z double"
SITES = "site_id long, x double, y double, z double"
BOXES = "snapshot_id long, xlo double, xhi double, ylo double, yhi double, zlo double, zhi double"
A0 = 3.532


def points(spark, clouds):
    rows = [(int(s), i, *map(float, p)) for s, cloud in clouds.items() for i, p in enumerate(cloud)]
    return spark.createDataFrame(rows, POINTS)


def sites(spark, positions):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(positions)], SITES)


def boxes(spark, edges, low=0.0):
    """edges: snapshot -> (lx, ly, lz)"""
    return spark.createDataFrame(
        [(s, *[v for e in edge for v in (float(low), float(low + e))]) for s, edge in edges.items()], BOXES)


def ref_box(edge, low=0.0):
    return {f"{a}{end}": low + (e if end == "hi" else 0.0) for a, e in zip("xyz", edge) for end in ("lo", "hi")}


def fcc(cells, a0=A0):
    base = [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)]
    return np.array([((i + b[0]) * a0, (j + b[1]) * a0, (k + b[2]) * a0)
                     for i in range(cells) for j in range(cells) for k in range(cells) for b in base])


def image(delta, length):
    return delta if length is None else delta - length * np.round(delta / length)


def brute_nearest(cloud, lattice, length=None):
    """(site, distance) per point; the lowest site on a tie."""
    gaps = np.linalg.norm(image(lattice[None, :, :] - cloud[:, None, :], length), axis=2)
    best = gaps.argmin(axis=1)
    return best, gaps[np.arange(len(cloud)), best]
