"""Whitening against numpy and exact integer arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from voidscope.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def slow(rows, scale=256, k=4):
    """Rows and model of the valid vectors, by numpy's eigenvectors and Python integers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    xs = [(i, tuple(math.floor(scale * float(np.float32(c))) for c in v) + (0,) * (width - len(v))) for i, v in kept]
    fit = sorted({x for _, x in xs})
    n = len(fit)
    total = [sum(x[d] for x in fit) for d in range(width)]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, total)] for x in fit]).reshape(n, width)
    v = centred.T @ centred / max(n, 1)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:k] > width * np.finfo(float).eps * np.trace(v)).sum())
    out = []
    for i, x in xs:
        c = np.array([float(Fraction(n * a - t, n)) for a, t in zip(x, total)])
        out.append((i, x, sum((n * a - t) ** 2 for a, t in zip(x, total)), (c @ u[:, :k]) / np.sqrt(e[:k])))
    return n, e[:k] / np.trace(v) if k else e[:0], out


def check(spark, rows, tolerance=1e-6, **kw):
    found = whitening.whiten(spark.createDataFrame([(i, v, "n", "c") for i, v in rows], SCHEMA), **kw).collect()
    n, share, wanted = slow(rows)
    assert len(found) == len(wanted) * len(share)
    key = lambda r: (str(r[0]), r[1], r[2])
    for c in range(len(share)):
        mine = sorted(((r.vec_id, r.deviation, abs(r.whitened)) for r in found if r.component == c + 1), key=key)
        theirs = sorted(((i, dev if dev < 1 << 63 else None, abs(float(z[c]))) for i, _, dev, z in wanted), key=key)
        assert [(i, d) for i, d, _ in mine] == [(i, d) for i, d, _ in theirs]
        assert np.allclose([z for *_, z in mine], [z for *_, z in theirs], rtol=tolerance, atol=tolerance)
    for r in found:
        assert r.n == n and abs(r.explained / share[r.component - 1] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
    return found


def vectors(seed, n, d, stretch=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * (np.linspace(3, 0.5, d) if stretch is None else stretch)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("d", [1, 2, 3, 9, 40])
def test_matches_numpy(spark, d):
    check(spark, vectors(d, 200, d))


def test_one_sign_for_all_rows(spark):
    rows = vectors(3, 100, 5)
    found = check(spark, rows)
    _, _, wanted = slow(rows)
    by_id = {i: z for i, _, _, z in wanted}
    for c in range(4):
        signs = {np.sign(r.whitened * by_id[r.vec_id][c]) for r in found if r.component == c + 1 and abs(r.whitened) > 1e-9}
        assert len(signs) == 1


def test_repeats_weigh_once_and_bad_rows_are_dropped(spark):
    rows = vectors(4, 60, 6)
    check(spark, rows + [(1000 + i, rows[0][1]) for i in range(300)] + [rows[1], rows[1], (None, rows[2][1])] + [
        (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5),
        (2004, [1.0, 2.0]), (2005, [])])


def test_few_or_equal_vectors_have_no_component(spark):
    assert check(spark, []) == [] and check(spark, [(1, [1.0, 2.0])]) == []
    assert check(spark, [(i, [0.5, 0.25]) for i in range(5)]) == [] and check(spark, [(1, [])]) == []
    assert len(check(spark, [(1, [0.0, 1.0]), (2, [0.0, 3.0])])) == 2


def test_large_entries(spark):
    for size, fits in ((1e4, True), (1e6, False)):
        found = check(spark, [(i, [c * size for c in v]) for i, v in vectors(6, 50, 4)], tolerance=1e-5)
        assert all(r.deviation is not None for r in found) == fits
    huge = [(i, [c * 1e30 for c in v]) for i, v in vectors(7, 20, 3)]
    found = whitening.whiten(spark.createDataFrame([(i, v, "n", "c") for i, v in huge], SCHEMA)).collect()
    assert len(found) == 60 and all(r.deviation is None for r in found)


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "split", "low rank"])
def test_eigenvectors(kind):
    r = np.random.default_rng(1)
    for d in (1, 2, 3, 10, 50):
        q, _ = np.linalg.qr(r.normal(size=(d, d)))
        e = {"random": r.uniform(0, 9, d), "clustered": 5 + 1e-9 * np.arange(d), "equal": np.full(d, 2.0),
             "split": np.repeat([4.0, 1.0], [d - d // 2, d // 2]), "low rank": np.where(np.arange(d) < 2, 3.0, 0.0)}[kind]
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        for b in (a, np.diag(e)):
            values, u = whitening.leading_eigenvectors(b, min(6, d))
            assert np.allclose(values, np.sort(e)[::-1][:len(values)], atol=1e-12 * max(1, e.max()))
            assert np.allclose(u.T @ u, np.eye(len(values)), atol=1e-12)
            assert np.abs(b @ u - u * values).max() < 1e-12 * max(1, e.max())


def test_sturm_counts():
    r = np.random.default_rng(2)
    d, off = r.normal(size=20), r.normal(size=19)
    e = np.linalg.eigvalsh(np.diag(d) + np.diag(off, 1) + np.diag(off, -1))
    at = r.uniform(-5, 5, 100)
    assert (whitening.smaller(d, off, at) == (e[None, :] < at[:, None]).sum(axis=1)).all()
