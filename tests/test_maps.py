"""Iterative and two-step maps against dense solutions over the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import linear as L
from tessera.operators import maps as M
from tessera.operators.solvers import Config
from tessera.plans.catalog import Tables
from tessera.sources.tables import NPIX

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dense(spark):
    t = Tables(spark, SF)
    rows = t.tod.orderBy("det", "samp").toPandas()
    point = np.zeros((len(rows), NPIX, 3))
    point[np.arange(len(rows)), rows.pix] = np.column_stack([np.ones(len(rows)), np.cos(2 * rows.psi), np.sin(2 * rows.psi)])
    return t.tod, rows, point.reshape(len(rows), -1) * rows.valid.to_numpy()[:, None]


def by_detector(rows, block):
    out = np.zeros((len(rows), len(rows)))
    for at in rows.reset_index(drop=True).groupby("det").indices.values():
        out[np.ix_(at, at)] = block(len(at))
    return out


def toeplitz(n):
    return sum(b * (np.eye(n, k=k) + np.eye(n, k=-k)) * (0.5 if k == 0 else 1.0) for k, b in enumerate((1.0, -0.2, 0.05)))


def projection(n):
    out = np.eye(n)
    for at in range(0, n - 6, 7):
        out[at : at + 7, at : at + 7] -= 1 / 7
    return out


@pytest.mark.parametrize(("op", "block"), [(L.Toeplitz((1.0, -0.2, 0.05)), toeplitz), (L.IntervalProjection(7), projection)])
def test_iterative_map_solves_the_dense_normal_equations(dense, op, block):
    tod, rows, p = dense
    w, d = by_detector(rows, block), np.where(rows.valid, rows.d, 0.0)
    out = M.iterative(tod, NPIX, op.apply)
    assert out.converged
    a, b = p.T @ w @ p, p.T @ w @ d
    assert np.linalg.norm(a @ out.maps.ravel() - b) <= 1e-5 * np.linalg.norm(b)
    exact, p_exact = np.linalg.lstsq(a, b, rcond=1e-10)[0], p
    assert np.allclose(p_exact @ out.maps.ravel(), p_exact @ exact, atol=1e-2 * np.abs(p_exact @ exact).max())


def test_steps_that_do_not_suffice_are_told(dense):
    with pytest.warns(RuntimeWarning):
        assert not M.iterative(dense[0], NPIX, L.Toeplitz((1.0, -0.2, 0.05)).apply, steps=1, rtol=1e-12).converged
    with pytest.raises(RuntimeError):
        M.iterative(dense[0], NPIX, L.Toeplitz((1.0, -0.2, 0.05)).apply, steps=1, rtol=1e-12, throw=True)


def test_two_step_map_solves_the_dense_least_squares(dense):
    tod, rows, p = dense
    dets = sorted(rows.det.unique())
    f = (rows.det.to_numpy()[:, None] == np.array(dets)[None, :]) * rows.valid.to_numpy()[:, None].astype(float)
    offsets, sky = M.two_step(tod, Config(rtol=1e-8, atol=0.0, max_steps=200))
    got = {r.det: r.v for r in offsets.collect()}
    maps = np.zeros((NPIX, 3))
    for r in sky.collect():
        maps[r.pix] = r.i, r.q, r.u
    both = np.hstack([f, p])
    x = np.linalg.lstsq(both, np.where(rows.valid, rows.d, 0.0), rcond=None)[0]
    found = f @ np.array([got[k] for k in dets]) + p @ maps.ravel()
    assert np.allclose(found, both @ x, atol=1e-3 * np.abs(both @ x).max())


def test_offsets_by_pixel_means(dense):
    tod, rows, _ = dense
    rest = rows.d - rows.groupby("pix").d.transform("mean")
    want = rest.groupby(rows.det).mean()
    got = {r.det: r.offset for r in M.offsets(tod).collect()}
    assert all(np.isclose(got[k], v) for k, v in want.items()) and tod.select(F.countDistinct("det")).first()[0] == len(got)
