"""Operators against dense matrices, rewrites, kernels, streams, and every query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators import linear as L
from tessera.operators import solvers
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    ours = catalog.queries()[name](spark, SF)
    rows = sorted(map(str, (tuple(r[c] for c in sorted(ours.columns)) for r in ours.collect())))
    theirs = duck.sql(catalog.oracle_sql()[name])
    assert sorted(theirs.columns) == sorted(ours.columns)
    order = [theirs.columns.index(c) for c in sorted(theirs.columns)]
    assert rows == sorted(map(str, (tuple(r[i] for i in order) for r in theirs.fetchall())))


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql() and n not in ("ml_map", "atop_map")])
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def vector(spark, n=6):
    return spark.createDataFrame([(k, float(k + 1)) for k in range(n)], "k long, v double")


def values(df):
    return {r.k: r.v for r in df.collect()}


def test_rewrites():
    m, p = L.Mask("k > 1"), L.Pack("k > 1")
    assert isinstance((L.Homothety(2.0) @ L.Homothety(0.5)).reduce(), L.Identity)
    assert (m @ m).reduce() is m
    assert isinstance((p @ p.T).reduce(), L.Identity)
    assert isinstance((L.Rotation("a") @ L.Rotation("a").T).reduce(), L.Identity)
    assert isinstance((L.HalfWavePlate() @ L.HalfWavePlate()).reduce(), L.Identity)
    assert isinstance((L.Polarizer() @ L.HalfWavePlate()).reduce(), L.Polarizer)
    assert (L.Homothety(2.0) + L.Identity()).reduce().k == 3.0
    with pytest.raises(TypeError):
        L.Identity() * L.Identity()
    with pytest.raises(ValueError):
        L.Polarizer().I


def test_matrix_and_adjoint(spark):
    a = np.random.default_rng(1).standard_normal((4, 6))
    table = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(4) for j in range(6)], "row long, col long, val double")
    x, y = np.arange(6.0), np.arange(4.0) + 1
    dx = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "col long, v double")
    dy = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "row long, v double")
    op = L.Matrix(table)
    ax = {r.row: r.v for r in op(dx).collect()}
    aty = {r.col: r.v for r in op.T(dy).collect()}
    assert np.allclose([ax[k] for k in range(4)], a @ x)
    assert np.isclose(sum(ax[k] * y[k] for k in range(4)), sum(aty[k] * x[k] for k in range(6)))


def test_inverse_by_conjugate_gradients(spark):
    d = spark.createDataFrame([(k, float(k + 1)) for k in range(6)], "k long, d double")
    out = values(L.Inverse(L.Diagonal(d, ("k",))).apply(vector(spark)))
    assert np.allclose([out[k] for k in range(6)], 1.0, atol=1e-4)


def test_solvers():
    a = np.diag(np.arange(1.0, 6)) + 0.1
    x, history, steps = solvers.cg(lambda v: a @ v, np.ones(5), rtol=1e-10)
    assert np.allclose(a @ x, 1) and steps == len(history)
    vals, _, _ = solvers.lanczos(lambda v: a @ v, np.ones(5), 2, 5)
    assert np.allclose(vals, np.linalg.eigvalsh(a)[-2:])
    assert solvers.pick(np.array([3.0, -5, 1, 4]), 3, "BE").tolist() == [1, 0, 3]


@pytest.mark.parametrize("method", ["direct", "fft", "overlap_save"])
def test_toeplitz_methods_agree(method):
    x, b = np.random.default_rng(2).standard_normal(200), np.array([1.0, 0.5, 0.2, -0.1])
    assert np.allclose(K.toeplitz(x, b, method), K.toeplitz(x, b, "dense"))


def test_kernels():
    rng = np.random.default_rng(3)
    x, good = rng.standard_normal(64), np.arange(64) % 9 != 4
    assert np.array_equal(K.gap_fill(x, good, np.array([1.0, 0.3]), 1)[good], x[good])
    bands = np.stack([np.full(30, 4.0), np.ones(30)])
    dense = np.diag(bands[0]) + np.diag(bands[1][:-1], 1) + np.diag(bands[1][:-1], -1)
    assert np.allclose(dense @ K.banded_solve(K.banded_cholesky(bands), x[:30]), x[:30])
    assert np.allclose(K.mueller_of_stack([(1.0, 1.0, 1e-3, 0.3)], 1e11), np.eye(4), atol=1e-9)
    f, p = K.welch(rng.standard_normal(4096), 100.0, 256)
    assert abs(p[1:-1].mean() * 50 - 1) < 0.2 and f[-1] == 50


def test_incremental_map_equals_batch(spark, tmp_path):
    from tessera.streaming.maps import pixel_stream, run_to_end

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    out = {r.pix: r.hits for r in run_to_end(pixel_stream(spark, events.schema, str(tmp_path / "in")), "stream_map").collect()}
    assert out == {r.pix: r["count"] for r in events.groupBy(((F.col("event_id") * 31 + F.col("user_id") * 17) % 48).alias("pix")).count().collect()}


def test_products(spark, tmp_path):
    from tessera.sources.products import load, save

    table = vector(spark)
    save(str(tmp_path), {"map": table, "hit_map": table, "icov": table}, {"steps": 3})
    assert load(spark, str(tmp_path))["map"].count() == 6
    with pytest.raises(ValueError):
        load(spark, str(tmp_path), ("map",))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 48
    assert set(e.oracle_sql()) <= set(e.queries())
