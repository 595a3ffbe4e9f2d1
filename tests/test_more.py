"""Templates, pointing, landscapes, trees, streams, readers, settings and harmonics: adjoints, round trips and errors."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import config as C
from tessera.functions import angles as A
from tessera.functions import landscapes as N
from tessera.operators import harmonics as H
from tessera.operators import linear as L
from tessera.operators import pointing as P
from tessera.operators import streams as R
from tessera.operators import templates as B
from tessera.operators import trees as T
from tessera.sources import readers as O


def inner(x, y, keys):
    return x.select(*keys, "v").join(y.select(*keys, F.col("v").alias("w")), list(keys)).agg(F.sum(F.col("v") * F.col("w"))).first()[0] or 0.0


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(d, s, float(np.sin(0.3 * s)), 0.7 * s, float(rng.standard_normal())) for d in range(3) for s in range(40)], "det long, samp long, az double, chi double, v double")


BASES = {
    "polynomial": lambda: B.polynomial(F.when(F.col("samp") % 20 < 15, F.floor(F.col("samp") / 20)), (F.col("samp") % 20) / 10.0 - 1, 0, 3, 2),
    "scan": lambda: B.scan_synchronous(F.col("az"), -1, 1, 3, 7), "bins": lambda: B.binaz_synchronous(F.col("az"), -1, 1, 5), "hats": lambda: B.binaz_synchronous(F.col("az"), -1, 1, 5, True),
    "smooth": lambda: B.binaz_synchronous(F.col("az"), -1, 1, 5, True, True), "hwp": lambda: B.hwp_synchronous(F.col("chi"), 3), "azhwp": lambda: B.azhwp_synchronous(F.col("az"), F.col("chi"), -1, 1, scan=F.col("samp") % 3 > 0),
    "binazhwp": lambda: B.binazhwp_synchronous(F.col("az"), F.col("chi"), -1, 1), "spline": lambda: B.bspline_hwpss(F.col("samp"), 0, 39, 5, F.col("chi")), "temperature": lambda: B.temperature(F.col("az"), q=4),
}


@pytest.mark.parametrize("name", BASES)
def test_templates_are_adjoint(spark, samples, name):
    basis = BASES[name]()
    template = B.Template(basis, samples)
    a = spark.createDataFrame([(d, b, float((7 * d + 3 * b) % 11) - 5) for d in range(3) for b in range(basis.size)], "det long, b long, v double")
    assert inner(template(a), samples, ("det", "samp")) == pytest.approx(inner(template.T(samples), a, ("det", "b")), abs=1e-9)
    assert template.T(samples).agg(F.max("b")).first()[0] < basis.size


def test_weights_of_splines_and_hats_add_up(samples):
    offset, weights, blocks = B.spline_blocks(F.col("samp"), 0, 39, 5)
    for r in samples.select(offset.alias("o"), sum(weights[1:], weights[0]).alias("w")).distinct().collect():
        assert r.w == pytest.approx(1) and 0 <= r.o <= blocks - 4
    hats = B.bin_basis(F.col("az"), -1, 1, 5, True, True)
    assert {round(r[0], 9) for r in samples.select(F.aggregate(hats.design(), F.lit(0.0), lambda s, c: s + c["x"])).collect()} == {1.0}
    with pytest.raises(ValueError):
        B.bspline_hwpss(F.col("samp"), 0, 39, 1, F.col("chi"))
    assert set(B.assemble(samples, {"a": BASES["hwp"](), "b": B.none()})) == {"a"}


def quats(spark, rows, key):
    table = spark.createDataFrame(rows, f"{key} long, theta double, phi double, psi double")
    return table.select(key, *[x.alias(n) for x, n in zip(A.from_iso(F.col("theta"), F.col("phi"), F.col("psi")), P.QUAT, strict=True)])


@pytest.mark.parametrize(("plate", "demodulated"), [(False, False), (True, False), (False, True)])
def test_acquisition_is_adjoint(spark, plate, demodulated):
    rng = np.random.default_rng(1)
    bore = quats(spark, [(k, *map(float, rng.uniform(0.2, 2.8, 3))) for k in range(50)], "samp").withColumn("chi", F.col("samp") * 0.3)
    dets = quats(spark, [(0, 0.0, 0.0, 0.0), (1, 0.05, 1.0, 0.4)], "det")
    land = N.Healpix(nside=2)
    op = P.acquisition(land, bore, dets, plate, demodulated)
    sky = spark.createDataFrame([(p, *map(float, rng.standard_normal(3))) for p in range(land.size)], "pix long, i double, q double, u double")
    seen = op(sky)
    if demodulated:
        data = seen.withColumns({c: F.cos(F.col("samp") * k + F.col("det")) for k, c in enumerate("iqu", 1)})
        left = seen.agg(F.sum(sum((F.col(c) * F.cos(F.col("samp") * k + F.col("det")) for k, c in enumerate("iqu", 1)), F.lit(0.0)))).first()[0]
    else:
        data = seen.withColumn("v", F.cos(F.col("samp") + F.col("det")))
        left = inner(seen, data, ("samp", "det"))
    back = op.T(data).alias("a").join(sky.alias("b"), "pix")
    right = back.agg(F.sum(sum((F.col(f"a.{c}") * F.col(f"b.{c}") for c in "iqu"), F.lit(0.0)))).first()[0]
    assert left == pytest.approx(right, abs=1e-9)
    assert op.parts[1].expanded().seen.count() == 100
    with pytest.raises(ValueError):
        P.pointed(land, bore, dets, frame="sky")


def test_rotations_agree(spark):
    table = spark.createDataFrame([(0.7, 1.1, -0.4)], "theta double, phi double, psi double")
    t, p, s = map(F.col, ("theta", "phi", "psi"))
    q = A.from_iso(t, p, s)
    m, z = P.rotation_matrix(tuple(x * 3 for x in q)), P.zyz(t, p, s)
    row = table.select(*[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)], *[z[i][j].alias(f"z{i}{j}") for i in range(3) for j in range(3)]).first()
    assert np.allclose([row[f"m{i}{j}"] for i in range(3) for j in range(3)], [row[f"z{i}{j}"] for i in range(3) for j in range(3)])
    nought = table.select(*[x.alias(f"c{k}") for k, x in enumerate(P.rotation_matrix((F.lit(0.0),) * 4)[0])]).first()
    assert tuple(nought) == (0, 0, 0)


def test_landscapes(spark):
    with pytest.raises(NotImplementedError):
        N.Healpix(nside=2, nested=True)
    listed = spark.createDataFrame([(5,), (5,), (-1,), (1 << 21,), (9,)], "pix long")
    local = N.local_pixels(listed, 1 << 22)
    assert {r.pix: r.local for r in local.collect()} == {5: 0, 9: 1, 1 << 21: 2}
    assert [r.local for r in N.global2local(local, spark.createDataFrame([(9,), (10,)], "pix long")).orderBy("pix").collect()] == [1, 3]
    with pytest.raises(ValueError):
        N.local_pixels(listed, 100)
    assert N.Tangential.from_extent(1000, 10, 300, 200).size == 600
    assert N.Horizon(n_az=4, n_alt=2, low=0.0, high=1.0).altitude_centers() == [0.25, 0.75]


def test_trees(spark):
    x = spark.createDataFrame([("a", k, float(k)) for k in range(3)] + [("b", k, 2.0 * k) for k in range(3)], "leaf string, k long, v double")
    assert inner(T.combine("power", x, 2), T.ones_like(x), ("leaf", "k")) == 0 + 1 + 4 + 0 + 4 + 16
    with pytest.raises(L.StructureError):
        T.combine("add", x, x.where("k < 2"))
    with pytest.raises(L.StructureError):
        T.combine("add", x.drop("k"), x)
    op = T.TreeOperator({"u": {"a": 2.0, "b": 1.0}, "w": {"b": -1.0}})
    y = op(x)
    assert inner(op.T(y), x, ("leaf", "k")) == pytest.approx(inner(y, y, ("leaf", "k")))
    back = {(r.leaf, r.k): r.v for r in op.I(y).collect()}
    assert all(back[r.leaf, r.k] == pytest.approx(r.v) for r in x.collect())
    draws = [r.v for r in T.normal_like(x, 3).orderBy("leaf", "k").collect()]
    assert draws == [r.v for r in T.normal_like(x.repartition(3), 3).orderBy("leaf", "k").collect()] and len(set(draws)) == 6
    axes = T.Ravel("id", "k", 3) @ T.MoveAxis((("leaf", "id"), ("k", "k")))
    moved = axes.apply(x.withColumn("leaf", (F.col("leaf") == "b").cast("long")))
    assert sorted(r.k for r in moved.collect()) == list(range(6)) and axes.T.apply(moved).columns == ["leaf", "k", "v"]


def test_streams(spark):
    obs = spark.createDataFrame([(0,), (1,), (2,)], "obs long")
    x = spark.createDataFrame([(p, 1.0 + p) for p in range(4)], "pix long, v double")
    scale = lambda t: t.withColumn("v", F.col("v") * (F.col("obs") + 1))
    column = R.StreamColumn(scale, obs, scale)
    normal = column.T @ column
    assert isinstance(normal, R.StreamAddition)
    assert {r.pix: r.v for r in normal(x).collect()} == {p: 14.0 * (1 + p) for p in range(4)}
    both = R.StreamDiagonal(scale, scale) @ column
    assert isinstance(both, R.StreamColumn) and both(x).agg(F.sum("v")).first()[0] == 14 * 10
    with pytest.raises(NotImplementedError):
        _ = R.StreamDiagonal(scale).T


def test_readers(spark, tmp_path):
    good = str(tmp_path / "one.parquet")
    spark.createDataFrame([(0, d, s, 5.0 + s, 1.0) for d in range(2) for s in range(3)], "obs long, det long, samp long, t double, d double").write.parquet(good)
    bad = tmp_path / "two.parquet"
    bad.write_bytes(b"not parquet")
    lazy = O.LazyObservation(good)
    assert lazy.name == "one" and lazy.shape(spark) == (2, 3) and lazy.data(spark, []).columns == ["obs", "det", "samp", "observation"]
    with pytest.raises(FileNotFoundError):
        O.LazyObservation(str(tmp_path / "none.parquet"))
    for fields in (["nonsense"], ["hwp_angles"]):
        with pytest.raises(O.UnsupportedField):
            lazy.data(spark, fields)
    reader = O.Reader([good, str(bad), str(tmp_path / "none.parquet")], ["sample_data", "timestamps"])
    rows = reader.read(spark)
    assert rows.count() == 6 and rows.agg(F.min("t")).first()[0] == 0 and set(reader.failed) == {str(bad), str(tmp_path / "none.parquet")} or len(reader.failed) == 2
    assert O.all_failures(reader.failures(spark), reader.failures(spark)).count() == 2
    reader.reset()
    assert not reader.failed
    with pytest.raises(OSError):
        O.Reader([good], known_failures=frozenset({"one"})).read(spark)
    draws = O.random_sampling(spark.createDataFrame([(0, 1), (1, 0), (2, 3)], "pix long, hits long"), 4000, seed=1).groupBy("pix").count().collect()
    assert {r.pix for r in draws} == {0, 2} and sum(r["count"] for r in draws) == 4000
    assert abs(next(r["count"] for r in draws if r.pix == 2) - 3000) < 150


def test_settings(tmp_path):
    for method in C.Method:
        x = C.MapMaking.for_method(method)
        assert C.from_dict(C.MapMaking, C.to_dict(x)) == x
        C.dump(x, str(tmp_path / "x.json"))
        assert C.load(str(tmp_path / "x.json")) == x
    assert C.MapMaking.for_method("ATOP").atop_tau == 37
    for wrong in ({"nonsense": 1}, {"atop_tau": "x"}, {"landscape": {"healpix": {}, "wcs": {}}}, {"method": "none"}):
        with pytest.raises(ValueError):
            C.from_dict(C.MapMaking, wrong)
    with pytest.raises(dataclasses.FrozenInstanceError):
        C.MapMaking().debug = False


def test_harmonics():
    rng = np.random.default_rng(0)
    a = np.tril(rng.standard_normal((9, 9)) + 1j * rng.standard_normal((9, 9)))
    a[:, 0] = a[:, 0].real
    x = H.alm2map(a, 8)
    assert np.allclose(H.map2alm(x, 8), a, atol=1e-5)
    assert np.allclose(H.alm2map(np.eye(1, dtype=complex) * np.sqrt(4 * np.pi), 2), 1)
    w = np.exp(-0.02 * np.arange(9) * np.arange(1, 10))
    assert np.allclose(H.beam(H.beam(x, w), w, inverse=True), x, atol=1e-4)
    with pytest.raises(ValueError):
        H.map2alm(np.zeros(13), 2)
    m = rng.standard_normal((7, 5, 5))
    m += m.transpose(0, 2, 1)
    assert np.allclose(H.eigvalsh(m, batch=3), np.linalg.eigvalsh(m))
    taper = H.chebyshev_half(64)
    assert taper[0] == 1 and np.all(np.diff(taper) < 0) and taper[-1] > 0 and len(H.gaussian_half(10)) == 10
    bands = H.inverse_bands(lambda f: H.noise_psd(f, 2.0, -1e-9, 1.0, 1e-5), 1.0, 4)
    assert bands[0] == pytest.approx(1 / 8, rel=1e-6) and np.allclose(bands[1:], 0, atol=1e-9)
    assert not H.inverse_bands(lambda f: H.noise_psd(f, 0.0, -1.0, 1.0, 1e-5), 1.0, 4).any()


def test_intervals(spark):
    x = spark.createDataFrame([(0, s) for s in range(10)], "det long, samp long")
    marks = spark.createDataFrame([(0, 2, 4, 0), (0, 6, 9, 1)], "det long, start long, end long, interval long")
    assert [r.interval for r in O.intervals_of(x, marks).orderBy("samp").collect()] == [None, None, 0, 0, None, None, 1, 1, 1, None]


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
