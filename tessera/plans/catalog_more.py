"""The third part of the catalog: templates, pointing from quaternions, landscapes, trees, sources, streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import angles as A
from tessera.functions import landscapes as N
from tessera.operators import harmonics as H
from tessera.operators import linear as L
from tessera.operators import pointing as P
from tessera.operators import streams as R
from tessera.operators import templates as B
from tessera.operators import trees as T
from tessera.plans.catalog import _ISO, ANGLES, GC, LEAVES, SQL, G, _sq, cols, g, leaves, query, ring_sql, small, vq
from tessera.plans.catalog_maps import SKY48, _bspline_sql, sky48
from tessera.sources import readers as O

# --- templates -----------------------------------------------------------------------------------------------------

AZ_SQL = "sin(samp * 0.05::DOUBLE)"


def azimuth():
    return F.sin(F.col("samp") * 0.05)


def samples(t):
    return t.tod.select("det", "samp", "psi", "t", F.col("d").alias("v"))


def amplitude(det, b):
    return det * 0.001 + b + 1.0


def template(name: str, basis, rows: list[tuple[str, str]], scale: float = 1e3, where: str = "true"):
    """Three queries of a template: samples from known amplitudes, amplitudes from samples. `rows`: (SQL of b, SQL of x)."""
    design = " UNION ALL ".join(f"SELECT event_id, det, samp, d, ({b})::BIGINT AS b, ({x})::DOUBLE AS x FROM tod WHERE {where}" for b, x in rows)
    # the comma keeps the table's name apart from the bracket
    project = f"SELECT det, b, {G('sum(x * d)', scale)} AS v FROM ( {design} ) GROUP BY det, b"
    expand = f"SELECT det, samp, {G('coalesce(sum(x * (det * 0.001::DOUBLE + b + 1)), 0)', scale)} AS v FROM (SELECT tod.det, tod.samp, r.b, r.x FROM tod LEFT JOIN ( {design} ) r ON r.event_id = tod.event_id) GROUP BY det, samp"

    @query(f"template_{name}_project", project)
    def _(t):
        return B.Template(basis(), samples(t)).T(samples(t)).select("det", "b", g(F.col("v"), scale).alias("v"))

    @query(f"template_{name}_expand", expand)
    def _(t):
        x = samples(t)
        out = B.Template(basis(), x)
        return out(out.reached().withColumn("v", amplitude(F.col("det"), F.col("b")))).select("det", "samp", g(F.col("v"), scale).alias("v"))


def _p(k: int, x: str) -> str:
    return {0: "1", 1: f"({x})", 2: f"(3 * pow({x}, 2) - 1) / 2", 3: f"(5 * pow({x}, 3) - 3 * ({x})) / 2"}[k]


def _waves(n: int, angle: str = "psi") -> list[str]:
    return [f"{f}({angle} * {k})" for f in ("sin", "cos") for k in range(1, n + 1)]


_X16 = "((samp % 16) / 8.0 - 1)"
template("polynomial", lambda: B.polynomial(F.when(F.col("samp") % 64 < 48, F.floor(F.col("samp") / 16)).cast("long"), (F.col("samp") % 16) / 8.0 - 1, 0, 2, 1 << 16), [(f"samp // 16 * 3 + {k}", _p(k, _X16)) for k in range(3)], scale=1237.0, where="samp % 64 < 48")
template("scan", lambda: B.scan_synchronous(azimuth(), -1.0, 1.0, 1, 3), [(str(k), _p(k + 1, AZ_SQL)) for k in range(3)])
template("hwp", lambda: B.hwp_synchronous(F.col("psi"), 3), [(str(k), w) for k, w in enumerate(_waves(3))])
template("azhwp", lambda: B.azhwp_synchronous(azimuth(), F.col("psi"), -1.0, 1.0, 0, 1, 2), [(str(5 * k + j), f"{_p(k, AZ_SQL)} * {w}") for k in range(2) for j, w in enumerate(["1", *_waves(2)])])
template("azhwp_scan", lambda: B.azhwp_synchronous(azimuth(), F.col("psi"), -1.0, 1.0, 1, 1, 1, scan=F.col("samp") % 10 < 7), [(str(j), f"{AZ_SQL} * {w}") for j, w in enumerate(["1", *_waves(1)])], where="samp % 10 < 7")
template("binaz", lambda: B.binaz_synchronous(azimuth(), -1.0, 1.0, 4), [(f"floor(({AZ_SQL} + 1) / (2 + 1e-8) * 4)", "1")])
_U4 = f"greatest(0, least(3, ({AZ_SQL} + 1) / 2 * 4 - 0.5))"
template("binaz_hats", lambda: B.binaz_synchronous(azimuth(), -1.0, 1.0, 4, interpolate=True), [(str(b), f"greatest(0, 1 - abs({_U4} - {b}))") for b in range(4)])
_S4 = [f"pow(sin(greatest(0, 1 - abs({_U4} - {b})) * {A.PI / 2!r}::DOUBLE), 2)" for b in range(4)]
template("binaz_smooth", lambda: B.binaz_synchronous(azimuth(), -1.0, 1.0, 4, interpolate=True, smooth=True), [(str(b), f"{w} / ({' + '.join(_S4)})") for b, w in enumerate(_S4)])
template("binazhwp", lambda: B.binazhwp_synchronous(azimuth(), F.col("psi"), -1.0, 1.0, 3, 1), [(f"floor(({AZ_SQL} + 1) / (2 + 1e-8) * 3) * 3 + {j}", w) for j, w in enumerate(["1", *_waves(1)])])
template("temperature", lambda: B.temperature(F.cos(F.col("t") * 0.01), q=4), [("0", "CASE WHEN samp % 4 = 0 THEN cos(t * 0.01::DOUBLE) ELSE 0 END")])
_OFF = "floor(samp / 100000.0 * 63)"
template("spline_hwpss", lambda: B.bspline_hwpss(F.col("samp"), 0.0, 100000.0, 64, F.col("psi"), (4,)), [(f"({_OFF} + {o}) * 2 + {j}", f"({_bspline_sql(f'(samp / 100000.0 * 63 - {_OFF} + {3 - o})')}) * {f}(psi * 4)") for o in range(4) for j, f in enumerate(("sin", "cos"))], where="d = d")


@query("decimated_hold", f"SELECT det, samp - samp % 8 AS samp, {G('sum(d)', 1e3)} AS v FROM tod GROUP BY 1, 2")
def _(t):
    return t.tod.groupBy("det", B.block("samp", 8).alias("samp")).agg(g(F.sum("d"), 1e3).alias("v"))


_GA, _GE = f"(({AZ_SQL} + 1) * 3)", "(0.4 + 0.3 * abs(cos(samp * 0.01::DOUBLE)))"
_GROUND = f"(SELECT event_id, d, psi AS chi, ((floor(({_GE} - 0.2) / 0.1 + 0.0)::BIGINT) + (round_even({_GA} / (2 * pi() / 16), 0)::BIGINT % 16) * 8) AS ground FROM tod)"


def ground_samples(t):
    land = N.Horizon(n_az=16, n_alt=8, low=0.2, high=1.0)
    az, el = (azimuth() + 1) * 3, F.abs(F.cos(F.col("samp") * 0.01)) * 0.3 + 0.4
    low = F.floor((el - 0.2) / 0.1).cast("long") + F.pmod(F.rint(az / (2 * A.PI / 16)).cast("long"), F.lit(16)) * 8
    return t.tod.select("event_id", F.col("psi").alias("chi"), F.col("d").alias("v"), low.alias("ground")), land


@query("ground_template_transpose", f"SELECT ground, {GC(1e3, i='sum(d)', q='sum(d * cos(4 * chi))', u='sum(d * sin(4 * chi))')} FROM {_GROUND} AS x JOIN (SELECT event_id AS e FROM tod) ON e = event_id GROUP BY ground")
def _(t):
    x, _ = ground_samples(t)
    return B.Ground(x).T(x).select("ground", *cols(1e3, i=F.col("i"), q=F.col("q"), u=F.col("u")))


@query("ground_template", f"SELECT event_id, {G('ground + 1 + cos(4 * chi) * 0.5 - sin(4 * chi) * 0.25')} AS v FROM {_GROUND} AS x JOIN (SELECT event_id AS e FROM tod) ON e = event_id")
def _(t):
    x, land = ground_samples(t)
    pickup = t.spark.range(land.size).select(F.col("id").alias("ground"), (F.col("id") + 1.0).alias("i"), F.lit(0.5).alias("q"), F.lit(-0.25).alias("u"))
    return B.Ground(x)(pickup).select("event_id", g(F.col("v")).alias("v"))


@query("interval_ids", "SELECT tod.event_id, i.interval FROM tod LEFT JOIN (SELECT DISTINCT det, samp - samp % 20 AS lo, samp - samp % 20 + 10 + det % 10 AS hi, samp // 20 AS interval FROM tod) i ON i.det = tod.det AND tod.samp >= i.lo AND tod.samp < i.hi")
def _(t):
    k = F.floor(F.col("samp") / 20).cast("long")
    marks = t.tod.select("det", k.alias("interval")).distinct().select("det", (F.col("interval") * 20).alias("start"), (F.col("interval") * 20 + 10 + F.col("det") % 10).alias("end"), "interval")
    return O.intervals_of(t.tod.select("event_id", "det", "samp"), marks).select("event_id", "interval")


# --- pointing ------------------------------------------------------------------------------------------------------

_DETS = [(0, 0.0, 0.0, 0.0), (1, 0.05, 0.3, 0.4), (2, 0.08, 2.0, -1.1)]


def boresight(t):
    q = A.from_iso(F.col("theta"), F.col("phi"), F.col("psi"))
    return t.angles.select("event_id", "d", *[x.alias(n) for x, n in zip(q, P.QUAT, strict=True)])


def detectors(t):
    table = t.spark.createDataFrame(_DETS, "det long, theta double, phi double, psi double")
    q = A.from_iso(F.col("theta"), F.col("phi"), F.col("psi"))
    return table.select("det", *[x.alias(n) for x, n in zip(q, P.QUAT, strict=True)])


_DET_SQL = f"(SELECT det, {', '.join(f'{x} AS {n}' for x, n in zip(_ISO, 'efgh'))} FROM (VALUES {', '.join(map(str, _DETS))}) AS v(det, theta, phi, psi))"
_PROD = _sq(tuple("abcd"), tuple("efgh"))
_SEEN = f"(SELECT event_id, det, d0, a, b, c, d FROM (SELECT event_id, det, d0, {', '.join(f'{x} AS {n}' for x, n in zip(_PROD, 'abcd'))} FROM (SELECT event_id, d AS d0, {', '.join(f'{x} AS {n}' for x, n in zip(_ISO, 'abcd'))} FROM ang) CROSS JOIN {_DET_SQL}))"
_SKY192 = "(SELECT pix % 192 AS p, avg(i) AS i, avg(q) AS q, avg(u) AS u FROM sky GROUP BY 1)"


def _ringed(inner: str, nside: int) -> str:
    """SQL of pixels for a subquery with z and phi."""
    return ring_sql(nside).replace("FROM ang))))", f"FROM ({inner})))))")


_POINTED = _ringed(f"SELECT event_id, det, d0, a*a - b*b - c*c + d*d AS z, atan2(c*d - a*b, a*c + b*d) AS phi, atan2(c*d + a*b, a*c - b*d) AS psi FROM {_SEEN}", 4)


def pointing(t):
    return P.Pointing.create(N.Healpix(nside=4), boresight(t), detectors(t))


def sky192(t):
    return t.sky.groupBy((F.col("pix") % 192).alias("pix")).agg(F.avg("i").alias("i"), F.avg("q").alias("q"), F.avg("u").alias("u"))


def _named(name: str, ctes: list[str], sql: str) -> None:
    from tessera.sources.tables import SQL as TABLES

    known = TABLES | {"ang": ANGLES}
    SQL[name] = f"WITH {', '.join(known[c] for c in ctes)} {sql}"


@query("pointing_quaternions")
def _(t):
    return pointing(t).seen.select("event_id", "det", "pix", *cols(c=F.cos("psi"), s=F.sin("psi")))


_named("pointing_quaternions", ["ang"], f"SELECT event_id, det, pix::BIGINT AS pix, {GC(c='cos(psi)', s='sin(psi)')} FROM {_POINTED}")


@query("pointing_on_the_fly")
def _(t):
    op = P.Detector() @ pointing(t)
    return op(sky192(t)).select("event_id", "det", g(F.col("v")).alias("v"))


_named("pointing_on_the_fly", ["ang", "sky"], f"SELECT event_id, det, {G('(i + cos(2*psi)*q + sin(2*psi)*u) / 2')} AS v FROM {_POINTED} JOIN {_SKY192} s ON s.p = pix")


@query("pointing_on_the_fly_transpose")
def _(t):
    point = pointing(t)
    seen = point.seen.withColumn("v", F.col("d"))
    return (P.Detector() @ point).T(seen).select("pix", *cols(1237.0, i=F.col("i"), q=F.col("q"), u=F.col("u")))


_named("pointing_on_the_fly_transpose", ["ang"], f"SELECT pix::BIGINT AS pix, {GC(1237.0, i='sum(d0) / 2', q='sum(d0 * cos(2*psi)) / 2', u='sum(d0 * sin(2*psi)) / 2')} FROM {_POINTED} GROUP BY pix")


@query("cached_pointing")
def _(t):
    seen = pointing(t).expanded()
    return seen.seen.where("det = 1").groupBy("pix").agg(F.count("*").alias("hits"))


_named("cached_pointing", ["ang"], f"SELECT pix::BIGINT AS pix, count(*) AS hits FROM {_POINTED} WHERE det = 1 GROUP BY pix")


@query("acquisition_hwp")
def _(t):
    op = P.acquisition(N.Healpix(nside=4), boresight(t).withColumn("chi", F.col("event_id") * 0.01), detectors(t), plate=True)
    return op(sky192(t)).select("event_id", "det", g(F.col("v")).alias("v"))


_GAMMA = "CASE det " + " ".join(f"WHEN {d} THEN {p + s!r}::DOUBLE" for d, _, p, s in _DETS) + " END"
_BFRAME = _POINTED.replace("AS psi FROM", f"- {_GAMMA} AS psi FROM")
_named("acquisition_hwp", ["ang", "sky"], f"SELECT event_id, det, {G(f'i / 2 + (qr * cos(4*chi - 2*({_GAMMA})) + ur * sin(4*chi - 2*({_GAMMA}))) / 2')} AS v FROM (SELECT event_id, det, event_id * 0.01::DOUBLE AS chi, i, q*cos(2*psi) + u*sin(2*psi) AS qr, u*cos(2*psi) - q*sin(2*psi) AS ur FROM {_BFRAME} JOIN {_SKY192} s ON s.p = pix)")


@query("acquisition_demodulated")
def _(t):
    op = P.acquisition(N.Healpix(nside=4), boresight(t), detectors(t), demodulated=True)
    return op(sky192(t)).select("event_id", "det", *cols(i=F.col("i"), q=F.col("q"), u=F.col("u")))


_named("acquisition_demodulated", ["ang", "sky"], f"SELECT event_id, det, {GC(i='i / 2', q=f'(qr * cos(2*({_GAMMA})) - ur * sin(2*({_GAMMA}))) / 2', u=f'(ur * cos(2*({_GAMMA})) + qr * sin(2*({_GAMMA}))) / 2')} FROM (SELECT event_id, det, i, q*cos(2*psi) + u*sin(2*psi) AS qr, u*cos(2*psi) - q*sin(2*psi) AS ur FROM {_BFRAME} JOIN {_SKY192} s ON s.p = pix)")

_ZYZ = [
    ["cos(phi)*cos(theta)*cos(psi) - sin(phi)*sin(psi)", "-cos(phi)*cos(theta)*sin(psi) - sin(phi)*cos(psi)", "cos(phi)*sin(theta)"],
    ["sin(phi)*cos(theta)*cos(psi) + cos(phi)*sin(psi)", "cos(phi)*cos(psi) - sin(phi)*cos(theta)*sin(psi)", "sin(phi)*sin(theta)"],
    ["-sin(theta)*cos(psi)", "sin(theta)*sin(psi)", "cos(theta)"],
]


@query("rotation_matrix", f"SELECT event_id, {GC(**{f'm{i}{j}': _ZYZ[i][j] for i in range(3) for j in range(3)})} FROM ang")
def _(t):
    m = P.rotation_matrix(tuple(x * 2 for x in A.from_iso(F.col("theta"), F.col("phi"), F.col("psi"))))  # any length
    return t.angles.select("event_id", *cols(**{f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)}))


@query("qrot", f"SELECT event_id, {GC(**{n: f'0.6 * ({r[0]}) - 0.8 * ({r[2]})' for n, r in zip('xyz', _ZYZ)})} FROM ang")
def _(t):
    v = P.turned(A.from_iso(F.col("theta"), F.col("phi"), F.col("psi")), (F.lit(0.6), F.lit(0.0), F.lit(-0.8)))
    return t.angles.select("event_id", *cols(**dict(zip("xyz", v, strict=True))))


@query("zyz_rotation", f"SELECT event_id, {GC(**{f'm{i}{j}': _ZYZ[i][j] for i in range(3) for j in range(3)})} FROM ang")
def _(t):
    m = P.zyz(F.col("theta"), F.col("phi"), F.col("psi"))
    return t.angles.select("event_id", *cols(**{f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)}))


@query("vec2dir", f"SELECT event_id, {GC(x='sin(theta)*cos(phi)', y='sin(theta)*sin(phi)', z='z')} FROM ang")
def _(t):
    return t.angles.select("event_id", *cols(**dict(zip("xyz", P.direction(F.col("theta"), F.col("phi")), strict=True))))


@query("xieta_gamma", f"SELECT event_id, {GC(xi='-sin(theta)*sin(phi)', eta='-sin(theta)*cos(phi)', c='cos(phi + psi)', s='sin(phi + psi)')} FROM ang")
def _(t):
    xi, eta, gamma = P.xieta(A.from_iso(F.col("theta"), F.col("phi"), F.col("psi")))
    return t.angles.select("event_id", *cols(xi=xi, eta=eta, c=F.cos(gamma), s=F.sin(gamma)))


_DIRS = [(0, 0.0, 0.0, 1.0), (1, 0.6, 0.0, 0.8), (2, 0.0, -0.28, 0.96)]


@query("projection_sampling")
def _(t):
    dets = t.spark.createDataFrame(_DIRS, "det long, x double, y double, z double")
    return P.projected(N.Car(lon0=10.0, step=4.0, nx=90, ny=45), t.angles.select("event_id", "theta", "phi", "psi"), dets).groupBy("det", "pix").agg(F.count("*").alias("hits"))


_PR = [" + ".join(f"({m}) * {n}" for m, n in zip(r, ("dx", "dy", "dz"))) for r in _ZYZ]
_PX = "round_even((((degrees(atan2(y, x)) - 10 + 180) % 360 + 360) % 360 - 180) / -4 + 44.5, 0)"
_PY = "round_even(degrees(pi()/2 - acos(greatest(-1, least(1, z)))) / 4 + 22, 0)"
_named("projection_sampling", ["ang"], f"SELECT det, (CASE WHEN {_PX} >= 0 AND {_PX} < 90 AND {_PY} >= 0 AND {_PY} < 45 THEN {_PY} * 90 + {_PX} ELSE -1 END)::BIGINT AS pix, count(*) AS hits FROM (SELECT det, {_PR[0]} AS x, {_PR[1]} AS y, {_PR[2]} AS z FROM (SELECT theta, phi, psi FROM ang) CROSS JOIN (VALUES {', '.join(map(str, _DIRS))}) AS v(det, dx, dy, dz)) GROUP BY 1, 2")

_WX, _WY = "round_even((tan(th)*cos(phi)*1000 + k * 0.5) / 25 + 31.5, 0)", "round_even((tan(th)*sin(phi)*1000 - k * 0.25) / 25 + 31.5, 0)"


@query("wind_pointing")
def _(t):
    x = t.angles.select("event_id", (F.col("theta") * 0.2).alias("theta"), "phi", (F.col("event_id") % 1000).cast("double").alias("t"), "d")
    return P.drifted(N.Tangential(height=1000.0, step=25.0, nx=64, ny=64), x, 0.5, -0.25).select("event_id", "pix", g(F.col("airmass")).alias("airmass"))


_named("wind_pointing", ["ang"], f"SELECT event_id, (CASE WHEN {_WX} >= 0 AND {_WX} < 64 AND {_WY} >= 0 AND {_WY} < 64 THEN {_WY} * 64 + {_WX} ELSE -1 END)::BIGINT AS pix, {G('1 / cos(th)')} AS airmass FROM (SELECT event_id, theta * 0.2::DOUBLE AS th, phi, (event_id % 1000)::DOUBLE AS k FROM ang)")

# --- landscapes ----------------------------------------------------------------------------------------------------


@query("frequency_healpix")
def _(t):
    land = N.FrequencyHealpix(nside=4, frequencies=(40.0, 90.0, 150.0))
    return t.angles.select("event_id", land.index(F.col("event_id") % 4, land.pixel(F.col("theta"), F.col("phi"))).alias("pix"))


_named("frequency_healpix", ["ang"], f"SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (event_id % 4) * 192 + pix ELSE -1 END::BIGINT AS pix FROM {_ringed('SELECT event_id, cos(theta) AS z, phi FROM ang', 4)}")


@query("horizon_bins", f"SELECT k, {GC(low='0.2 + 0.1 * k', center='0.25 + 0.1 * k', azimuth='2 * pi() * k / 8')} FROM (SELECT unnest(range(0, 8))::BIGINT AS k)")
def _(t):
    land = N.Horizon(n_az=8, n_alt=8, low=0.2, high=1.0)
    rows = list(zip(range(8), land.altitude_edges(), land.altitude_centers(), land.azimuth_centers(), strict=False))
    return t.spark.createDataFrame(rows, "k long, low double, center double, azimuth double").select("k", *cols(low=F.col("low"), center=F.col("center"), azimuth=F.col("azimuth")))


@query("tangential_from_extent")
def _(t):
    land = N.Tangential.from_extent(1000.0, 25.0, 1600.0, 800.0)
    return t.angles.select("event_id", land.pixel(F.col("theta") * 0.2, F.col("phi")).alias("pix"))


_TX, _TY = (f"round_even(tan(theta * 0.2::DOUBLE)*{f}(phi)*1000 / 25 + {c}, 0)" for f, c in (("cos", 31.5), ("sin", 15.5)))
_named("tangential_from_extent", ["ang"], f"SELECT event_id, (CASE WHEN {_TX} >= 0 AND {_TX} < 64 AND {_TY} >= 0 AND {_TY} < 32 THEN {_TY} * 64 + {_TX} ELSE -1 END)::BIGINT AS pix FROM ang")
_LOCAL = "(SELECT l_partkey AS pix, row_number() OVER (ORDER BY l_partkey) - 1 AS local FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 25))"


@query("local_pixels", f"SELECT pix, local FROM {_LOCAL}")
def _(t):
    listed = t.read("lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("pix"))
    return N.local_pixels(listed.union(t.spark.range(3).select((F.col("id") - 3).alias("pix"))), 1 << 40)


@query("local_sink", f"SELECT p_partkey, coalesce(local, (SELECT count(*) FROM {_LOCAL})) AS local FROM part LEFT JOIN {_LOCAL} ON pix = p_partkey")
def _(t):
    mask = t.read("lineitem").select(F.col("l_partkey").alias("pix"), (F.col("l_quantity") > 25).alias("keep"))
    return N.global2local(N.local_from_mask(mask, 1 << 40), t.read("part").select(F.col("p_partkey").alias("pix"))).select(F.col("pix").alias("p_partkey"), "local")


@query("landscape_coverage", "SELECT p AS pix, count(pix) AS hits FROM (SELECT unnest(range(0, 60))::BIGINT AS p) LEFT JOIN tod ON pix = p GROUP BY p")
def _(t):
    land = N.Car(nx=10, ny=6)
    return land.coverage(t.tod)


# --- trees and axes ------------------------------------------------------------------------------------------------

vq("noise_diagonal", lambda t: L.Diagonal(small(t).withColumn("d", F.col("d") + 1), ("k",)), "v * (user_id % 5 + 1)", "(SELECT event_id AS k, value AS v, user_id FROM events)")
vq("noise_diagonal_inverse", lambda t: L.Diagonal(small(t).withColumn("d", F.col("d") + 1), ("k",)).I, "v / (user_id % 5 + 1)", "(SELECT event_id AS k, value AS v, user_id FROM events)")
vq("weight_masked", lambda t: T.Weight(L.Diagonal(small(t), ("k",)), L.Mask("k % 3 <> 0")), "CASE WHEN k % 3 <> 0 THEN v * (user_id % 5) ELSE 0 END", "(SELECT event_id AS k, value AS v, user_id FROM events)")


@query("weight_toeplitz_masked", f"SELECT event_id, {G('CASE WHEN valid THEN m - 0.25 * (coalesce(lag(m) OVER w, 0) + coalesce(lead(m) OVER w, 0)) ELSE 0 END', 1e4)} AS v FROM (SELECT *, CASE WHEN valid THEN d ELSE 0 END AS m FROM tod) WINDOW w AS (PARTITION BY det ORDER BY samp)")
def _(t):
    op = T.Weight(L.Toeplitz((1.0, -0.25)), L.Mask("valid"))
    return op(t.tod.select("event_id", "det", "samp", "valid", F.col("d").alias("v"))).select("event_id", g(F.col("v"), 1e4).alias("v"))


@query("reshape_transpose", f"SELECT id, (k // 8) * 8 + k % 8 AS k, {G('v')} AS v FROM series")
def _(t):
    op = T.Reshape("k", "a", "b", 8)
    return op.T(op(t.series)).select("id", "k", g(F.col("v")).alias("v"))


@query("tree_full_like", f"SELECT leaf, k, 2.5::DOUBLE AS v FROM {LEAVES} AS x")
def _(t):
    return T.full_like(leaves(t), 2.5)


for _how, _op in (("add", "x.v + y.v"), ("sub", "x.v - y.v"), ("mul", "x.v * y.v"), ("truediv", "x.v / (abs(x.v) + 1)"), ("power", "pow(abs(x.v) + 1, 0.5)")):

    def _tree(t, how=_how):
        x = leaves(t)
        if how == "truediv":
            y = x.withColumn("v", F.abs("v") + 1)
        elif how == "power":
            x, y = x.withColumn("v", F.abs("v") + 1), 0.5
        else:
            y = x.withColumn("v", F.col("v") * 2 + 1)
        return T.combine(how, x, y).select("leaf", "k", g(F.col("v"), 1e2).alias("v"))

    query(f"tree_{_how}", f"SELECT x.leaf, x.k, {G(_op.replace('y.v', '(x.v * 2 + 1)'), 1e2)} AS v FROM {LEAVES} AS x")(_tree)


@query("tree_prefix", f"SELECT x.leaf, x.k, {G('x.v * CASE WHEN x.leaf = chr(97) THEN 2 ELSE 3 END', 1e4)} AS v FROM {LEAVES} AS x")
def _(t):
    x = leaves(t)
    return T.combine("mul", x, x.select("leaf").distinct().withColumn("v", F.when(F.col("leaf") == "a", 2.0).otherwise(3.0))).select("leaf", "k", g(F.col("v"), 1e4).alias("v"))


def _stokes_leaves(t):
    return t.sky.select("pix", F.explode(F.create_map(F.lit("i"), F.col("i"), F.lit("q"), F.col("q"), F.lit("u"), F.col("u"))).alias("leaf", "v"))


_ENTRIES = {"a": {"i": 2.0, "q": 1.0}, "b": {"q": 1.0, "u": -1.0}}


@query("tree_operator", f"SELECT pix, 'a' AS leaf, {G('2 * i + q')} AS v FROM sky UNION ALL SELECT pix, 'b', {G('q - u')} FROM sky")
def _(t):
    return T.TreeOperator(_ENTRIES)(_stokes_leaves(t)).select("pix", "leaf", g(F.col("v")).alias("v"))


_PINV = np.linalg.pinv(T.TreeOperator(_ENTRIES).as_matrix())


@query("tree_operator_inverse", " UNION ALL ".join(f"SELECT pix, '{c}' AS leaf, {G(f'({_PINV[j, 0]!r}::DOUBLE) * i + ({_PINV[j, 1]!r}::DOUBLE) * q'.replace('np.float64', ''))} AS v FROM sky" for j, c in enumerate("iqu")))
def _(t):
    out = t.sky.select("pix", F.explode(F.create_map(F.lit("a"), F.col("i"), F.lit("b"), F.col("q"))).alias("leaf", "v"))
    return T.TreeOperator(_ENTRIES).I(out).select("pix", "leaf", g(F.col("v")).alias("v"))


# --- sources -------------------------------------------------------------------------------------------------------

@query("depth_to_sigma", f"SELECT p_partkey, {G('p_retailprice / p_size')} AS sigma FROM part")
def _(t):
    return t.read("part").select("p_partkey", g(O.noise_sigma(F.col("p_retailprice"), F.col("p_size"))).alias("sigma"))


_FX, _FY = "((k // 30) * (0.3 / 29) - 0.15)", "((k % 30) * (0.3 / 29) - 0.15)"
_FR = f"sqrt({_FX}*{_FX} + {_FY}*{_FY} + 1)"


@query("focal_plane", f"SELECT k AS det, {GC(x=f'{_FX} / {_FR}', y=f'{_FY} / {_FR}', z=f'1 / {_FR}')} FROM (SELECT unnest(range(0, 900))::BIGINT AS k)")
def _(t):
    return O.focal_plane(t.spark).select("det", *cols(x=F.col("x"), y=F.col("y"), z=F.col("z")))


@query("detector_selection", "SELECT DISTINCT det FROM tod WHERE det % 4 = 2 AND det % 3 = 1")
def _(t):
    dets = t.tod.select("det").distinct().withColumns({"wafer": F.concat(F.lit("w"), F.col("det") % 4), "band": F.when(F.col("det") % 3 == 1, "f090").otherwise("f150")})
    return O.select_detectors(dets, "w2", "f090").select("det")


@query("observation_rebase", f"SELECT event_id, {G('t - min(t) OVER (PARTITION BY obs)', 1e3)} AS t FROM tod")
def _(t):
    return O.rebased(t.tod.select("event_id", "obs", "t"), ("obs",)).select("event_id", g(F.col("t"), 1e3).alias("t"))


@query("noise_import", f"SELECT c_custkey, {GC(alpha='-c_acctbal', f0='coalesce(CASE WHEN c_nationkey > 12 THEN c_nationkey END, 0.00001)')} FROM customer")
def _(t):
    fits = t.read("customer").select("c_custkey", F.col("c_acctbal").alias("alpha"), F.when(F.col("c_nationkey") > 12, F.col("c_nationkey").cast("double")).alias("f0"))
    return O.imported_noise(fits).select("c_custkey", *cols(alpha=F.col("alpha"), f0=F.col("f0")))


@query("half_power", f"SELECT event_id, {G('d * 0.5', 1e4)} AS d FROM tod")
def _(t):
    return O.half_power(t.tod).select("event_id", g(F.col("d"), 1e4).alias("d"))


@query("identity_lookup", "SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'CHINA' THEN 'CN' ELSE n_name END AS name FROM nation")
def _(t):
    return t.read("nation").select("n_nationkey", O.identity_lookup({"FRANCE": "FR", "CHINA": "CN"}, F.col("n_name")).alias("name"))


@query("fold_key", "SELECT c_custkey, (('0x' || right(sha1('7/' || c_nationkey || '/' || c_custkey), 8))::BIGINT & 2147483647)::BIGINT AS key FROM customer")
def _(t):
    return t.read("customer").select("c_custkey", T.fold_key(7, F.col("c_nationkey"), F.col("c_custkey")).alias("key"))


@query("failure_union", "SELECT DISTINCT user_id::VARCHAR AS observation, event_type AS reason FROM events WHERE event_type = 'error' OR event_type = 'click'")
def _(t):
    e = t.read("events").select(F.col("user_id").cast("string").alias("observation"), F.col("event_type").alias("reason"))
    return O.all_failures(e.where("reason = 'error'"), e.where("reason = 'click'"), e.where("reason = 'error'"))


@query("random_sampling")
def _(t):
    hits = t.tod.groupBy("pix").agg(F.count("*").alias("hits"))
    return O.random_sampling(hits, 10_000, seed=3)


# --- selections, streams, eigenvalues ------------------------------------------------------------------------------

@query("pixel_selector_single", "SELECT pix FROM (SELECT pix, n, max(high) OVER () AS top, low, high FROM (SELECT pix, n, n / 2.0 + r AS high, n / 2.0 - r AS low FROM (SELECT pix, count(*) AS n, sqrt(pow(sum(cos(4*psi)) / 2, 2) + pow(sum(sin(4*psi)) / 2, 2)) AS r FROM tod GROUP BY pix))) WHERE low > 0.01 * high AND high > 0.01 * top")
def _(t):
    a = F.col("psi") * 2
    sums = t.tod.groupBy("pix").agg(*[F.sum(x).alias(n) for n, x in (("qq", F.cos(a) * F.cos(a)), ("qu", F.cos(a) * F.sin(a)), ("uu", F.sin(a) * F.sin(a)))])
    low, high = A.eigen2(F.col("qq"), F.col("qu"), F.col("uu"))
    eigen = sums.select("pix", low.alias("low"), high.alias("high"))
    return eigen.crossJoin(F.broadcast(eigen.agg(F.max("high").alias("top")))).where("low > 0.01 * high and high > 0.01 * top").select("pix")


@query("stream_normal", f"SELECT p AS pix, {G('i * sum((obs + 1) * (obs + 1))', 1e4)} AS v FROM {SKY48} CROSS JOIN (SELECT DISTINCT obs FROM tod) GROUP BY p, i")
def _(t):
    scale = lambda x: x.withColumn("v", F.col("v") * (F.col("obs") + 1))
    column = R.StreamColumn(scale, t.tod.select("obs").distinct(), scale)
    return (column.T @ column)(sky48(t).select("pix", F.col("i").alias("v"))).select("pix", g(F.col("v"), 1e4).alias("v"))


@query("eigvalsh_batched")
def _(t):
    def run(batches):
        for b in batches:
            m = np.stack(b["embedding"].map(lambda x: np.asarray(x, float)).tolist())[:, :36].reshape(-1, 6, 6)
            yield pd.DataFrame({"vec_id": b["vec_id"], "values": np.round(H.eigvalsh((m + m.transpose(0, 2, 1)) / 2), 9).tolist()})

    return t.read("embeddings").select("vec_id", "embedding").where("embedding is not null").mapInPandas(run, "vec_id long, values array<double>")


@query("beam_smoothing")
def _(t):
    """Maps of 192 pixels, one for each component of the mean of `sky`, smoothed by a beam: one task for each map."""
    maps = sky192(t).select("pix", F.explode(F.create_map(F.lit("i"), F.col("i"), F.lit("q"), F.col("q"))).alias("leaf", "v"))

    def smooth(leaf, rows):
        x = np.zeros(192)
        x[rows["pix"].to_numpy()] = rows["v"]
        out = H.beam(x, np.exp(-0.05 * np.arange(8) * np.arange(1, 9)))
        return pd.DataFrame({"leaf": leaf[0], "pix": np.arange(192), "v": np.round(out, 9)})

    return maps.groupBy("leaf").applyInPandas(smooth, "leaf string, pix long, v double")
