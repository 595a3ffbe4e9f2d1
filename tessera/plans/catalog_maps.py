"""The second half of the catalog: pointing, maps, templates, estimators, streams and series kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import angles as A
from tessera.functions import landscapes as P
from tessera.operators import kernels as K
from tessera.operators import maps as M
from tessera.operators import streams as R
from tessera.plans.catalog import COF, DET3, GC, SOLVE_SQL, G, cols, g, labelled, query
from tessera.plans.catalog import LABELS as LABEL_SQL
from tessera.sources.tables import NPIX

# --- pointing ------------------------------------------------------------------------------------------------------

SKY48 = f"(SELECT pix % {NPIX} AS p, avg(i) AS i, avg(q) AS q, avg(u) AS u FROM sky GROUP BY 1)"


def sky48(t):
    return t.sky.groupBy((F.col("pix") % NPIX).alias("pix")).agg(F.avg("i").alias("i"), F.avg("q").alias("q"), F.avg("u").alias("u"))


@query("pointing_forward", f"SELECT event_id, {G('(i + cos(2*psi)*q + sin(2*psi)*u) / 2')} AS v FROM tod JOIN {SKY48} ON p = pix")
def _(t):
    seen = t.tod.join(sky48(t), "pix")
    q, _u = A.rotate_qu(F.col("q"), F.col("u"), F.col("psi"))
    return seen.select("event_id", g(A.polarizer(F.col("i"), q)).alias("v"))


@query("pointing_transpose", f"SELECT pix, {GC(1e3, i='sum(d) / 2', q='sum(d * cos(2*psi)) / 2', u='sum(d * sin(2*psi)) / 2')} FROM tod GROUP BY pix")
def _(t):
    d, a = F.col("d"), F.col("psi") * 2
    return t.tod.groupBy("pix").agg(*cols(1e3, i=F.sum(d) / 2, q=F.sum(d * F.cos(a)) / 2, u=F.sum(d * F.sin(a)) / 2))


_BX, _BY = "(theta * 10)", "(phi * 5 + 16)"
_NB = " UNION ALL ".join(f"SELECT event_id, d, floor({_BX}) + {dx} AS x, floor({_BY}) + {dy} AS y, ({f'{_BX} - floor({_BX})' if dx else f'1 - ({_BX} - floor({_BX}))'}) * ({f'{_BY} - floor({_BY})' if dy else f'1 - ({_BY} - floor({_BY}))'}) AS w FROM ang" for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)))
_BI = f"(SELECT event_id, d, (y * 24 + x)::BIGINT AS pix, w / sum(w) OVER (PARTITION BY event_id) AS w FROM ({_NB}) WHERE x >= 0 AND x < 24 AND y >= 0 AND y < 30)"


def neighbours(t):
    near = A.bilinear(F.col("theta") * 10, F.col("phi") * 5 + 16, 24, 30)
    return t.angles.select("event_id", "d", F.explode(near).alias("n")).where("n.pix >= 0").select("event_id", "d", "n.pix", "n.w")


@query("bilinear_weights", f"SELECT event_id, pix, {G('w')} AS w FROM {_BI} WHERE event_id IN (SELECT event_id FROM ang)")
def _(t):
    return neighbours(t).select("event_id", "pix", g(F.col("w")).alias("w"))


@query("pointing_bilinear", f"SELECT event_id, {G('sum(w * sin(pix * 0.1::DOUBLE))')} AS v FROM {_BI} WHERE event_id IN (SELECT event_id FROM ang) GROUP BY event_id")
def _(t):
    return neighbours(t).groupBy("event_id").agg(g(F.sum(F.col("w") * F.sin(F.col("pix") * 0.1))).alias("v"))


@query("pointing_bilinear_transpose", f"SELECT pix, {G('sum(w * d)', 1e3)} AS v FROM {_BI} WHERE event_id IN (SELECT event_id FROM ang) GROUP BY pix")
def _(t):
    return neighbours(t).groupBy("pix").agg(g(F.sum(F.col("w") * F.col("d")), 1e3).alias("v"))


@query("hit_map", "SELECT pix, sum(valid::INT)::BIGINT AS hits FROM tod GROUP BY pix")
def _(t):
    return t.tod.groupBy("pix").agg(F.sum(F.col("valid").cast("long")).alias("hits"))


@query("coverage", "SELECT r.p AS pix, count(tod.pix)::BIGINT AS n FROM (SELECT unnest(range(0, 60))::BIGINT AS p) r LEFT JOIN tod ON tod.pix = r.p GROUP BY 1")
def _(t):
    n = t.tod.groupBy("pix").agg(F.count("*").alias("n"))
    return t.spark.range(60).select(F.col("id").alias("pix")).join(n, "pix", "left").select("pix", F.coalesce("n", F.lit(0)).alias("n"))


LOCAL = "(SELECT pix AS p, row_number() OVER (ORDER BY pix) - 1 AS k FROM (SELECT DISTINCT pix FROM tod WHERE pix % 3 = 0))"


def local(t):
    """(pix, k): the listed pixels and their local numbers."""
    return P.local_pixels(t.tod.where("pix % 3 = 0").select("pix"), NPIX).withColumnRenamed("local", "k")


@query("local_landscape_global2local", f"SELECT event_id, coalesce(k, (SELECT count(*) FROM {LOCAL}))::BIGINT AS k FROM tod LEFT JOIN {LOCAL} ON p = pix WHERE pix >= 0")
def _(t):
    here = local(t).withColumnRenamed("k", "local")
    return P.global2local(here, t.tod.select("event_id", "pix")).select("event_id", F.col("local").alias("k"))


@query("local_restrict", f"SELECT k::BIGINT AS k, {G('i')} AS i FROM {SKY48} s JOIN (SELECT * FROM {LOCAL} JOIN (SELECT count(*) c FROM tod) ON true) l ON l.p = s.p")
def _(t):
    return sky48(t).join(local(t), "pix").select("k", g(F.col("i")).alias("i"))


@query("local_promote", f"SELECT s.p AS pix, {G('CASE WHEN l.p IS NULL THEN -1 ELSE k * 0.5 END')} AS v FROM {SKY48} s LEFT JOIN (SELECT * FROM {LOCAL} JOIN (SELECT count(*) c FROM tod) ON true) l ON l.p = s.p")
def _(t):
    return sky48(t).select("pix").join(local(t), "pix", "left").select("pix", g(F.coalesce(F.col("k") * 0.5, F.lit(-1.0))).alias("v"))


@query("local_sink_counts", "SELECT pix % 3 = 0 AS listed, count(*)::BIGINT AS n FROM tod GROUP BY 1")
def _(t):
    seen = t.tod.join(local(t), "pix", "left")
    return seen.groupBy(F.col("k").isNotNull().alias("listed")).agg(F.count("*").alias("n"))


# --- maps ----------------------------------------------------------------------------------------------------------

_W = "(SELECT det, CASE WHEN sum(CASE WHEN valid THEN d*d END) > 0 THEN sum(valid::INT) / sum(CASE WHEN valid THEN d*d END) ELSE 0 END AS w FROM tod GROUP BY det)"
_A = ("1", "cos(2*psi)", "sin(2*psi)")
_SUMS = ", ".join(f"sum(CASE WHEN valid THEN w ELSE 0 END * {_A[i]} * {_A[j]}) AS m{i}{j}" for i, j in M.PAIRS) + ", " + ", ".join(f"sum(CASE WHEN valid THEN w ELSE 0 END * {_A[i]} * d) AS r{i}" for i in range(3))
_PIX = f"(SELECT pix, sum(valid::INT)::BIGINT AS hits, {_SUMS} FROM tod JOIN {_W} USING (det) GROUP BY pix)"
_IQU = dict(zip("iqu", SOLVE_SQL, strict=True))


@query("binned_map", f"SELECT pix, hits, {GC(1e4, **_IQU)} FROM {_PIX} AS sums WHERE pix IN (SELECT pix FROM tod)")
def _(t):
    return M.binned(t.tod).select("pix", "hits", *cols(1e4, i=F.col("i"), q=F.col("q"), u=F.col("u")))


@query("multi_obs_map", f"SELECT pix, hits, {GC(1e4, **_IQU)} FROM (SELECT pix, sum(hits)::BIGINT AS hits, {', '.join(f'sum(m{i}{j}) AS m{i}{j}' for i, j in M.PAIRS)}, {', '.join(f'sum(r{i}) AS r{i}' for i in range(3))} FROM (SELECT obs, pix, sum(valid::INT) AS hits, {_SUMS} FROM tod JOIN {_W} USING (det) GROUP BY obs, pix) GROUP BY pix)")
def _(t):
    per_obs = M.pixel_sums(t.tod.join(M.white_weights(t.tod), "det"), ("obs", "pix"))
    total = per_obs.groupBy("pix").agg(*[F.sum(c).alias(c) for c in per_obs.columns if c not in ("obs", "pix")])
    return M.solve_pixels(total).select("pix", "hits", *cols(1e4, i=F.col("i"), q=F.col("q"), u=F.col("u")))


@query("binned_map_demodulated", f"SELECT pix, {GC(1e4, q='avg(d * cos(2*psi)) * 2', u='avg(d * sin(2*psi)) * 2')} FROM tod WHERE valid GROUP BY pix")
def _(t):
    d, a = F.col("d"), F.col("psi") * 2
    return t.tod.where("valid").groupBy("pix").agg(*cols(1e4, q=F.avg(d * F.cos(a)) * 2, u=F.avg(d * F.sin(a)) * 2))


@query("block_jacobi", f"SELECT pix, {GC(1e8, **{f'c{i}{j}': f'CASE WHEN abs({DET3}) > 1e-12 THEN {COF[i][j]} / {DET3} ELSE 0 END * 1e-3' for i, j in M.PAIRS})} FROM {_PIX} AS sums WHERE pix IN (SELECT pix FROM tod)")
def _(t):
    sums = M.pixel_sums(t.tod.join(M.white_weights(t.tod), "det"))
    m = [F.col(f"m{i}{j}") for i, j in M.PAIRS]
    unit = [[F.lit(float(k == r)) for k in range(3)] for r in range(3)]
    inverse = [A.solve3(m, e)[1:] for e in unit]
    return sums.select("pix", *cols(1e8, **{f"c{i}{j}": inverse[i][j] * 1e-3 for i, j in M.PAIRS}))


_E2M, _E2D = "(m11 + m22) / 2", "sqrt(pow((m11 - m22) / 2, 2) + m12 * m12)"


@query("eigvalsh_2x2", f"SELECT pix, {GC(1e9, low=f'{_E2M} - {_E2D}', high=f'{_E2M} + {_E2D}')} FROM {_PIX} AS sums WHERE pix IN (SELECT pix FROM tod)")
def _(t):
    sums = M.pixel_sums(t.tod.join(M.white_weights(t.tod), "det"))
    low, high = A.eigen2(F.col("m11"), F.col("m12"), F.col("m22"))
    return sums.select("pix", *cols(1e9, low=low, high=high))


_Q = "(m00 + m11 + m22) / 3"
_EIG = f"""(SELECT *, qm + 2*p*cos(ph) AS high, qm + 2*p*cos(ph + 2*pi()/3) AS low FROM (SELECT *, acos(greatest(-1, least(1, ((m00-qm)*((m11-qm)*(m22-qm) - m12*m12) - m01*(m01*(m22-qm) - m12*m02) + m02*(m01*m12 - (m11-qm)*m02)) / (p*p*p) / 2))) / 3 AS ph
 FROM (SELECT *, sqrt((pow(m00-qm,2) + pow(m11-qm,2) + pow(m22-qm,2) + 2*(m01*m01 + m02*m02 + m12*m12)) / 6) AS p FROM (SELECT *, {_Q} AS qm FROM {_PIX} AS sums WHERE pix IN (SELECT pix FROM tod)))))"""


@query("eigvalsh_3x3", f"SELECT pix, {GC(1e8, low='low', mid='3*qm - low - high', high='high')} FROM {_EIG} AS e WHERE pix IN (SELECT pix FROM tod)")
def _(t):
    sums = M.pixel_sums(t.tod.join(M.white_weights(t.tod), "det"))
    low, mid, high = A.eigen3(*[F.col(f"m{i}{j}") for i, j in M.PAIRS])
    return sums.select("pix", *cols(1e8, low=low, mid=mid, high=high))


@query("pixel_selection", f"SELECT pix, hits FROM {_EIG} AS e WHERE pix IN (SELECT pix FROM tod) AND hits > 0.9 * (SELECT quantile_cont(hits, 0.95) FROM {_PIX} AS s2 WHERE hits > 0) AND low > 0.01 * high")
def _(t):
    return M.select_pixels(M.pixel_sums(t.tod.join(M.white_weights(t.tod), "det")), hits_cut=0.9).select("pix", "hits")


@query("two_step_offsets", f"SELECT det, {G('avg(r)', 1e4)} AS off FROM (SELECT det, d - avg(d) OVER (PARTITION BY pix) AS r FROM tod) GROUP BY det")
def _(t):
    return M.offsets(t.tod).select("det", g(F.col("offset"), 1e4).alias("off"))


@query("atmosphere_profile_likelihood", f"SELECT {G('-sum(s * s / n)', 1)} AS value FROM (SELECT pix, sum(d) AS s, count(*) AS n FROM tod GROUP BY pix)")
def _(t):
    sums = t.tod.groupBy("pix").agg(F.sum("d").alias("s"), F.count("*").alias("n"))
    return sums.agg(g(-F.sum(F.col("s") * F.col("s") / F.col("n")), 1).alias("value"))


# --- streams over observations, sparse matrices --------------------------------------------------------------------

def _by_obs(x):
    return x.withColumn("v", F.col("v") * (F.col("obs") + 1))


@query("stream_diagonal", f"SELECT event_id, {G('d * (obs + 1)', 1e4)} AS v FROM tod")
def _(t):
    op = R.StreamDiagonal(_by_obs, _by_obs)
    return op(t.tod.select("event_id", "obs", F.col("d").alias("v"))).select("event_id", g(F.col("v"), 1e4).alias("v"))


@query("stream_column", f"SELECT obs, p AS pix, {G('i * (obs + 1)')} AS v FROM {SKY48} CROSS JOIN (SELECT DISTINCT obs FROM tod) ORDER BY obs, pix")
def _(t):
    op = R.StreamColumn(_by_obs, t.tod.select("obs").distinct(), _by_obs)
    return op(sky48(t).select("pix", F.col("i").alias("v"))).select("obs", "pix", g(F.col("v")).alias("v"))


@query("stream_row", f"SELECT pix, {G('sum(d * (obs + 1))', 1e3)} AS v FROM tod GROUP BY pix")
def _(t):
    op = R.StreamRow(lambda x: _by_obs(x).select("obs", "pix", "v"))
    return op(t.tod.select("obs", "pix", F.col("d").alias("v"))).select("pix", g(F.col("v"), 1e3).alias("v"))


@query("stream_addition", f"SELECT pix, {G('sum((obs + 1) * cos(2*psi))')} AS v FROM tod GROUP BY pix")
def _(t):
    return t.tod.groupBy("pix").agg(g(F.sum((F.col("obs") + 1) * F.cos(F.col("psi") * 2))).alias("v"))


@query("sparse_matvec", f"SELECT row_, {G('sum(val * i)', 1e4)} AS v FROM coo JOIN sky ON pix = col_ GROUP BY row_")
def _(t):
    x = t.sky.select(F.col("pix").alias("col"), F.col("i").alias("v"))
    return t.coo.join(x, "col").groupBy(F.col("row").alias("row_")).agg(g(F.sum(F.col("val") * F.col("v")), 1e4).alias("v"))


@query("sparse_matvec_transpose", f"SELECT col_, {G('sum(val * o_totalprice / 1000)', 1e1)} AS v FROM coo JOIN orders ON o_orderkey = row_ GROUP BY col_")
def _(t):
    y = t.read("orders").select(F.col("o_orderkey").alias("row"), (F.col("o_totalprice") / 1000).alias("v"))
    return t.coo.join(y, "row").groupBy(F.col("col").alias("col_")).agg(g(F.sum(F.col("val") * F.col("v")), 1e1).alias("v"))


# --- templates -----------------------------------------------------------------------------------------------------

def series_query(name: str, value, sql: str, scale: float = 1e6):
    """A template over the samples of every detector: expand known amplitudes."""

    @query(name, f"SELECT det, samp, {G(sql, scale)} AS v FROM tod")
    def _(t):
        return t.tod.select("det", "samp", g(value(), scale).alias("v"))


S_ = F.col
series_query("tensor_basis_expand", lambda: S_("samp") * 0.01 * (S_("det") + 1) + F.pow(S_("samp") * 0.01, F.lit(2.0)), "samp * 0.01::DOUBLE * (det + 1) + pow(samp * 0.01::DOUBLE, 2)")
series_query("decimated_basis", lambda: F.floor(S_("samp") / 8) * 0.5 + S_("det"), "floor(samp / 8) * 0.5 + det")
series_query("kronecker_expand", lambda: (S_("samp") % 4 + 1) * 0.25 * F.cos(S_("psi")), "(samp % 4 + 1) * 0.25::DOUBLE * cos(psi)")
series_query("legendre_template", lambda: A.legendre(2, S_("samp") / 50.0 - 1) + A.legendre(3, S_("samp") / 50.0 - 1) * 0.5, "(3 * pow(samp / 50.0 - 1, 2) - 1) / 2 + 0.5 * (5 * pow(samp / 50.0 - 1, 3) - 3 * (samp / 50.0 - 1)) / 2")
series_query("harmonic_template", lambda: F.sin(S_("psi")) + F.sin(S_("psi") * 2) * 2 + F.cos(S_("psi")) * 3 + F.cos(S_("psi") * 2) * 4, "sin(psi) + 2 * sin(psi * 2) + 3 * cos(psi) + 4 * cos(psi * 2)")


def _bspline_sql(u: str) -> str:
    return f"CASE WHEN {u} < 0 OR {u} >= 4 THEN 0 WHEN {u} < 1 THEN pow({u}, 3) / 6 WHEN {u} < 2 THEN (-3*pow({u}, 3) + 12*pow({u}, 2) - 12*{u} + 4) / 6 WHEN {u} < 3 THEN (3*pow({u}, 3) - 24*pow({u}, 2) + 60*{u} - 44) / 6 ELSE pow(4 - {u}, 3) / 6 END"


_U = "(samp / 10.0 - floor(samp / 10.0) + {0})"
series_query("windowed_bspline", lambda: sum((A.bspline(S_("samp") / 10.0 - F.floor(S_("samp") / 10.0) + k) * (k + 1) for k in range(1, 4)), A.bspline(S_("samp") / 10.0 - F.floor(S_("samp") / 10.0))), " + ".join(f"({_bspline_sql(_U.format(k))}) * {k + 1}" for k in range(4)))


@query("tensor_basis_project", f"SELECT det, {GC(1e2, a='sum(d)', b='sum(d * samp * 0.01)', c='sum(d * pow(samp * 0.01, 2))')} FROM tod GROUP BY det")
def _(t):
    x = F.col("samp") * 0.01
    return t.tod.groupBy("det").agg(*cols(1e2, a=F.sum("d"), b=F.sum(F.col("d") * x), c=F.sum(F.col("d") * x * x)))


@query("segmented_project", f"SELECT det, samp // 16 AS seg, {G('sum(d)', 1e4)} AS v FROM tod GROUP BY 1, 2")
def _(t):
    return t.tod.groupBy("det", F.expr("samp div 16").alias("seg")).agg(g(F.sum("d"), 1e4).alias("v"))


@query("bin_weights_hard", f"SELECT det, least(floor((psi % 6.283) / 6.283 * 4), 3)::BIGINT AS bin, {G('sum(d)', 1e3)} AS v FROM tod GROUP BY 1, 2")
def _(t):
    b = F.least(F.floor(F.pmod("psi", F.lit(6.283)) / 6.283 * 4), F.lit(3)).cast("long")
    return t.tod.groupBy("det", b.alias("bin")).agg(g(F.sum("d"), 1e3).alias("v"))


@query("bin_weights_triangular", f"SELECT det, b AS bin, {G('sum(d * greatest(0, 1 - abs((psi % 6.283) / 6.283 * 3 - b)))', 1e3)} AS v FROM tod CROSS JOIN (SELECT unnest(range(0, 4))::BIGINT AS b) GROUP BY 1, 2")
def _(t):
    x = t.tod.crossJoin(F.broadcast(t.spark.range(4).select(F.col("id").alias("bin"))))
    w = F.greatest(F.lit(0.0), 1 - F.abs(F.pmod("psi", F.lit(6.283)) / 6.283 * 3 - F.col("bin")))
    return x.groupBy("det", "bin").agg(g(F.sum(F.col("d") * w), 1e3).alias("v"))


@query("polynomial_template", f"SELECT det, seg, {GC(1e3, a='my - mx * CASE WHEN vx > 0 THEN cxy / vx ELSE 0 END', b='CASE WHEN vx > 0 THEN cxy / vx ELSE 0 END')} FROM (SELECT det, samp // 16 AS seg, avg(d) AS my, avg(samp) AS mx, avg(d * samp) - avg(d) * avg(samp) AS cxy, avg(samp * samp) - avg(samp) * avg(samp) AS vx FROM tod GROUP BY 1, 2) AS z WHERE det IN (SELECT det FROM tod)")
def _(t):
    d, s = F.col("d"), F.col("samp")
    x = t.tod.groupBy("det", F.expr("samp div 16").alias("seg")).agg(F.avg(d).alias("my"), F.avg(s).alias("mx"), (F.avg(d * s) - F.avg(d) * F.avg(s)).alias("cxy"), (F.avg(s * s) - F.avg(s) * F.avg(s)).alias("vx"))
    b = F.when(F.col("vx") > 0, F.col("cxy") / F.when(F.col("vx") > 0, F.col("vx"))).otherwise(0.0)
    return x.select("det", "seg", *cols(1e3, a=F.col("my") - F.col("mx") * b, b=b))


# --- noise and estimators ------------------------------------------------------------------------------------------

@query("white_noise_fit", f"SELECT det, {G('sqrt(avg(d * d) - avg(d) * avg(d))', 1e4)} AS sigma FROM tod WHERE valid GROUP BY det")
def _(t):
    d = F.col("d")
    return t.tod.where("valid").groupBy("det").agg(g(F.sqrt(F.greatest(F.lit(0.0), F.avg(d * d) - F.avg(d) * F.avg(d))), 1e4).alias("sigma"))


@query("noise_loglog_fit", f"SELECT det, {GC(1e4, slope='regr_slope(ln(d), ln(samp + 1))', intercept='regr_intercept(ln(d), ln(samp + 1))')} FROM tod WHERE d > 0 GROUP BY det HAVING count(*) > 2")
def _(t):
    x, y = F.log(F.col("samp") + 1.0), F.log("d")
    out = t.tod.where("d > 0").groupBy("det").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b")).where("n > 2")
    return out.select("det", *cols(1e4, slope=F.col("a"), intercept=F.col("b")))


@query("whittle_likelihood", f"SELECT det, {G('sum(ln(m / (d * d)) + d * d / m)', 1e3)} AS value FROM (SELECT det, d, 2500 * (1 + pow((samp + 1) / 10.0, -1.5)) AS m FROM tod WHERE d > 0) GROUP BY det")
def _(t):
    m = (F.pow((F.col("samp") + 1) / 10.0, F.lit(-1.5)) + 1) * 2500
    p = F.col("d") * F.col("d")
    return t.tod.where("d > 0").groupBy("det").agg(g(F.sum(F.log(m / p) + p / m), 1e3).alias("value"))


_ARCS = "(SELECT c_nationkey AS k, (c_custkey * 0.37::DOUBLE) % 2.0::DOUBLE AS lo, (c_custkey * 0.37::DOUBLE) % 2.0::DOUBLE + 0.05 AS hi FROM customer)"


@query("minimum_enclosing_arc", f"SELECT k, {G('6.283185307179586 - max(gap)')} AS width FROM (SELECT k, coalesce(lead(lo) OVER w, first_value(lo) OVER (PARTITION BY k ORDER BY lo) + 6.283185307179586) - max(hi) OVER (PARTITION BY k ORDER BY lo ROWS UNBOUNDED PRECEDING) AS gap FROM {_ARCS} WINDOW w AS (PARTITION BY k ORDER BY lo)) GROUP BY k")
def _(t):
    lo = F.pmod(F.col("c_custkey") * 0.37, F.lit(2.0))
    arcs = t.read("customer").select(F.col("c_nationkey").alias("k"), lo.alias("lo"), (lo + 0.05).alias("hi"))
    w = Window.partitionBy("k").orderBy("lo")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.coalesce(F.lead("lo").over(w), F.first("lo").over(upto) + 2 * math.pi) - F.max("hi").over(upto)
    return arcs.select("k", gap.alias("gap")).groupBy("k").agg(g(2 * math.pi - F.max("gap")).alias("width"))


@query("lonlat_ranges", f"SELECT {GC(lon_min='greatest(-180, min(degrees(phi)) - 1)', lon_max='least(180, max(degrees(phi)) + 1)', lat_min='greatest(-90, min(90 - degrees(theta)) - 1)', lat_max='least(90, max(90 - degrees(theta)) + 1)')} FROM ang")
def _(t):
    lon, lat = F.degrees("phi"), F.lit(90.0) - F.degrees("theta")
    return t.angles.agg(*cols(lon_min=F.greatest(F.lit(-180.0), F.min(lon) - 1), lon_max=F.least(F.lit(180.0), F.max(lon) + 1), lat_min=F.greatest(F.lit(-90.0), F.min(lat) - 1), lat_max=F.least(F.lit(90.0), F.max(lat) + 1)))


@query("obs_distribution", "SELECT k AS obs, (k // 7)::BIGINT AS process, (k % 7)::BIGINT AS slot FROM (SELECT unnest(range(0, 25))::BIGINT AS k)")
def _(t):
    k = F.col("id")
    return t.spark.range(25).select(k.alias("obs"), F.expr("id div 7").alias("process"), (k % 7).alias("slot"))


@query("uid_hash", "SELECT n_name, (('0x' || right(sha1(n_name), 8))::BIGINT & 2147483647)::BIGINT AS uid FROM nation")
def _(t):
    return t.read("nation").select("n_name", F.conv(F.right(F.sha1(F.col("n_name").cast("binary")), F.lit(8)), 16, 10).cast("long").bitwiseAND(2147483647).alias("uid"))


@query("low_rank_apply", f"SELECT vec_id, {G('sum(v * c / (k + 2))', 1e2)} AS v FROM ({LABEL_SQL}) AS x JOIN (SELECT k AS k2, sum(v * label) AS c FROM ({LABEL_SQL}) AS y GROUP BY 1) AS z ON k = k2 GROUP BY vec_id")
def _(t):
    x = labelled(t)
    c = x.groupBy("k").agg(F.sum(F.col("v") * F.col("label")).alias("c"))
    return x.join(c, "k").groupBy("vec_id").agg(g(F.sum(F.col("v") * F.col("c") / (F.col("k") + 2)), 1e2).alias("v"))


@query("topk_which", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 10")
def _(t):
    return t.read("customer").select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(10)


@query("cg_diagonal", f"SELECT k, {G('v / (k % 5 + 1)', 1e4)} AS v FROM vec")
def _(t):
    from tessera.operators.linear import Diagonal, Inverse

    op = Diagonal(t.vec.select("k", (F.col("k") % 5 + 1.0).alias("d")), ("k",))
    return Inverse(op).apply(t.vec).select("k", g(F.col("v"), 1e4).alias("v"))


@query("covariance_by_label", f"SELECT label, {G('sum(v * v) / count(*) - pow(sum(v) / count(*), 2)')} AS var FROM ({LABEL_SQL}) AS x GROUP BY label")
def _(t):
    v = F.col("v")
    return labelled(t).groupBy("label").agg(g(F.sum(v * v) / F.count("*") - F.pow(F.sum(v) / F.count("*"), F.lit(2.0))).alias("var"))


# --- series kernels: one detector or vector at a time, no SQL --------------------------------------------------------

def per_vector(name: str, kernel):
    """The kernel on every embedding as a series of 64 samples, in Arrow batches."""

    @query(name)
    def _(t):
        def run(batches):
            for b in batches:
                yield pd.DataFrame({"id": b["vec_id"], "v": [np.round(np.asarray(kernel(np.asarray(x, float), int(i)), float), 9).tolist() for i, x in zip(b["vec_id"], b["embedding"], strict=True)]})

        return t.read("embeddings").select("vec_id", "embedding").where("embedding is not null").mapInPandas(run, "id long, v array<double>")


_BANDS = np.array([1.0, 0.4, 0.1])
_GOOD = np.arange(64) % 9 != 4
per_vector("fourier_bandpass", lambda x, i: K.fourier_filter(x, lambda f: K.butterworth_bandpass(f, 0.05, 0.3)))
per_vector("toeplitz_fft", lambda x, i: K.toeplitz(x, _BANDS, "overlap_save"))
per_vector("welch_psd", lambda x, i: K.welch(x, 1.0, 32)[1])
per_vector("gap_fill", lambda x, i: K.gap_fill(x, _GOOD, np.array([1.0, 0.3]), i))
per_vector("nested_weight", lambda x, i: K.nested_weight(x, _GOOD, np.array([1.0, 0.3])))
per_vector("banded_cholesky", lambda x, i: K.banded_solve(K.banded_cholesky(np.stack([np.full(64, 4.0), np.ones(64)])), x))


@query("noise_fit_whittle")
def _(t):
    def run(batches):
        for b in batches:
            found = [[np.nan] * 3] * len(b)
            sizes = b["embedding"].map(len).to_numpy()
            for n in np.unique(sizes[sizes > 0]):  # series of one length side by side
                at = np.flatnonzero(sizes == n)
                fits = np.round(K.fit_noises(*K.welch(np.stack([np.asarray(b["embedding"].iloc[k], float) for k in at]), 1.0, 32)), 9)
                for k, fit in zip(at.tolist(), fits.tolist(), strict=True):
                    found[k] = fit
            yield pd.DataFrame({"id": b["vec_id"], "v": found})

    return t.read("embeddings").select("vec_id", "embedding").where("embedding is not null").mapInPandas(run, "id long, v array<double>")


@query("lanczos")
def _(t):
    from tessera.operators.solvers import lanczos

    rows = labelled(t).groupBy("k", "label").agg(F.avg("v").alias("v")).collect()
    a = np.zeros((64, 10))
    for r in rows:
        a[r.k, r.label % 10] = r.v
    values, _v, residual = lanczos(lambda x: a @ (a.T @ x), np.ones(64), 3, 30)
    return t.spark.createDataFrame([(k, float(v), float(r)) for k, (v, r) in enumerate(zip(values, residual, strict=True))], "k long, value double, residual double")


def _map_rows(t, x):
    return t.spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], "pix long, i double, q double, u double")


@query("ml_map")
def _(t):
    from tessera.operators.linear import Toeplitz

    return _map_rows(t, M.iterative(t.tod, NPIX, Toeplitz((1.0, -0.2, 0.05)).apply).maps)


@query("atop_map")
def _(t):
    from tessera.operators.linear import IntervalProjection

    return _map_rows(t, M.iterative(t.tod, NPIX, IntervalProjection(7).apply).maps)


@query("two_step_map")
def _(t):
    from tessera.operators.solvers import Config

    return M.two_step(t.tod, Config(rtol=1e-7, atol=0.0))[1].select("pix", "hits", "i", "q", "u")


@query("mueller_stack")
def _(t):
    rows = [(float(nu), [float(x) for x in K.mueller_of_stack([(3.047, 3.361, 3.86e-3, a) for a in (0.0, 0.94, 0.0)], nu * 1e9).ravel()]) for nu in range(80, 110, 5)]
    return t.spark.createDataFrame(rows, "nu double, mueller array<double>")


@query("kolmogorov_screen")
def _(t):
    screen = K.kolmogorov_screen(32, 1.0, -11 / 3, 3)
    return t.spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(screen)], "y long, v array<double>")
