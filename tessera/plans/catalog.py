"""Registered queries of the linear-inverse engine over the driver's tables, each with SQL for DuckDB.

Doubles are put on a grid (floor(x * S + 0.5) / S) in both engines, so that summation order does not show.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import angles as A
from tessera.operators import linear as L
from tessera.operators import trees as T
from tessera.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The domain tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return S.read(self.spark, self.dir, name)

    @cached_property
    def tod(self) -> DataFrame:
        return S.tod(self.spark, self.dir)

    @cached_property
    def sky(self) -> DataFrame:
        return S.sky(self.spark, self.dir)

    @cached_property
    def coo(self) -> DataFrame:
        return S.coo(self.spark, self.dir)

    @cached_property
    def series(self) -> DataFrame:
        return S.series(self.spark, self.dir)

    @cached_property
    def vec(self) -> DataFrame:
        return self.read("events").select(F.col("event_id").alias("k"), F.col("value").alias("v"))

    @cached_property
    def samples(self) -> DataFrame:
        return self.tod.select("det", "samp", F.col("d").alias("v"))

    @cached_property
    def angles(self) -> DataFrame:
        """Directions of synthetic pointing, one for each event: theta, phi, psi."""
        k = F.col("event_id").cast("double")
        z = F.pmod(k * 0.6180339887, F.lit(1.0)) * 1.98 - 0.99
        return self.read("events").select("event_id", z.alias("z"), F.acos(z).alias("theta"), (F.pmod(k * 0.7548776662, F.lit(1.0)) * (2 * A.PI) - A.PI).alias("phi"), F.pmod(k * 0.13, F.lit(3.0)).alias("psi"), F.col("value").alias("d"))


VEC = "vec AS (SELECT event_id AS k, value AS v FROM events)"
ANGLES = "ang AS (SELECT event_id, z, acos(z) AS theta, ((event_id * 0.7548776662::DOUBLE) % 1.0::DOUBLE) * 2 * pi() - pi() AS phi, (event_id * 0.13::DOUBLE) % 3.0::DOUBLE AS psi, value AS d FROM (SELECT *, ((event_id * 0.6180339887::DOUBLE) % 1.0::DOUBLE) * 1.98::DOUBLE - 0.99::DOUBLE AS z FROM events))"


def g(x, scale: float = 1e6):
    return A.grid(x, scale)


def G(x: str, scale: float = 1e6) -> str:  # noqa: N802
    return f"(floor(({x}) * {scale!r}::DOUBLE + 0.5) / {scale!r}::DOUBLE)"


def cols(scale: float = 1e6, **exprs) -> list:
    return [g(x, scale).alias(n) for n, x in exprs.items()]


def GC(scale: float = 1e6, **exprs: str) -> str:  # noqa: N802
    return ", ".join(f"{G(x, scale)} AS {n}" for n, x in exprs.items())


def query(name: str, sql: str = ""):
    """Register a function of Tables; `sql` may use the common tables by name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            named = {**S.SQL, "vec": VEC, "ang": ANGLES}
            ctes = [text for key, text in named.items() if key in sql.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split()]
            SQL[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def vq(name: str, op, value: str, source: str = "vec", where: str = ""):
    """A query that applies an operator to the plain vector; `value` is SQL for v."""
    query(name, f"SELECT k, {G(value, 1e4)} AS v FROM {source} {where}")(lambda t: op(t)(t.vec).select("k", g(F.col("v"), 1e4).alias("v")))


def small(t: Tables, scale: float = 1.0) -> DataFrame:
    """A diagonal over k, with zeros in it."""
    return t.read("events").select(F.col("event_id").alias("k"), ((F.col("user_id") % 5) * scale).cast("double").alias("d"))


# --- projections and predicates ------------------------------------------------------------------------------------

vq("identity", lambda t: L.Identity(), "v")
vq("homothety", lambda t: L.Homothety(2.5), "v * 2.5")
vq("homothety_inverse", lambda t: L.Homothety(4.0).I, "v / 4.0")
vq("composition", lambda t: 2.0 * (L.Mask("k % 3 = 0") @ L.Homothety(0.5)), "CASE WHEN k % 3 = 0 THEN v ELSE 0 END")
vq("addition", lambda t: L.Mask("k % 2 = 0") + L.Homothety(3.0) + L.Identity(), "CASE WHEN k % 2 = 0 THEN v ELSE 0 END + 4 * v")
vq("mask_zero", lambda t: L.Mask("v > 100"), "CASE WHEN v > 100 THEN v ELSE 0 END")
vq("mask_fusion", lambda t: L.Mask("v > 100") @ L.Mask("k % 2 = 0"), "CASE WHEN v > 100 AND k % 2 = 0 THEN v ELSE 0 END")
vq("mask_complement", lambda t: L.Mask("v > 100").complement(), "CASE WHEN NOT v > 100 THEN v ELSE 0 END")
vq("mask_restrict", lambda t: L.Mask("v > 100").restrict("k % 7 <> 0"), "CASE WHEN v > 100 AND k % 7 <> 0 THEN v ELSE 0 END")
vq("pack", lambda t: L.Pack("k % 4 = 1"), "v", where="WHERE k % 4 = 1")
vq("unpack", lambda t: (p := L.Pack("k % 4 = 1", t.vec.select("k"))).T @ p, "CASE WHEN k % 4 = 1 THEN v ELSE 0 END")
vq("index_slice", lambda t: L.Pack("k >= 10 AND k < 500"), "v", where="WHERE k >= 10 AND k < 500")
vq("diagonal", lambda t: L.Diagonal(small(t), ("k",)), "v * (user_id % 5)", "(SELECT event_id AS k, value AS v, user_id FROM events)")
vq("diagonal_inverse_zero", lambda t: L.Diagonal(small(t), ("k",)).I, "CASE WHEN user_id % 5 <> 0 THEN v / (user_id % 5) ELSE 0 END", "(SELECT event_id AS k, value AS v, user_id FROM events)")


@query("broadcast_diagonal_left", f"SELECT f, k, {G('v * (f + 1)', 1e4)} AS v FROM vec CROSS JOIN (SELECT unnest([0, 1, 2])::INTEGER AS f)")
def _(t):
    axis = t.spark.range(3).select(F.col("id").cast("int").alias("f"))
    return t.vec.crossJoin(F.broadcast(axis)).select("f", "k", g(F.col("v") * (F.col("f") + 1), 1e4).alias("v"))


@query("broadcast_diagonal_right", f"SELECT id, k, {G('v * (k + 0.5)')} AS v FROM series")
def _(t):
    d = t.spark.range(64).select(F.col("id").alias("k"), (F.col("id") + 0.5).alias("d"))
    return L.Diagonal(F.broadcast(d), ("k",))(t.series).select("id", "k", g(F.col("v")).alias("v"))


@query("move_axis", f"SELECT k AS axis0, id AS axis1, {G('v')} AS v FROM series")
def _(t):
    return T.MoveAxis((("k", "axis0"), ("id", "axis1")))(t.series).withColumn("v", g(F.col("v")))


@query("ravel", f"SELECT id * 64 + k AS k, {G('v')} AS v FROM series")
def _(t):
    return T.Ravel("id", "k", 64)(t.series).withColumn("v", g(F.col("v")))


@query("reshape", f"SELECT id, k // 8 AS a, k % 8 AS b, {G('v')} AS v FROM series")
def _(t):
    return T.Reshape("k", "a", "b", 8)(t.series).withColumn("v", g(F.col("v")))


@query("stokes_arith", f"SELECT pix, {GC(i='i * 2 - 1', q='q + u', u='abs(u)', v='-v')} FROM sky")
def _(t):
    i, q, u, v = map(F.col, "iquv")
    return t.sky.select("pix", *cols(i=i * 2 - 1, q=q + u, u=F.abs(u), v=-v))


@query("stokes_dot", f"SELECT {G('sum(i*i + q*q + u*u + v*v)', 1e3)} AS dot FROM sky")
def _(t):
    return t.sky.agg(g(F.sum(sum((F.col(c) * F.col(c) for c in "quv"), F.col("i") * F.col("i"))), 1e3).alias("dot"))


ROT = "pix * 0.01::DOUBLE"


@query("qu_rotation", f"SELECT pix, {GC(i='i', q=f'q*cos(2*{ROT}) + u*sin(2*{ROT})', u=f'u*cos(2*{ROT}) - q*sin(2*{ROT})')} FROM sky")
def _(t):
    return (L.Rotation("pix * 0.005D") @ L.Rotation("pix * 0.005D"))(t.sky).select("pix", *cols(i=F.col("i"), q=F.col("q"), u=F.col("u")))


@query("qu_rotation_transpose", f"SELECT pix, {GC(q=f'q*cos(2*{ROT}) - u*sin(2*{ROT})', u=f'u*cos(2*{ROT}) + q*sin(2*{ROT})')} FROM sky")
def _(t):
    return L.Rotation("pix * 0.01D").T(t.sky).select("pix", *cols(q=F.col("q"), u=F.col("u")))


@query("hwp", f"SELECT pix, {GC(i='i', q='q', u='-u', v='-v')} FROM sky")
def _(t):
    return L.HalfWavePlate()(t.sky).select("pix", *cols(i=F.col("i"), q=F.col("q"), u=F.col("u"), v=F.col("v")))


@query("rotating_hwp", f"SELECT pix, {GC(q=f'q*cos(4*{ROT}) + u*sin(4*{ROT})', u=f'q*sin(4*{ROT}) - u*cos(4*{ROT})', v='-v')} FROM sky")
def _(t):
    q, u, v = A.rotating_hwp(F.col("q"), F.col("u"), F.col("v"), F.col("pix") * 0.01)
    return t.sky.select("pix", *cols(q=q, u=u, v=v))


MUELLER = ((0.98, 0.01, 0.0), (0.02, 0.97, 0.005), (0.0, 0.004, -0.96))


@query("nonideal_hwp", f"SELECT pix, {GC(**{n: f'{r[0]}*i + {r[1]}*q + {r[2]}*u' for n, r in zip('iqu', MUELLER)}, v='v')} FROM sky")
def _(t):
    out = {n: F.col("i") * r[0] + F.col("q") * r[1] + F.col("u") * r[2] for n, r in zip("iqu", MUELLER, strict=True)}
    return t.sky.select("pix", *cols(**out, v=F.col("v")))


@query("polarizer", f"SELECT pix, {G('(i + q) / 2')} AS d FROM sky")
def _(t):
    return (L.Polarizer() @ L.HalfWavePlate())(t.sky).select("pix", g(F.col("d")).alias("d"))


@query("hwp_modulation", f"SELECT pix, {G(f'i + cos(4*{ROT})*q + sin(4*{ROT})*u')} AS d FROM sky")
def _(t):
    return t.sky.select("pix", g(A.modulation(F.col("i"), F.col("q"), F.col("u"), F.col("pix") * 0.01)).alias("d"))


@query("airmass_modulation", f"SELECT event_id, {G('d / sin(0.3 + abs(z))')} AS d FROM ang")
def _(t):
    return t.angles.select("event_id", g(F.col("d") / F.sin(F.abs("z") + 0.3)).alias("d"))


# --- axes, sums, blocks --------------------------------------------------------------------------------------------

@query("sum_axis0", f"SELECT k, {G('sum(v)')} AS v FROM series GROUP BY k")
def _(t):
    return L.Sum(("k",))(t.series).select("k", g(F.col("v")).alias("v"))


@query("sum_axis1", f"SELECT id, {G('sum(v)')} AS v FROM series GROUP BY id")
def _(t):
    return L.Sum(("id",))(t.series).select("id", g(F.col("v")).alias("v"))


@query("sum_all", f"SELECT {G('sum(v)', 1e4)} AS v FROM series")
def _(t):
    return L.Sum(())(t.series).select(g(F.col("v"), 1e4).alias("v"))


def gather_of(t) -> L.Gather:
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pix"))
    return L.Gather(lines, ("l_orderkey", "l_linenumber"))


def intensity(t) -> DataFrame:
    return t.sky.select("pix", F.col("i").alias("v"))


@query("index_gather", f"SELECT l_orderkey, l_linenumber, {G('i')} AS v FROM lineitem JOIN sky ON pix = l_partkey")
def _(t):
    return gather_of(t)(intensity(t)).select("l_orderkey", "l_linenumber", g(F.col("v")).alias("v"))


@query("index_scatter_add", f"SELECT l_partkey AS pix, {G('sum(l_quantity)', 1e3)} AS v FROM lineitem GROUP BY 1")
def _(t):
    # the transpose of a gather on the rows' own key: the join on that key is the identity and is left out
    return t.read("lineitem").groupBy(F.col("l_partkey").alias("pix")).agg(g(F.sum("l_quantity"), 1e3).alias("v"))


@query("index_coverage", f"SELECT pix, {G('count(*) * any_value(i)')} AS v FROM lineitem JOIN sky ON pix = l_partkey GROUP BY pix")
def _(t):
    gather = gather_of(t)
    return (gather.T @ gather)(intensity(t)).select("pix", g(F.col("v")).alias("v"))


def leaves(t) -> DataFrame:
    return t.read("customer").select(F.when(F.col("c_nationkey") % 2 == 0, "a").otherwise("b").alias("leaf"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


LEAVES = "(SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS leaf, c_custkey AS k, c_acctbal AS v FROM customer)"


@query("block_diagonal", f"SELECT leaf, k, {G('CASE WHEN leaf = chr(97) THEN 2 * v ELSE -v END', 1e4)} AS v FROM {LEAVES}")
def _(t):
    op = L.BlockDiagonal({"a": L.Homothety(2.0), "b": -L.Identity()})
    return op(leaves(t)).select("leaf", "k", g(F.col("v"), 1e4).alias("v"))


@query("block_row", f"SELECT m, {G('sum(CASE WHEN leaf = chr(97) THEN v ELSE 3 * v END)', 1e3)} AS v FROM (SELECT leaf, k % 100 AS m, v FROM {LEAVES}) GROUP BY m")
def _(t):
    x = leaves(t).groupBy("leaf", (F.col("k") % 100).alias("m")).agg(F.sum("v").alias("v"))
    return L.BlockRow({"a": L.Identity(), "b": L.Homothety(3.0)})(x).select("m", g(F.col("v"), 1e3).alias("v"))


@query("block_column", f"SELECT k, l.leaf AS leaf, {G('v * l.f', 1e4)} AS v FROM vec CROSS JOIN (VALUES ('a', 1.0::DOUBLE), ('b', 0.5::DOUBLE)) AS l(leaf, f)")
def _(t):
    return L.BlockColumn({"a": L.Identity(), "b": L.Homothety(0.5)})(t.vec).select("k", "leaf", g(F.col("v"), 1e4).alias("v"))


vq("block_row_column_sum", lambda t: L.BlockRow({"a": L.Homothety(2.0), "b": L.Mask("v > 50")}) @ L.BlockColumn({"a": L.Identity(), "b": L.Homothety(1.0)}), "2 * v + CASE WHEN v > 50 THEN v ELSE 0 END")


def dense(t, swap: bool = False) -> L.Matrix:
    n = t.spark.range(64).select((F.col("id") % 8).alias("row"), F.expr("id div 8").alias("col"))
    a = n.withColumn("val", F.cos(F.col("row") * 1.0 + F.col("col") * 2.0))
    return L.Matrix(F.broadcast(a))


for _name, _r, _c in (("dense_block_diagonal", "r", "c"), ("dense_block_diagonal_transpose", "c", "r")):

    @query(_name, f"SELECT id, (k // 8) * 8 + {_r} AS k, {G('sum(cos(r * 1.0 + c * 2.0) * v)')} AS v FROM series JOIN (SELECT r, c FROM range(8) a(r), range(8) b(c)) ON k % 8 = {_c} GROUP BY 1, 2")
    def _(t, flip=_r == "c"):
        op = L.Matrix(dense(t).table, *(("col", "row") if flip else ("row", "col")))
        x = t.series.select("id", F.expr("k div 8").alias("block"), (F.col("k") % 8).alias(op.col), "v")
        out = op.table.join(x, op.col).groupBy("id", (F.col("block") * 8 + F.col(op.row)).alias("k")).agg(F.sum(F.col("val") * F.col("v")).alias("v"))
        return out.select("id", "k", g(F.col("v")).alias("v"))


@query("tree_dot", f"SELECT {G('sum(c_acctbal * c_custkey)', 1)} AS dot FROM customer")
def _(t):
    return t.read("customer").agg(g(F.sum(F.col("c_acctbal") * F.col("c_custkey")), 1).alias("dot"))


@query("tree_norm", f"SELECT {G('sqrt(sum(v * v))', 1e3)} AS norm FROM {LEAVES}")
def _(t):
    return leaves(t).agg(g(F.sqrt(F.sum(F.col("v") * F.col("v"))), 1e3).alias("norm"))


LABELS = "SELECT label, vec_id, unnest(range(0, len(embedding)))::BIGINT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings"


def labelled(t) -> DataFrame:
    return t.read("embeddings").select("label", "vec_id", F.posexplode("embedding").alias("k", "x")).select("label", "vec_id", F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("v"))


@query("tree_matvec", f"SELECT vec_id, {G('sum(v / (k + 1))')} AS v FROM ({LABELS}) GROUP BY vec_id")
def _(t):
    return labelled(t).groupBy("vec_id").agg(g(F.sum(F.col("v") / (F.col("k") + 1))).alias("v"))


@query("tree_vecmat", f"SELECT k, {G('sum(v * (vec_id % 7))')} AS v FROM ({LABELS}) GROUP BY k")
def _(t):
    return labelled(t).groupBy("k").agg(g(F.sum(F.col("v") * (F.col("vec_id") % 7))).alias("v"))


@query("tree_matmat", f"SELECT a.k AS i, b.k AS j, {G('sum(a.v * b.v)', 1e5)} AS v FROM ({LABELS}) a JOIN ({LABELS}) b USING (vec_id) GROUP BY 1, 2")
def _(t):
    e = t.read("embeddings").select("embedding", F.posexplode("embedding").alias("i", "a")).select("i", "a", F.posexplode("embedding").alias("j", "b"))
    sums = e.groupBy("i", "j").agg(F.sum(F.col("a").cast("double") * F.col("b").cast("double")).alias("v"))
    return sums.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), g(F.col("v"), 1e5).alias("v"))


# --- series --------------------------------------------------------------------------------------------------------

LAGS = "coalesce(lag(d, {0}) OVER w, 0) + coalesce(lead(d, {0}) OVER w, 0)"


@query("toeplitz_direct", f"SELECT det, samp, {G('d + 0.5 * (' + LAGS.format(1) + ') + 0.25 * (' + LAGS.format(2) + ')', 1e4)} AS v FROM tod WINDOW w AS (PARTITION BY det ORDER BY samp)")
def _(t):
    return L.Toeplitz((1.0, 0.5, 0.25))(t.samples).select("det", "samp", g(F.col("v"), 1e4).alias("v"))


@query("atop_projection", f"SELECT det, samp, {G('CASE WHEN count(*) OVER w = 7 THEN d - avg(d) OVER w ELSE d END', 1e4)} AS v FROM tod WINDOW w AS (PARTITION BY det, samp // 7)")
def _(t):
    return L.IntervalProjection(7)(t.samples).select("det", "samp", g(F.col("v"), 1e4).alias("v"))


@query("sample_mask_intervals", "SELECT det, samp, (bool_and(valid) OVER w AND count(*) OVER w = 7) AS keep FROM tod WINDOW w AS (PARTITION BY det, samp // 7)")
def _(t):
    w = Window.partitionBy("det", F.floor(F.col("samp") / 7))
    return t.tod.select("det", "samp", (F.bool_and("valid").over(w) & (F.count("*").over(w) == 7)).alias("keep"))


@query("elapsed_time", f"SELECT det, samp, {G('t')} AS t FROM tod")
def _(t):
    return t.tod.select("det", "samp", g(F.col("t")).alias("t"))


@query("sample_rate", f"SELECT det, {G('(count(*) - 1) / max(t)', 1e9)} AS rate FROM tod GROUP BY det HAVING max(t) > 0")
def _(t):
    return t.tod.groupBy("det").agg(F.count("*").alias("n"), F.max("t").alias("t")).where("t > 0").select("det", g((F.col("n") - 1) / F.col("t"), 1e9).alias("rate"))


_WRAP = "a - lag(a) OVER (PARTITION BY det ORDER BY samp)"


@query("hwp_frequency_unwrap", f"SELECT det, {G('sum(s - 2 * pi() * floor(s / (2 * pi()) + 0.5)) / count(s)')} AS step FROM (SELECT det, {_WRAP} AS s FROM (SELECT det, samp, (samp * 2.0::DOUBLE) % 6.28::DOUBLE AS a FROM tod)) GROUP BY det HAVING count(s) > 0")
def _(t):
    a = t.tod.select("det", "samp", F.pmod(F.col("samp") * 2.0, F.lit(6.28)).alias("a"))
    s = a.select("det", (F.col("a") - F.lag("a").over(Window.partitionBy("det").orderBy("samp"))).alias("s"))
    turn = F.col("s") - F.floor(F.col("s") / (2 * A.PI) + 0.5) * (2 * A.PI)
    return s.groupBy("det").agg(g(F.sum(turn) / F.count("s")).alias("step"), F.count("s").alias("n")).where("n > 0").select("det", "step")


@query("downsample", f"SELECT det, samp // 4 AS samp, {G('avg(d)', 1e4)} AS v FROM tod GROUP BY 1, 2")
def _(t):
    return t.tod.groupBy("det", F.expr("samp div 4").alias("samp")).agg(g(F.avg("d"), 1e4).alias("v"))


@query("dft_filter_n64", f"SELECT id, f, {GC(1e5, re='sum(v * cos(2 * pi() * f * k / 64))', im='-sum(v * sin(2 * pi() * f * k / 64))')} FROM series CROSS JOIN (SELECT unnest(range(0, 33))::BIGINT AS f) GROUP BY id, f")
def _(t):
    f = t.spark.range(33).select(F.col("id").alias("f"))
    x = t.series.crossJoin(F.broadcast(f)).withColumn("w", F.col("f") * F.col("k") * (2 * A.PI / 64))
    return x.groupBy("id", "f").agg(*cols(1e5, re=F.sum(F.col("v") * F.cos("w")), im=-F.sum(F.col("v") * F.sin("w"))))


@query("frequency_mask", "SELECT k, (k / 64.0 >= 0.05 AND k / 64.0 < 0.4 AND NOT (k / 64.0 >= 0.2 AND k / 64.0 < 0.25)) AS keep FROM (SELECT unnest(range(0, 64))::BIGINT AS k)")
def _(t):
    f = F.col("k") / 64.0
    return t.spark.range(64).select(F.col("id").alias("k")).select("k", ((f >= 0.05) & (f < 0.4) & ~((f >= 0.2) & (f < 0.25))).alias("keep"))


@query("scan_interval_mask", "SELECT det, samp, EXISTS (SELECT 1 FROM (VALUES (5, 20), (30, 45)) AS i(a, b) WHERE samp >= a AND samp < b) AS scan FROM tod")
def _(t):
    spans = t.spark.sql("SELECT * FROM VALUES (5, 20), (30, 45) AS i(a, b)")
    inside = (F.col("samp") >= F.col("a")) & (F.col("samp") < F.col("b"))
    return t.tod.join(F.broadcast(spans), inside, "left").select("det", "samp", F.col("a").isNotNull().alias("scan"))


# --- spectra and components ----------------------------------------------------------------------------------------

NUS = (30.0, 44.0, 70.0, 100.0, 143.0, 217.0)
NU_SQL = f"(SELECT unnest({list(NUS)!r})::DOUBLE AS nu)"
X_SQL = f"(nu * {A.H_OVER_K_GHZ / A.T_CMB!r}::DOUBLE)"
RJ_SQL = f"(pow(exp({X_SQL}) - 1, 2) / (exp({X_SQL}) * {X_SQL} * {X_SQL}))"
DUST_SQL = f"({math.expm1(353.0 * A.H_OVER_K_GHZ / 20.0)!r}::DOUBLE / (exp(nu * {A.H_OVER_K_GHZ / 20.0!r}::DOUBLE) - 1) * pow(nu / 353.0, 2.54))"
SYNC_SQL = "pow(nu / 20.0, -3.0)"


def nus(t) -> DataFrame:
    return t.spark.range(1).select(F.explode(F.array(*map(F.lit, NUS))).alias("nu"))


def sed(name: str, expr, sql: str):
    @query(name, f"SELECT nu, pix, {G(f'i * {sql}', 1e5)} AS v FROM sky CROSS JOIN {NU_SQL}")
    def _(t):
        return t.sky.crossJoin(F.broadcast(nus(t))).select("nu", "pix", g(F.col("i") * expr(F.col("nu")), 1e5).alias("v"))


sed("sed_cmb", lambda nu: F.lit(1.0) / A.rj_to_cmb(nu), f"(1 / {RJ_SQL})")
sed("sed_dust", lambda nu: A.dust(nu, 353.0, 20.0, 1.54), DUST_SQL)
sed("sed_synchrotron", lambda nu: A.synchrotron(nu, 20.0, -3.0), SYNC_SQL)
MIX_SQL = (f"1 / {RJ_SQL}", f"10 * {DUST_SQL}", f"5 * {SYNC_SQL}")


def mixing(nu):
    return F.lit(1.0) / A.rj_to_cmb(nu), A.dust(nu, 353.0, 20.0, 1.54) * 10, A.synchrotron(nu, 20.0, -3.0) * 5


@query("mixing_matrix", f"SELECT nu, pix, {G(f'i * {MIX_SQL[0]} + q * {MIX_SQL[1]} + u * {MIX_SQL[2]}', 1e4)} AS v FROM sky CROSS JOIN {NU_SQL}")
def _(t):
    a, b, c = mixing(F.col("nu"))
    return t.sky.crossJoin(F.broadcast(nus(t))).select("nu", "pix", g(F.col("i") * a + F.col("q") * b + F.col("u") * c, 1e4).alias("v"))


CHANNEL = "CASE l_returnflag || l_linestatus " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in zip(("AF", "AO", "NF", "NO", "RF", "RO"), NUS, strict=True)) + " END"
DATA_SQL = f"(SELECT l_suppkey AS pix, {CHANNEL}::DOUBLE AS nu, avg(l_extendedprice) / 1000 AS d, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2)"


def channels(t) -> DataFrame:
    """(pix, nu, d, w): data of six channels by supplier."""
    nu = F.expr(CHANNEL).cast("double")
    return t.read("lineitem").groupBy(F.col("l_suppkey").alias("pix"), nu.alias("nu")).agg((F.avg("l_extendedprice") / 1000).alias("d"), F.count("*").cast("double").alias("w"))


_M = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
_AB = "(SELECT pix, d, w, " + ", ".join(f"{m} AS a{k}" for k, m in enumerate(MIX_SQL)) + f" FROM {DATA_SQL})"
_NORMAL = "(SELECT pix, " + ", ".join(f"sum(w * a{i} * a{j}) AS m{i}{j}" for i, j in _M) + ", " + ", ".join(f"sum(w * a{i} * d) AS r{i}" for i in range(3)) + f" FROM {_AB} GROUP BY pix)"
DET3 = "(m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02))"
COF = (("(m11*m22 - m12*m12)", "(m02*m12 - m01*m22)", "(m01*m12 - m02*m11)"), ("(m02*m12 - m01*m22)", "(m00*m22 - m02*m02)", "(m01*m02 - m00*m12)"), ("(m01*m12 - m02*m11)", "(m01*m02 - m00*m12)", "(m00*m11 - m01*m01)"))
SOLVE_SQL = [f"CASE WHEN abs({DET3}) > 1e-12 THEN ({r[0]} * r0 + {r[1]} * r1 + {r[2]} * r2) / {DET3} ELSE 0 END" for r in COF]


def normal(x: DataFrame, keys: list[str], a: list, d, w) -> DataFrame:
    """Normal equations of one weighted three-parameter fit for each key: one aggregate."""
    return x.groupBy(*keys).agg(*[F.sum(w * a[i] * a[j]).alias(f"m{i}{j}") for i, j in _M], *[F.sum(w * a[i] * d).alias(f"r{i}") for i in range(3)])


def solved(x: DataFrame):
    return A.solve3([F.col(f"m{i}{j}") for i, j in _M], [F.col(f"r{i}") for i in range(3)])


@query("component_separation", f"SELECT pix, {GC(1e2, cmb=SOLVE_SQL[0], dust=SOLVE_SQL[1], sync=SOLVE_SQL[2])} FROM {_NORMAL}")
def _(t):
    n = normal(channels(t), ["pix"], list(mixing(F.col("nu"))), F.col("d"), F.col("w"))
    _, a, b, c = solved(n)
    return n.select("pix", *cols(1e2, cmb=a, dust=b, sync=c))


@query("spectral_likelihood", f"SELECT {G('sum(' + ' + '.join(f'r{k} * ({s})' for k, s in enumerate(SOLVE_SQL)) + ')', 1)} AS value FROM {_NORMAL}")
def _(t):
    n = normal(channels(t), ["pix"], list(mixing(F.col("nu"))), F.col("d"), F.col("w"))
    _, a, b, c = solved(n)
    return n.agg(g(F.sum(F.col("r0") * a + F.col("r1") * b + F.col("r2") * c), 1).alias("value"))


@query("cmb_variance", f"SELECT {G('var_pop(x)')} AS var FROM (SELECT i AS x FROM sky UNION ALL SELECT q FROM sky UNION ALL SELECT u FROM sky)")
def _(t):
    return t.sky.select(F.explode(F.array("i", "q", "u")).alias("x")).agg(g(F.var_pop("x")).alias("var"))


# --- quaternions and pixels ----------------------------------------------------------------------------------------

def _sq(p, q):
    a, b, c, d = p
    e, f, g_, h = q
    return (f"({a}*{e} - {b}*{f} - {c}*{g_} - {d}*{h})", f"({a}*{f} + {b}*{e} + {c}*{h} - {d}*{g_})", f"({a}*{g_} - {b}*{h} + {c}*{e} + {d}*{f})", f"({a}*{h} + {b}*{g_} - {c}*{f} + {d}*{e})")


_ISO = _sq(_sq(("cos(phi/2)", "0.0", "0.0", "sin(phi/2)"), ("cos(theta/2)", "0.0", "sin(theta/2)", "0.0")), ("cos(psi/2)", "0.0", "0.0", "sin(psi/2)"))


@query("quat_mul", f"SELECT event_id, {GC(a=_ISO[0], b=_ISO[1], c=_ISO[2], d=_ISO[3])} FROM ang")
def _(t):
    q = A.from_iso(F.col("theta"), F.col("phi"), F.col("psi"))
    return t.angles.select("event_id", *cols(**dict(zip("abcd", q, strict=True))))


@query("quat_iso", f"SELECT event_id, {GC(theta='theta', cphi='cos(phi)', sphi='sin(phi)', cpsi='cos(psi)', spsi='sin(psi)')} FROM ang")
def _(t):
    a, b, c = A.iso_angles(A.qnorm(A.from_iso(F.col("theta"), F.col("phi"), F.col("psi"))))
    return t.angles.select("event_id", *cols(theta=a, cphi=F.cos(b), sphi=F.sin(b), cpsi=F.cos(c), spsi=F.sin(c)))


@query("quat_lonlat", f"SELECT event_id, {GC(lat='pi() / 2 - theta', clon='cos(phi)', slon='sin(phi)')} FROM ang")
def _(t):
    a, b, _c = A.iso_angles(A.from_iso(F.col("theta"), F.col("phi"), F.col("psi")))
    return t.angles.select("event_id", *cols(lat=A.PI / 2 - a, clon=F.cos(b), slon=F.sin(b)))


@query("quat_xieta", f"SELECT event_id, {GC(x='sin(theta)*cos(phi)', y='sin(theta)*sin(phi)', z='z')} FROM ang")
def _(t):
    x, y, z = A.z_axis(A.from_iso(F.col("theta"), F.col("phi"), F.col("psi")))
    return t.angles.select("event_id", *cols(x=x, y=y, z=z))


@query("polarization_angle", f"SELECT event_id, {GC(c='cos(psi)', s='sin(psi)')} FROM ang")
def _(t):
    q = A.from_iso(F.col("theta"), F.col("phi"), F.col("psi"))
    x, z = A.x_axis(q), A.z_axis(q)
    r = F.sqrt(z[0] * z[0] + z[1] * z[1])
    south = (z[0] * z[2] / r, z[1] * z[2] / r, -r)
    east = (-z[1] / r, z[0] / r)
    c = x[0] * south[0] + x[1] * south[1] + x[2] * south[2]
    s = x[0] * east[0] + x[1] * east[1]
    return t.angles.select("event_id", *cols(c=F.when(r > 0, c).otherwise(1.0), s=F.when(r > 0, s).otherwise(0.0)))


def ring_sql(n: int) -> str:
    tt = "((phi + 4 * pi()) % (2 * pi())) / (pi() / 2)"
    return f"""(SELECT *, CASE WHEN abs(z) <= 2.0/3 THEN 2*{n}*({n}-1) + (ir-1)*4*{n} + (((cast(floor((jp+jm-{n}+(1-ir%2)+1)/2.0) AS BIGINT)) % (4*{n})) + 4*{n}) % (4*{n})
 WHEN z > 0 THEN 2*jr*(jr-1) + cast(floor(tt*jr) AS BIGINT) % (4*jr) ELSE 12*{n}*{n} - 2*jr*(jr+1) + cast(floor(tt*jr) AS BIGINT) % (4*jr) END AS pix
 FROM (SELECT *, {n}+1+jp-jm AS ir, cast(floor((tt-floor(tt))*w) AS BIGINT) + cast(floor((1-(tt-floor(tt)))*w) AS BIGINT) + 1 AS jr
 FROM (SELECT *, cast(floor({n}*(0.5+tt) - 0.75*{n}*z) AS BIGINT) AS jp, cast(floor({n}*(0.5+tt) + 0.75*{n}*z) AS BIGINT) AS jm, {n}*sqrt(3*(1-abs(z))) AS w
 FROM (SELECT *, {tt} AS tt FROM ang))))"""


@query("healpix_ring_pixel", f"SELECT event_id, pix::BIGINT AS pix FROM {ring_sql(16)} ang16")
def _(t):
    return t.angles.select("event_id", A.ring_pixel(16, F.col("z"), F.col("phi")).alias("pix"))


SQL["healpix_ring_pixel"] = f"WITH {ANGLES} SELECT event_id, pix::BIGINT AS pix FROM {ring_sql(16)}"
_CX = "round_even((((degrees(phi) - 10 + 180) % 360 + 360) % 360 - 180) / -2 + 89.5, 0)"
_CY = "round_even(degrees(pi()/2 - theta) / 2 + 44.5, 0)"


@query("car_pixel", f"SELECT event_id, (CASE WHEN {_CX} >= 0 AND {_CX} < 180 AND {_CY} >= 0 AND {_CY} < 90 THEN {_CY} * 180 + {_CX} ELSE -1 END)::BIGINT AS pix FROM ang")
def _(t):
    return t.angles.select("event_id", A.car_pixel(F.degrees("phi"), F.degrees(A.PI / 2 - F.col("theta")), 10.0, 2.0, 180, 90).alias("pix"))


_HA = "round_even(((phi + 4 * pi()) % (2 * pi())) / (2 * pi() / 60), 0)::BIGINT % 60"
_HH = "round_even((pi()/2 - theta - 0.2) / ((1.4 - 0.2) / 20) - 0.5, 0)::BIGINT"


@query("horizon_pixel", f"SELECT event_id, (CASE WHEN {_HH} >= 0 AND {_HH} < 20 THEN {_HH} + ({_HA}) * 20 ELSE -1 END)::BIGINT AS pix FROM ang")
def _(t):
    return t.angles.select("event_id", A.horizon_pixel(F.col("phi"), A.PI / 2 - F.col("theta"), 60, 20, 0.2, 1.4).alias("pix"))


_TI, _TJ = "round_even(tan(theta)*cos(phi)*1000 / 25 + 31.5, 0)", "round_even(tan(theta)*sin(phi)*1000 / 25 + 31.5, 0)"


@query("tangential_pixel", f"SELECT event_id, (CASE WHEN {_TI} >= 0 AND {_TI} < 64 AND {_TJ} >= 0 AND {_TJ} < 64 THEN {_TJ} * 64 + {_TI} ELSE -1 END)::BIGINT AS pix FROM ang")
def _(t):
    return t.angles.select("event_id", A.tangential_pixel(F.col("theta"), F.col("phi"), 1000.0, 25.0, 64, 64).alias("pix"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tessera.plans import catalog_maps, catalog_more  # noqa: F401  register the other parts

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
