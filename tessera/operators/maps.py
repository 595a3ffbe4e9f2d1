"""Map makers: binned, maximum-likelihood, two-step and interval-projected maps of time-ordered data.

A binned map is one aggregate by pixel and a closed-form 3 x 3 inverse. The iterative makers keep maps (bounded by the
number of pixels) on the driver and run one aggregate of the persisted samples for each step; two-step maps stay tables.
"""

from __future__ import annotations

import warnings
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import angles as A

PAIRS = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def white_weights(tod: DataFrame) -> DataFrame:
    """(det, w): inverse mean square of the valid samples of each detector."""
    s = F.sum(F.when(F.col("valid"), F.col("d") * F.col("d")))
    n = F.sum(F.col("valid").cast("long"))
    return tod.groupBy("det").agg(F.when(s > 0, n / s).otherwise(0.0).alias("w"))


def pixel_sums(tod: DataFrame, keys: tuple[str, ...] = ("pix",)) -> DataFrame:
    """Normal equations of I, Q, U for each pixel from (pix, psi, d, w, valid); partial sums are combined map-side."""
    a = [F.lit(1.0), F.cos(F.col("psi") * 2), F.sin(F.col("psi") * 2)]
    w = F.when(F.col("valid"), F.col("w")).otherwise(0.0)
    return tod.groupBy(*keys).agg(F.sum(F.col("valid").cast("long")).alias("hits"), *[F.sum(w * a[i] * a[j]).alias(f"m{i}{j}") for i, j in PAIRS], *[F.sum(w * a[i] * F.col("d")).alias(f"r{i}") for i in range(3)])


def solve_pixels(sums: DataFrame) -> DataFrame:
    det, i, q, u = A.solve3([F.col(f"m{i}{j}") for i, j in PAIRS], [F.col(f"r{i}") for i in range(3)])
    return sums.select("*", det.alias("det3"), i.alias("i"), q.alias("q"), u.alias("u"))


def binned(tod: DataFrame) -> DataFrame:
    weighted = tod.join(white_weights(tod), "det")
    return solve_pixels(pixel_sums(weighted))


def select_pixels(sums: DataFrame, hits_cut: float = 0.01, cond_cut: float = 0.01) -> DataFrame:
    """Pixels with enough hits (against the 95 % quantile) and a well-conditioned block."""
    low, _, high = A.eigen3(*[F.col(f"m{i}{j}") for i, j in PAIRS])
    bar = sums.where("hits > 0").agg(F.expr("percentile(hits, 0.95)").alias("bar"))
    return sums.crossJoin(F.broadcast(bar)).where((F.col("hits") > F.col("bar") * hits_cut) & (low > high * cond_cut)).drop("bar")


class Solved(NamedTuple):
    """Maps (npix, 3), the residual norm after each step, and whether the last of them met the tolerance."""

    maps: np.ndarray
    history: list[float]
    converged: bool


def iterative(tod: DataFrame, npix: int, weight, steps: int = 1000, rtol: float = 1e-6, throw: bool = False) -> Solved:
    """I, Q, U maps with (P' W P) x = P' W d; `weight` maps (…, v) to weighted v with DataFrame operations.

    The samples are persisted once. Maps go to and from the driver as Arrow columns of npix rows; a step's map is
    broadcast up to FEW pixels and joined by a shuffle beyond. Steps that end before the tolerance warn, or raise.
    """
    from tessera.operators.pointing import FEW
    from tessera.operators.solvers import cg

    spark = tod.sparkSession
    base = tod.withColumns({"c": F.cos(F.col("psi") * 2), "s": F.sin(F.col("psi") * 2)}).persist()

    def columns(table: DataFrame, names: list[str]) -> np.ndarray:
        out, rows = np.zeros((npix, len(names))), table.select("pix", *names).toArrow()
        out[rows["pix"].to_numpy()] = np.column_stack([rows[n].to_numpy() for n in names])
        return out

    def back(x: DataFrame) -> np.ndarray:
        y = weight(x.withColumn("v", F.when(F.col("valid"), F.col("v")).otherwise(0.0)))
        y = y.withColumn("v", F.when(F.col("valid"), F.col("v")).otherwise(0.0))
        return columns(y.groupBy("pix").agg(F.sum("v").alias("a"), F.sum(F.col("v") * F.col("c")).alias("b"), F.sum(F.col("v") * F.col("s")).alias("e")), ["a", "b", "e"])

    def forward(m: np.ndarray) -> DataFrame:
        table = spark.createDataFrame(pa.table({"pix": np.arange(npix), "mi": m[:, 0].copy(), "mq": m[:, 1].copy(), "mu": m[:, 2].copy()}))
        table = F.broadcast(table) if npix <= FEW else table
        return base.join(table, "pix").withColumn("v", F.col("mi") + F.col("c") * F.col("mq") + F.col("s") * F.col("mu")).drop("mi", "mq", "mu")

    try:
        rhs = back(base.withColumn("v", F.col("d")))
        cells = columns(pixel_sums(base.withColumn("w", F.lit(1.0))), [f"m{i}{j}" for i, j in PAIRS])
        blocks = np.zeros((npix, 3, 3))
        for k, (i, j) in enumerate(PAIRS):
            blocks[:, i, j] = blocks[:, j, i] = cells[:, k]
        inverse = np.linalg.pinv(blocks, rcond=1e-6, hermitian=True)
        x, history, _ = cg(lambda m: back(forward(m)), rhs, preconditioner=lambda r: np.einsum("pij,pj->pi", inverse, r), max_steps=steps, rtol=rtol)
    finally:
        base.unpersist()
    converged = not rhs.any() or bool(history and history[-1] <= rtol * np.linalg.norm(rhs))
    if not converged:
        told = f"the map did not converge in {len(history)} steps"
        if throw:
            raise RuntimeError(told)
        warnings.warn(told, RuntimeWarning, stacklevel=2)
    return Solved(x, history, converged)


def less_binned(tod: DataFrame, value: str) -> DataFrame:
    """tod with `value` less its own binned I, Q, U map, sample by sample; invalid samples become zero."""
    d = F.when(F.col("valid"), F.col(value)).otherwise(0.0)
    seen = tod.withColumn("w", F.lit(1.0))
    sky = solve_pixels(pixel_sums(seen.drop("d").withColumn("d", d))).select("pix", "i", "q", "u")
    model = F.col("i") + F.cos(F.col("psi") * 2) * F.col("q") + F.sin(F.col("psi") * 2) * F.col("u")
    return tod.join(sky, "pix").withColumn(value, F.when(F.col("valid"), F.col(value) - model).otherwise(0.0)).drop("i", "q", "u")


def two_step(tod: DataFrame, config=None) -> tuple[DataFrame, DataFrame]:
    """(offsets (det, v), map): offsets a with (F' Z F) a = F' Z d by conjugate gradients, then the binned map of d - F a.

    F repeats the offset of a detector over its samples, Z takes off the binned map. Both stay tables: no vector of
    detectors or pixels comes to the driver. Offsets hold up to a constant, which the sky takes.
    """
    from tessera.operators.linear import Function
    from tessera.operators.solvers import solve

    def projected(x: DataFrame) -> DataFrame:
        return less_binned(x, "v").groupBy("det").agg(F.sum("v").alias("v"))

    base = tod.persist()
    normal = Function(lambda a: projected(base.join(a, "det")))
    amplitudes = solve(normal, projected(base.withColumn("v", F.col("d"))), config)
    clean = base.join(amplitudes, "det").withColumn("d", F.col("d") - F.col("v")).drop("v").withColumn("w", F.lit(1.0))
    return amplitudes, solve_pixels(pixel_sums(clean))


def offsets(tod: DataFrame) -> DataFrame:
    """(det, offset): one constant for each detector from the data less the hit-weighted mean of their pixels."""
    mean = tod.groupBy("pix").agg(F.avg("d").alias("mean"))
    return tod.join(mean, "pix").groupBy("det").agg(F.avg(F.col("d") - F.col("mean")).alias("offset"))
