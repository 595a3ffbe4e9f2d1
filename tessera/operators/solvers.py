"""Krylov solvers. Matrices act through DataFrame plans; scalars of a step come back in one aggregate."""

from __future__ import annotations

import contextlib
import contextvars
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Solver settings of a context: `with Config(rtol=...).use(): op.I(x)`."""

    rtol: float = 1e-6
    atol: float = 1e-6
    max_steps: int = 500
    throw: bool = False
    callback: object = None

    @contextlib.contextmanager
    def use(self):
        token = _CONFIG.set(self)
        try:
            yield self
        finally:
            _CONFIG.reset(token)

    @staticmethod
    def current() -> Config:
        return _CONFIG.get()


_CONFIG: contextvars.ContextVar[Config] = contextvars.ContextVar("tessera-solver", default=Config())


def _dots(x: DataFrame, *pairs: tuple[str, str]) -> list[float]:
    row = x.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]).first()
    return [float(v or 0.0) for v in row]


def solve(op, b: DataFrame, config: Config | None = None) -> DataFrame:
    """x with op x = b by conjugate gradients over distributed vectors.

    Each step is one plan (product, then both dots) and is checkpointed to the shared folder when one is set.
    """
    config = config or Config.current()
    keys = [c for c in b.columns if c != "v"]
    spark = b.sparkSession
    reliable = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    keep = (lambda d: d.checkpoint()) if reliable else (lambda d: d.persist())
    state = keep(b.select(*keys, F.lit(0.0).alias("x"), F.col("v").alias("r"), F.col("v").alias("p")))
    (rr,) = _dots(state, ("r", "r"))
    goal = config.atol + config.rtol * rr**0.5
    for step in range(config.max_steps):
        if rr**0.5 <= goal:
            break
        ap = op.apply(state.select(*keys, F.col("p").alias("v"))).withColumnRenamed("v", "ap")
        both = keep(state.join(ap, keys, "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))))
        (pap,) = _dots(both, ("p", "ap"))
        alpha = rr / pap if pap else 0.0
        moved = both.withColumns({"x": F.col("x") + F.col("p") * alpha, "r": F.col("r") - F.col("ap") * alpha})
        (new,) = _dots(moved, ("r", "r"))
        state = keep(moved.select(*keys, "x", "r", (F.col("r") + F.col("p") * (new / rr)).alias("p")))
        rr = new
        if config.callback:
            config.callback(step, rr**0.5)
    else:
        if config.throw:
            raise RuntimeError("conjugate gradients did not converge")
    return state.select(*keys, F.col("x").alias("v"))


def cg(a, b: np.ndarray, x0=None, preconditioner=None, max_steps: int = 500, atol: float = 0.0, rtol: float = 1e-5, stabilise_every: int = 10, callback=None):
    """(solution, residual norms, steps) for a function a(x) on vectors that fit the driver (maps, amplitudes)."""
    x = np.zeros_like(b, dtype=float) if x0 is None else np.array(x0, float)
    m = preconditioner or (lambda r: r)
    r = b - a(x)
    z = m(r)
    p, rz = z.copy(), float(r.ravel() @ z.ravel())
    floor = (100 * np.finfo(float).eps) ** 2 * abs(rz)
    goal, history = atol + rtol * np.linalg.norm(b), []
    step = 0
    while step < max_steps and (np.linalg.norm(r) > goal or goal == 0) and abs(rz) > floor:
        ap = a(p)
        curvature = float(p.ravel() @ ap.ravel())
        alpha = rz / curvature if curvature else 0.0
        x = x + alpha * p
        step += 1
        r = b - a(x) if step % stabilise_every == 0 else r - alpha * ap
        z = m(r)
        new = float(r.ravel() @ z.ravel())
        p, rz = z + (new / rz if abs(rz) > floor else 0.0) * p, new
        history.append(float(np.linalg.norm(r)))
        if callback:
            callback(step, history[-1])
    return x, history, step


def lanczos(a, start: np.ndarray, k: int, m: int | None = None, which: str = "LA"):
    """(values, vectors, residuals) of k eigenpairs by Lanczos steps with full re-orthogonalisation."""
    n = len(start)
    m = min(n, m or max(2 * k, 20))
    basis, alpha, beta = [start / np.linalg.norm(start)], [], []
    for j in range(m):
        w = a(basis[j])
        alpha.append(float(basis[j] @ w))
        w = w - alpha[-1] * basis[j] - (beta[-1] * basis[j - 1] if j else 0)
        for q in basis:
            w = w - (q @ w) * q
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] < np.finfo(float).eps * 10 or j == m - 1:
            break
        basis.append(w / beta[-1])
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    values, vectors = np.linalg.eigh(t)
    order = pick(values, k, which)
    full = np.array(basis).T @ vectors[:, order]
    return values[order], full, np.abs(beta[len(alpha) - 1] * vectors[-1, order])


def pick(values: np.ndarray, k: int, which: str) -> np.ndarray:
    """Indices of k values, ascending by value: LM, SM, LA, SA or BE (both ends, the odd one from the high end)."""
    order = np.argsort(values)
    if which == "LA":
        chosen = order[-k:]
    elif which == "SA":
        chosen = order[:k]
    elif which == "BE":
        chosen = np.concatenate([order[: k // 2], order[len(order) - (k - k // 2) :]])
    else:
        by = np.argsort(np.abs(values))
        chosen = by[-k:] if which == "LM" else by[:k]
    return np.array(sorted(chosen, key=lambda i: values[i]))
