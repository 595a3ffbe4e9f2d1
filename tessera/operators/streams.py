"""Operators over a stream of observations: a vector with an `obs` key, one partitioned plan instead of a loop.

Each takes a function of (DataFrame with obs) -> DataFrame with obs, linear and without mixing observations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.linear import Operator

Each = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True, eq=False)
class StreamDiagonal(Operator):
    """Every observation for itself; two in a row become one pass."""

    each: Each
    adjoint: Each | None = None

    def apply(self, x):
        return self.each(x)

    def transpose(self):
        return StreamDiagonal(_need(self.adjoint), self.each)

    def __matmul__(self, other):
        if isinstance(other, StreamDiagonal):
            both = self.adjoint and other.adjoint
            return StreamDiagonal(lambda x: self.each(other.each(x)), (lambda y: other.adjoint(self.adjoint(y))) if both else None)
        if isinstance(other, StreamColumn):
            both = self.adjoint and other.adjoint
            return StreamColumn(lambda x: self.each(other.each(x)), other.observations, (lambda y: other.adjoint(self.adjoint(y))) if both else None)
        return super().__matmul__(other)


@dataclass(frozen=True, eq=False)
class StreamColumn(Operator):
    """One vector to all observations: `observations` (obs) is a short list, broadcast to the vector's rows."""

    each: Each
    observations: DataFrame
    adjoint: Each | None = None

    def apply(self, x):
        return self.each(x.crossJoin(F.broadcast(self.observations)))

    def transpose(self):
        return StreamRow(_need(self.adjoint), self.observations, self.each)


@dataclass(frozen=True, eq=False)
class StreamRow(Operator):
    """Every observation for itself, then the sum over them: one aggregate with partial sums."""

    each: Each
    observations: DataFrame | None = None
    adjoint: Each | None = None

    def apply(self, x):
        y = self.each(x)
        keys = [c for c in y.columns if c not in ("obs", "v")]
        return y.groupBy(*keys).agg(F.sum("v").alias("v"))

    def transpose(self):
        if self.observations is None:
            raise NotImplementedError("the transpose needs the list of observations")
        return StreamColumn(_need(self.adjoint), self.observations, self.each)

    def __matmul__(self, other):
        if isinstance(other, StreamColumn):
            return StreamAddition(lambda x: self.each(other.each(x)), other.observations)
        if isinstance(other, StreamDiagonal):
            both = self.adjoint and other.adjoint
            return StreamRow(lambda x: self.each(other.each(x)), self.observations, (lambda y: other.adjoint(self.adjoint(y))) if both else None)
        return super().__matmul__(other)


@dataclass(frozen=True, eq=False)
class StreamAddition(Operator):
    """The sum over observations of what each makes of the same vector, as normal equations are."""

    each: Each
    observations: DataFrame

    def apply(self, x):
        y = self.each(x.crossJoin(F.broadcast(self.observations)))
        keys = [c for c in y.columns if c not in ("obs", "v")]
        return y.groupBy(*keys).agg(F.sum("v").alias("v"))


def _need(f):
    if f is None:
        raise NotImplementedError("no transpose was given for each observation")
    return f
