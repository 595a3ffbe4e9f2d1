"""Trees of vectors: a vector with a `leaf` key. Arithmetic, constructors, and matrices whose entries are numbers by leaf."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.linear import Operator, StructureError


def full_like(x: DataFrame, value: float) -> DataFrame:
    return x.withColumn("v", F.lit(float(value)))


def zeros_like(x: DataFrame) -> DataFrame:
    return full_like(x, 0)


def ones_like(x: DataFrame) -> DataFrame:
    return full_like(x, 1)


def normal_like(x: DataFrame, seed: int, keys: tuple[str, ...] = ("leaf", "k")) -> DataFrame:
    """Standard normal numbers that depend on the seed and a row's keys alone, so a lost task draws the same ones again."""
    return x.withColumn("v", F.sqrt(F.log(_uniform(seed, keys)) * -2) * F.cos(_uniform(seed + 1, keys) * (2 * np.pi)))


def uniform_like(x: DataFrame, seed: int, low: float = 0.0, high: float = 1.0, keys: tuple[str, ...] = ("leaf", "k")) -> DataFrame:
    return x.withColumn("v", _uniform(seed, keys) * (high - low) + low)


def _uniform(seed: int, keys: tuple[str, ...]) -> Column:
    """In (0, 1), never an end."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)


def fold_key(seed: int, *names: Column) -> Column:
    """A number of 31 bits for each observation, telescope, detector: the same everywhere and for ever."""
    text = F.concat_ws("/", F.lit(str(seed)), *[c.cast("string") for c in names])
    return F.conv(F.right(F.sha1(text.cast("binary")), F.lit(8)), 16, 10).cast("long").bitwiseAND(2147483647)


_BY = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "truediv": lambda a, b: a / b, "power": lambda a, b: F.pow(a, b)}


def combine(how: str | Callable, x: DataFrame, y: DataFrame | float, strict: bool = True) -> DataFrame:
    """x and y number by number. y may be a scalar, or a tree with fewer keys (a prefix: one number for each leaf).

    With `strict`, every row of either must have a partner, else StructureError (counted in one job, before any result).
    """
    f = _BY[how] if isinstance(how, str) else how
    if not isinstance(y, DataFrame):
        return x.withColumn("v", f(F.col("v"), F.lit(float(y))))
    keys = [c for c in x.columns if c != "v"]
    on = [c for c in y.columns if c != "v"]
    if not set(on) <= set(keys):
        raise StructureError(f"{on} is no prefix of {keys}")
    other = y.withColumnRenamed("v", "__w")
    if strict:
        left = x.select(*on).distinct().withColumn("__l", F.lit(True))
        right = other.select(*on).distinct().withColumn("__r", F.lit(True))
        if left.join(right, on, "full_outer").where("__l is null or __r is null").take(1):
            raise StructureError("the trees do not have the same keys")
    return x.join(other, on).withColumn("v", f(F.col("v"), F.col("__w"))).select(*x.columns)


def dot(x: DataFrame, y: DataFrame) -> Column:
    return combine("mul", x, y, strict=False).agg(F.sum("v").alias("v"))


@dataclass(frozen=True, eq=False)
class TreeOperator(Operator):
    """out[row] = sum of entries[row][col] * in[col] for the leaves named; the inverse is the pseudo-inverse of the matrix."""

    entries: dict[str, dict[str, float]]

    def _matrix(self) -> tuple[list[str], list[str], np.ndarray]:
        rows, columns = list(self.entries), sorted({c for r in self.entries.values() for c in r})
        return rows, columns, np.array([[self.entries[r].get(c, 0.0) for c in columns] for r in rows])

    def as_matrix(self) -> np.ndarray:
        return self._matrix()[2]

    def apply(self, x):
        keys = [c for c in x.columns if c not in ("leaf", "v")]
        columns = {c for r in self.entries.values() for c in r}
        parts = [F.struct(F.lit(r).alias("leaf"), sum((F.when(F.col("leaf") == c, w).otherwise(0.0) for c, w in by.items()), F.lit(0.0)).alias("w")) for r, by in self.entries.items()]
        rows = x.where(F.col("leaf").isin(*columns)).select(*keys, "v", F.explode(F.array(*parts)).alias("__p"))
        return rows.groupBy(*keys, F.col("__p.leaf").alias("leaf")).agg(F.sum(F.col("v") * F.col("__p.w")).alias("v"))

    def transpose(self):
        rows, columns, m = self._matrix()
        return TreeOperator({c: {r: float(m[i, j]) for i, r in enumerate(rows)} for j, c in enumerate(columns)})

    def inverse(self):
        rows, columns, m = self._matrix()
        p = np.linalg.pinv(m)
        return TreeOperator({c: {r: float(p[j, i]) for i, r in enumerate(rows)} for j, c in enumerate(columns)})


# --- axes ----------------------------------------------------------------------------------------------------------

@dataclass(frozen=True, eq=False)
class MoveAxis(Operator):
    """The same numbers under other key names: names maps each old key to its new one."""

    names: tuple[tuple[str, str], ...]

    def apply(self, x):
        return x.select(*[F.col(a).alias(b) for a, b in self.names], "v")

    def transpose(self):
        return MoveAxis(tuple((b, a) for a, b in self.names))

    inverse = transpose


@dataclass(frozen=True, eq=False)
class Ravel(Operator):
    """Two keys as one, the second (of `size` values) counting fastest."""

    first: str
    second: str
    size: int
    out: str = "k"

    def apply(self, x):
        rest = [c for c in x.columns if c not in (self.first, self.second, "v")]
        return x.select(*rest, (F.col(self.first) * self.size + F.col(self.second)).alias(self.out), "v")

    def transpose(self):
        return Reshape(self.out, self.first, self.second, self.size)

    inverse = transpose


@dataclass(frozen=True, eq=False)
class Reshape(Operator):
    """One key as two, the second of `size` values; Ravel turned round."""

    key: str
    first: str
    second: str
    size: int

    def apply(self, x):
        rest = [c for c in x.columns if c not in (self.key, "v")]
        k = F.col(self.key)
        return x.select(*rest, F.floor(k / self.size).cast("long").alias(self.first), F.pmod(k, F.lit(self.size)).alias(self.second), "v")

    def transpose(self):
        return Ravel(self.first, self.second, self.size, self.key)

    inverse = transpose


@dataclass(frozen=True, eq=False)
class Weight(Operator):
    """M W M: the mask, the weight, the mask again; once only where the weight is diagonal."""

    weight: Operator
    mask: Operator

    def apply(self, x):
        from tessera.operators.linear import Tag

        y = self.weight.apply(self.mask.apply(x))
        return y if Tag.DIAGONAL in self.weight.tags else self.mask.apply(y)

    def transpose(self):
        return Weight(self.weight.T, self.mask)
