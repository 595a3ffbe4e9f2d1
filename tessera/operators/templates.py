"""Regressor bases and templates over the samples of detectors.

A basis is the sparse design row of a sample: an array of (b, x), b being the number of the amplitude and x its weight, as one
JVM expression over the sample's columns. A template applies it for every detector: amplitudes to samples (`apply`: one join on
the detector, no explode) and samples to amplitudes (its transpose: one aggregate with partial sums).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import angles as A
from tessera.operators.linear import Operator

DESIGN = "array<struct<b:bigint,x:double>>"


def _row(b: Column, x: Column) -> Column:
    return F.struct(b.cast("long").alias("b"), x.cast("double").alias("x"))


class Basis:
    """`size` amplitudes and the design row of a sample."""

    size: int

    def design(self) -> Column:
        raise NotImplementedError

    def group(self) -> tuple[Column | None, int]:
        """A number g of the sample, and n: its amplitudes lie in [g * n, g * n + n). No number: they may be any of n."""
        return None, self.size

    def expand(self, amplitudes: Column) -> Column:
        """The sample's value, from a map of amplitudes by number; those missing are zero."""
        return F.aggregate(self.design(), F.lit(0.0), lambda s, c: s + c["x"] * F.coalesce(F.try_element_at(amplitudes, c["b"]), F.lit(0.0)))

    def project(self, samples: DataFrame, by: tuple[str, ...] = (), value: str = "v") -> DataFrame:
        """(by..., b, v): sums of weight times value."""
        rows = samples.select(*by, F.col(value).alias("__v"), F.explode(self.design()).alias("__c"))
        return rows.groupBy(*by, F.col("__c.b").alias("b")).agg(F.sum(F.col("__c.x") * F.col("__v")).alias("v"))


@dataclass(frozen=True, eq=False)
class TensorBasis(Basis):
    """One dense column for each amplitude. A decimated basis takes columns of `block(axis, q)`: values held over q samples."""

    columns: tuple[Column, ...]

    @property
    def size(self) -> int:
        return len(self.columns)

    def design(self) -> Column:
        return F.array(*[_row(F.lit(b), x) for b, x in enumerate(self.columns)])


def block(axis: str, q: int) -> Column:
    """The first sample of the run of q samples that a sample lies in."""
    return F.floor(F.col(axis) / q) * q


@dataclass(frozen=True, eq=False)
class KroneckerBasis(Basis):
    """Products of the factors' columns; the last factor counts fastest."""

    first: Basis
    then: Basis

    @property
    def size(self) -> int:
        return self.first.size * self.then.size

    def group(self) -> tuple[Column | None, int]:
        number, n = self.first.group()
        return number, n * self.then.size

    def design(self) -> Column:
        n = self.then.size
        return F.flatten(F.transform(self.first.design(), lambda p: F.transform(self.then.design(), lambda q: _row(p["b"] * n + q["b"], p["x"] * q["x"]))))


@dataclass(frozen=True, eq=False)
class SegmentedBasis(Basis):
    """Amplitudes of their own for each segment; a sample without a segment (null) has none."""

    segment: Column
    inner: Basis
    segments: int

    @property
    def size(self) -> int:
        return self.segments * self.inner.size

    def group(self) -> tuple[Column | None, int]:
        return F.when((self.segment >= 0) & (self.segment < self.segments), self.segment).cast("long"), self.inner.size

    def design(self) -> Column:
        rows = F.transform(self.inner.design(), lambda c: _row(self.segment * self.inner.size + c["b"], c["x"]))
        return F.when((self.segment >= 0) & (self.segment < self.segments), rows).otherwise(F.array().cast(DESIGN))


@dataclass(frozen=True, eq=False)
class WindowedBasis(Basis):
    """Overlapping blocks: a sample belongs to the blocks offset, offset + 1, ... with the weights given."""

    offset: Column
    weights: tuple[Column, ...]
    inner: Basis
    blocks: int

    @property
    def size(self) -> int:
        return self.blocks * self.inner.size

    def design(self) -> Column:
        def shifted(o: int, w: Column) -> Column:
            return F.transform(self.inner.design(), lambda c: _row((self.offset + o) * self.inner.size + c["b"], c["x"] * w))

        parts = [shifted(o, w) for o, w in enumerate(self.weights)]
        return F.filter(F.concat(*parts), lambda c: (c["x"] != 0) & (c["b"] >= 0) & (c["b"] < self.size))


@dataclass(frozen=True, eq=False)
class MaskedBasis(Basis):
    """No amplitude where the condition does not hold (as off the scans)."""

    condition: Column
    inner: Basis

    @property
    def size(self) -> int:
        return self.inner.size

    def group(self) -> tuple[Column | None, int]:
        return self.inner.group()

    def design(self) -> Column:
        return F.when(self.condition, self.inner.design()).otherwise(F.array().cast(DESIGN))


@dataclass(frozen=True, eq=False)
class Template(Operator):
    """A basis for every group of `by`: amplitudes (by..., b, v) to samples (their columns and v)."""

    basis: Basis
    samples: DataFrame
    by: tuple[str, ...] = ("det",)

    def apply(self, x):
        number, n = self.basis.group()
        by, samples, part = list(self.by), self.samples.drop("v"), []
        if number is not None:  # a sample meets the amplitudes of its own segment only
            by, samples, part = [*by, "__g"], samples.withColumn("__g", number), [F.floor(F.col("b") / n).cast("long").alias("__g")]
        packed = x.groupBy(*self.by, *part).agg(F.map_from_entries(F.collect_list(F.struct(F.col("b").cast("long"), "v"))).alias("__a"))
        # at most one row for each detector and segment, of no more than n numbers
        return samples.join(packed, by, "left").withColumn("v", F.coalesce(self.basis.expand(F.col("__a")), F.lit(0.0))).drop("__a", "__g")

    def reached(self) -> DataFrame:
        """(by..., b): all amplitudes of the segments that samples lie in; those of other segments change no sample."""
        number, n = self.basis.group()
        inner = F.broadcast(self.samples.sparkSession.range(n).withColumnRenamed("id", "b"))
        if number is None:
            return self.samples.select(*self.by).distinct().crossJoin(inner)
        return self.samples.select(*self.by, number.alias("__g")).where("__g IS NOT NULL").distinct().crossJoin(inner).select(*self.by, (F.col("__g") * n + F.col("b")).alias("b"))

    def transpose(self):
        return TemplateTranspose(self)


@dataclass(frozen=True, eq=False)
class TemplateTranspose(Operator):
    """Samples (with the columns that the basis reads, and v) to amplitudes."""

    template: Template

    def apply(self, x):
        return self.template.basis.project(x, self.template.by)

    def transpose(self):
        return self.template


# --- factories -----------------------------------------------------------------------------------------------------

def rescaled(x: Column, low: float, high: float) -> Column:
    """x on [-1, 1]."""
    return (x - low) * (2.0 / (high - low)) - 1


def legendre_basis(x: Column, lmin: int, lmax: int) -> TensorBasis:
    return TensorBasis(tuple(A.legendre(k, x) for k in range(lmin, lmax + 1)))


def harmonic_basis(angle: Column, n: int, constant: bool = False) -> TensorBasis:
    """The constant first if asked for, then all sines, then all cosines."""
    waves = [f(angle * k) for f in (F.sin, F.cos) for k in range(1, n + 1)]
    return TensorBasis(tuple([F.lit(1.0)] * constant + waves))


def bin_basis(x: Column, low: float, high: float, n: int, interpolate: bool = False, smooth: bool = False) -> Basis:
    """One bin for each sample; or hats around the bin centres, the outer ones flat towards the edges; or squared sines."""
    if not interpolate:
        b = F.floor((x - low) / (high - low + 1e-8) * n).cast("long")
        return SegmentedBasis(b, TensorBasis((F.lit(1.0),)), n)
    u = F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), (x - low) / (high - low) * n - 0.5))
    hats = [F.greatest(F.lit(0.0), 1 - F.abs(u - b)) for b in range(n)]
    if smooth:
        waves = [F.pow(F.sin(h * (A.PI / 2)), F.lit(2.0)) for h in hats]
        total = sum(waves[1:], waves[0])
        hats = [w / total for w in waves]
    return TensorBasis(tuple(hats))


def polynomial(interval: Column, x: Column, lmin: int, lmax: int, intervals: int) -> Basis:
    """Legendre polynomials of x (already on [-1, 1]) in every interval; none between intervals (null)."""
    return SegmentedBasis(interval, legendre_basis(x, lmin, lmax), intervals)


def scan_synchronous(azimuth: Column, low: float, high: float, lmin: int, lmax: int) -> Basis:
    return legendre_basis(rescaled(azimuth, low, high), lmin, lmax)


def binaz_synchronous(azimuth: Column, low: float, high: float, n: int = 4, interpolate: bool = False, smooth: bool = False) -> Basis:
    return bin_basis(azimuth, low, high, n, interpolate, smooth)


def hwp_synchronous(angle: Column, harmonics: int = 3) -> Basis:
    return harmonic_basis(angle, harmonics)


def azhwp_synchronous(azimuth: Column, angle: Column, low: float, high: float, lmin: int = 0, lmax: int = 3, harmonics: int = 4, scan: Column | None = None) -> Basis:
    """Legendre polynomials of azimuth times harmonics; where `scan` is given, only on samples that it holds for."""
    basis = KroneckerBasis(scan_synchronous(azimuth, low, high, lmin, lmax), harmonic_basis(angle, harmonics, constant=True))
    return basis if scan is None else MaskedBasis(scan, basis)


def binazhwp_synchronous(azimuth: Column, angle: Column, low: float, high: float, n: int = 4, harmonics: int = 4, interpolate: bool = False) -> Basis:
    return KroneckerBasis(bin_basis(azimuth, low, high, n, interpolate), harmonic_basis(angle, harmonics, constant=True))


def temperature(leak: Column, axis: str = "samp", q: int = 1) -> Basis:
    """Leakage of a band-limited temperature signal; `leak` is a column of it, held over q samples where decimated."""
    return TensorBasis((leak if q == 1 else F.when(F.col(axis) == block(axis, q), leak).otherwise(0.0),))


def spline_blocks(x: Column, low: float, high: float, knots: int) -> tuple[Column, tuple[Column, ...], int]:
    """Offset, four weights and number of blocks of cubic splines over `knots` equal spans' ends (knots + 2 blocks)."""
    u = (x - low) * ((knots - 1) / (high - low)) if high > low else F.lit(0.0)
    offset = F.greatest(F.lit(0.0), F.least(F.lit(float(knots - 2)), F.floor(u)))
    part = u - offset
    weights = tuple(A.bspline(part + 3 - o) if high > low else F.lit(0.0) for o in range(4))
    return offset.cast("long"), weights, knots + 2


def bspline_hwpss(time: Column, low: float, high: float, knots: int, angle: Column, harmonics: tuple[int, ...] = (4,)) -> Basis:
    """Harmonics of the plate's angle whose amplitudes drift as cubic splines of time; at least two knots."""
    if knots < 2:
        raise ValueError("a spline needs two knots at least")
    offset, weights, blocks = spline_blocks(time, low, high, knots)
    waves = TensorBasis(tuple(f(angle * h) for h in harmonics for f in (F.sin, F.cos)))
    return WindowedBasis(offset, weights, waves, blocks)


def none() -> Basis:
    return TensorBasis(())


@dataclass(frozen=True, eq=False)
class Ground(Operator):
    """Pickup from the ground: a map over horizon pixels, seen through the rotating plate. Samples have pixel, angle columns."""

    samples: DataFrame
    pixel: str = "ground"
    angle: str = "chi"

    def apply(self, x):
        seen = self.samples.drop("v").join(x, self.pixel)
        return seen.withColumn("v", A.modulation(F.col("i"), F.col("q"), F.col("u"), F.col(self.angle))).drop("i", "q", "u")

    def transpose(self):
        return GroundTranspose(self)


@dataclass(frozen=True, eq=False)
class GroundTranspose(Operator):
    ground: Ground

    def apply(self, x):
        a = F.col(self.ground.angle) * 4
        return x.groupBy(self.ground.pixel).agg(F.sum("v").alias("i"), F.sum(F.col("v") * F.cos(a)).alias("q"), F.sum(F.col("v") * F.sin(a)).alias("u"))

    def transpose(self):
        return self.ground


def assemble(samples: DataFrame, bases: dict[str, Basis], by: tuple[str, ...] = ("det",)) -> dict[str, Template]:
    """The templates of one observation, by name; those without amplitudes are left out."""
    return {name: Template(basis, samples, by) for name, basis in bases.items() if basis.size}
