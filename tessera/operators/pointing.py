"""Pointing on the fly: boresight quaternions times detector quaternions, pixels, gather, rotation; and the transpose.

Detectors are a short list by nature; they are broadcast only if a count says so. Maps are broadcast where the landscape has at
most `FEW` pixels, and joined by a shuffle beyond that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import angles as A
from tessera.functions.landscapes import Landscape, Tangential
from tessera.operators.linear import Operator

FEW = 1 << 18
QUAT = ("qa", "qb", "qc", "qd")


def rotation_z(angle) -> tuple:
    return A.euler(3, angle)


def pointed(landscape: Landscape, boresight: DataFrame, dets: DataFrame, frame: str = "detector", keys: tuple[str, ...] = ()) -> DataFrame:
    """Every sample of every detector: all columns of both, pix, psi and gamma (the detector's own angle).

    `boresight` and `dets` hold quaternions in qa..qd; they are joined on `keys` (as the observation), else all with all. With
    frame 'boresight' the detector's angle is taken out of psi.
    """
    if frame not in ("detector", "boresight"):
        raise ValueError(f"no frame {frame}")
    near = dets.select(*[c for c in dets.columns if c not in QUAT], *[F.col(c).alias(f"__{c}") for c in QUAT])
    if near.count() <= FEW:
        near = F.broadcast(near)
    rows = boresight.join(near, list(keys)) if keys else boresight.crossJoin(near)
    own = tuple(F.col(f"__{c}") for c in QUAT)
    gamma = F.atan2(own[3], own[0]) * 2
    q = A.qmul(tuple(map(F.col, QUAT)), own)
    if frame == "boresight":
        q = A.qmul(q, rotation_z(-gamma))
    out = rows.withColumns({"gamma": gamma, **dict(zip(QUAT, q, strict=True))})
    now = tuple(map(F.col, QUAT))
    return out.withColumns({"pix": landscape.quat2pixel(now), "psi": A.iso_angles(now)[2]}).drop(*QUAT, *[f"__{c}" for c in QUAT])


@dataclass(frozen=True, eq=False)
class Pointing(Operator):
    """A Stokes map (pix, i, q, u) to the Stokes parameters in the frame of each sample of `seen` (with pix and psi)."""

    landscape: Landscape
    seen: DataFrame

    @classmethod
    def create(cls, landscape: Landscape, boresight: DataFrame, dets: DataFrame, frame: str = "detector", keys: tuple[str, ...] = ()) -> Pointing:
        return cls(landscape, pointed(landscape, boresight, dets, frame, keys))

    def expanded(self) -> Pointing:
        """The same with pixels and angles computed once and kept, spilled to disk where memory ends."""
        return Pointing(self.landscape, self.seen.persist())

    def apply(self, x):
        sky = F.broadcast(x) if self.landscape.size <= FEW else x
        rows = self.seen.drop("i", "q", "u").join(sky, "pix")
        q, u = A.rotate_qu(F.col("q"), F.col("u"), F.col("psi"))
        return rows.withColumns({"q": q, "u": u})

    def transpose(self):
        return PointingTranspose(self)


@dataclass(frozen=True, eq=False)
class PointingTranspose(Operator):
    """Sums by pixel of the samples' Stokes parameters, turned back."""

    pointing: Pointing

    def apply(self, x):
        q, u = A.rotate_qu(F.col("q"), F.col("u"), -F.col("psi"))
        return x.where("pix >= 0").groupBy("pix").agg(F.sum("i").alias("i"), F.sum(q).alias("q"), F.sum(u).alias("u"))

    def transpose(self):
        return self.pointing


@dataclass(frozen=True, eq=False)
class Detector(Operator):
    """Stokes parameters to what a detector measures, v: a polariser at angle gamma, behind a rotating plate (angle chi) or not.

    Demodulated data are the Stokes parameters themselves, halved.
    """

    plate: bool = False
    demodulated: bool = False

    def _weights(self):
        if self.plate:  # polariser at gamma behind a plate at chi: the angle of polarisation is 2 chi - gamma
            a = F.col("chi") * 4 - F.col("gamma") * 2
        else:
            a = F.col("gamma") * 0.0
        return F.cos(a) * 0.5, F.sin(a) * 0.5

    def apply(self, x):
        if self.demodulated:
            q, u = A.rotate_qu(F.col("q"), F.col("u"), -F.col("gamma"))
            return x.withColumns({"i": F.col("i") * 0.5, "q": q * 0.5, "u": u * 0.5})
        c, s = self._weights()
        return x.withColumn("v", F.col("i") * 0.5 + F.col("q") * c + F.col("u") * s).drop("i", "q", "u")

    def transpose(self):
        return DetectorTranspose(self)


@dataclass(frozen=True, eq=False)
class DetectorTranspose(Operator):
    detector: Detector

    def apply(self, x):
        if self.detector.demodulated:
            q, u = A.rotate_qu(F.col("q"), F.col("u"), F.col("gamma"))
            return x.withColumns({"i": F.col("i") * 0.5, "q": q * 0.5, "u": u * 0.5})
        c, s = self.detector._weights()
        return x.withColumns({"i": F.col("v") * 0.5, "q": F.col("v") * c, "u": F.col("v") * s}).drop("v")

    def transpose(self):
        return self.detector


def acquisition(landscape: Landscape, boresight: DataFrame, dets: DataFrame, plate: bool = False, demodulated: bool = False, keys: tuple[str, ...] = ()) -> Operator:
    """The whole chain from a map to samples. Plates and demodulated data take the boresight's frame, others the detector's."""
    frame = "boresight" if plate or demodulated else "detector"
    return Detector(plate, demodulated) @ Pointing.create(landscape, boresight, dets, frame, keys)


def projected(landscape: Landscape, samples: DataFrame, dets: DataFrame) -> DataFrame:
    """Pixels of samplings (theta, phi, psi) for detector directions (x, y, z): the direction turned by Z(phi) Y(theta) Z(psi)."""
    turn = zyz(F.col("theta"), F.col("phi"), F.col("psi"))
    rows = samples.crossJoin(F.broadcast(dets) if dets.count() <= FEW else dets)
    d = (F.col("x"), F.col("y"), F.col("z"))
    x, y, z = (r[0] * d[0] + r[1] * d[1] + r[2] * d[2] for r in turn)
    return rows.withColumn("pix", landscape.pixel(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))), F.atan2(y, x)))


def zyz(theta, phi, psi) -> list[list]:
    """The matrix of a turn by psi about z, then theta about y, then phi about z."""
    ct, st, cp, sp, cs, ss = (f(a) for a in (theta, phi, psi) for f in (F.cos, F.sin))
    return [[cp * ct * cs - sp * ss, -cp * ct * ss - sp * cs, cp * st], [sp * ct * cs + cp * ss, cp * cs - sp * ct * ss, sp * st], [-st * cs, st * ss, ct]]


def direction(theta, phi) -> tuple:
    return F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta)


def rotation_matrix(q) -> list[list]:
    """The matrix of any quaternion, not only of unit ones; zero for a quaternion close to zero."""
    a, b, c, d = q
    n = a * a + b * b + c * c + d * d
    k = F.when(n > 1e-8, F.lit(2.0) / F.when(n > 1e-8, n)).otherwise(0.0)
    one = F.when(n > 1e-8, 1.0).otherwise(0.0)
    return [
        [one - k * (c * c + d * d), k * (b * c - a * d), k * (b * d + a * c)],
        [k * (b * c + a * d), one - k * (b * b + d * d), k * (c * d - a * b)],
        [k * (b * d - a * c), k * (c * d + a * b), one - k * (b * b + c * c)],
    ]


def turned(q, v) -> tuple:
    """The vector v turned by the quaternion q."""
    return tuple(sum((m * x for m, x in zip(r[1:], v[1:], strict=True)), r[0] * v[0]) for r in rotation_matrix(q))


def xieta(q) -> tuple:
    """xi, eta (minus the y and x of the z axis) and gamma, the turn about z left where the direction is the pole."""
    x, y, _ = A.z_axis(q)
    return -y, -x, F.atan2(q[3], q[0]) * 2


def drifted(screen: Tangential, samples: DataFrame, vx: float, vy: float, time: str = "t") -> DataFrame:
    """Pixels of a screen that the wind carries over the site; intensity is modulated by the airmass at the elevation."""
    x, y = screen.place(F.col("theta"), F.col("phi"))
    t = F.col(time)
    return samples.withColumns({"pix": screen.pixel_at(x + t * vx, y + t * vy), "airmass": F.lit(1.0) / F.cos(F.col("theta"))})
