"""Landscapes: sets of pixels and the pixel of a direction or quaternion, as expressions. Pixel -1 is outside."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import angles as A


@dataclass(frozen=True)
class Landscape:
    stokes: str = "iqu"

    @property
    def size(self) -> int:
        raise NotImplementedError

    def pixel(self, theta: Column, phi: Column) -> Column:
        raise NotImplementedError

    def quat2pixel(self, q) -> Column:
        theta, phi, _ = A.iso_angles(q)
        return self.pixel(theta, phi)

    def coverage(self, seen: DataFrame, pixel: str = "pix") -> DataFrame:
        """(pix, hits) of every pixel, zeros included."""
        hits = seen.where(F.col(pixel) >= 0).groupBy(F.col(pixel).alias("pix")).agg(F.count("*").alias("hits"))
        return seen.sparkSession.range(self.size).select(F.col("id").alias("pix")).join(hits, "pix", "left").fillna(0, ["hits"])


@dataclass(frozen=True)
class Healpix(Landscape):
    nside: int = 1
    nested: bool = False

    def __post_init__(self):
        if self.nested:
            raise NotImplementedError("only RING order")

    @property
    def size(self) -> int:
        return 12 * self.nside**2

    def pixel(self, theta, phi):
        return A.ring_pixel(self.nside, F.cos(theta), phi)

    def quat2pixel(self, q):
        x, y, z = A.z_axis(q)
        return A.ring_pixel(self.nside, z, F.atan2(y, x))


@dataclass(frozen=True)
class FrequencyHealpix(Healpix):
    """HEALPix maps at several frequencies: a frequency's number times the pixels, plus the pixel."""

    frequencies: tuple[float, ...] = ()

    @property
    def size(self) -> int:
        return len(self.frequencies) * 12 * self.nside**2

    def index(self, band: Column, pixel: Column) -> Column:
        return F.when((pixel >= 0) & (band >= 0) & (band < len(self.frequencies)), band * (12 * self.nside**2) + pixel).otherwise(F.lit(-1)).cast("long")


@dataclass(frozen=True)
class Car(Landscape):
    lon0: float = 0.0
    step: float = 1.0
    nx: int = 360
    ny: int = 180

    @property
    def size(self) -> int:
        return self.nx * self.ny

    def pixel(self, theta, phi):
        return A.car_pixel(F.degrees(phi), F.degrees(F.lit(A.PI / 2) - theta), self.lon0, self.step, self.nx, self.ny)


@dataclass(frozen=True)
class Horizon(Landscape):
    """Azimuth by altitude; azimuth wraps."""

    n_az: int = 4
    n_alt: int = 1
    low: float = 0.0
    high: float = A.PI / 2

    @property
    def size(self) -> int:
        return self.n_az * self.n_alt

    def pixel(self, theta, phi):
        return A.horizon_pixel(-phi, F.lit(A.PI / 2) - theta, self.n_az, self.n_alt, self.low, self.high)

    def altitude_edges(self) -> list[float]:
        return [self.low + (self.high - self.low) * k / self.n_alt for k in range(self.n_alt + 1)]

    def altitude_centers(self) -> list[float]:
        edges = self.altitude_edges()
        return [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]

    def azimuth_centers(self) -> list[float]:
        return [2 * A.PI * k / self.n_az for k in range(self.n_az)]

    def azimuth_edges(self) -> list[float]:
        return [2 * A.PI * (k - 0.5) / self.n_az for k in range(self.n_az + 1)]


@dataclass(frozen=True)
class Tangential(Landscape):
    """A screen at a height over the site; intensity only."""

    stokes: str = "i"
    height: float = 1000.0
    step: float = 10.0
    nx: int = 1
    ny: int = 1

    @classmethod
    def from_extent(cls, height: float, step: float, width: float, depth: float) -> Tangential:
        return cls(height=height, step=step, nx=max(1, round(width / step)), ny=max(1, round(depth / step)))

    @property
    def size(self) -> int:
        return self.nx * self.ny

    def place(self, theta: Column, phi: Column) -> tuple[Column, Column]:
        """Where the direction meets the screen, in lengths."""
        r = F.tan(theta) * self.height
        return r * F.cos(phi), r * F.sin(phi)

    def pixel_at(self, x: Column, y: Column) -> Column:
        i, j = (F.rint(c / self.step + (n - 1) / 2).cast("long") for c, n in ((x, self.nx), (y, self.ny)))
        return F.when((i >= 0) & (i < self.nx) & (j >= 0) & (j < self.ny), j * self.nx + i).otherwise(F.lit(-1)).cast("long")

    def pixel(self, theta, phi):
        return self.pixel_at(*self.place(theta, phi))

    def neighbours(self, x: Column, y: Column) -> Column:
        return A.bilinear(x / self.step + (self.nx - 1) / 2, y / self.step + (self.ny - 1) / 2, self.nx, self.ny)


def local_pixels(pixels: DataFrame, size: int, pixel: str = "pix") -> DataFrame:
    """(pix, local): numbers from 0 in pixel order for the distinct pixels listed; negative ones are dropped, larger ones an error.

    Ranges of 2**20 pixels are numbered apart and put end to end, so no task holds more than one range.
    """
    listed = pixels.select(F.col(pixel).cast("long").alias("pix")).where("pix >= 0").distinct()
    if listed.where(F.col("pix") >= size).take(1):
        raise ValueError(f"pixels reach beyond {size}")
    ranges = listed.withColumn("range", F.shiftright("pix", 20))
    before = ranges.groupBy("range").count().withColumn("ahead", F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    number = F.row_number().over(Window.partitionBy("range").orderBy("pix")) - 1
    return ranges.join(F.broadcast(before), "range").select("pix", (F.coalesce("ahead", F.lit(0)) + number).cast("long").alias("local"))


def local_from_mask(mask: DataFrame, size: int, condition: str = "keep") -> DataFrame:
    return local_pixels(mask.where(condition), size)


def global2local(local: DataFrame, keys: DataFrame, pixel: str = "pix") -> DataFrame:
    """keys with their local number; what is not listed goes to the sink, the number after the last."""
    sink = local.agg(F.count("*").alias("__n"))
    return keys.join(local.withColumnRenamed("pix", pixel), pixel, "left").crossJoin(F.broadcast(sink)).withColumn("local", F.coalesce("local", "__n")).drop("__n")
