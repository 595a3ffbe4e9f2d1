"""Observations as sources: fields by name, lazy handles, and a reader that keeps going where a file is broken.

An observation is a folder or file of Parquet with the columns of `FIELDS` (some may be missing). Asking for fields reads no
others; a handle knows its schema and number of rows from footers alone.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of each field that an observation can have.
FIELDS: dict[str, tuple[str, ...]] = {
    "sample_data": ("d",), "valid_sample_masks": ("valid",), "valid_scanning_masks": ("scanning",), "left_scan_mask": ("left_scan",), "right_scan_mask": ("right_scan",),
    "azimuth": ("az",), "elevation": ("el",), "timestamps": ("t",), "hwp_angles": ("chi",), "scanning_intervals": ("interval",),
    "detector_quaternions": ("det_qa", "det_qb", "det_qc", "det_qd"), "boresight_quaternions": ("qa", "qb", "qc", "qd"),
    "noise_model_fits": ("sigma", "alpha", "fk", "f0"), "metadata": ("obs", "telescope"),
}
KEYS = ("obs", "det", "samp")


class UnsupportedField(ValueError):
    """A field that observations do not have, or that this one has not."""


def columns_of(fields: Sequence[str] | None, have: Sequence[str]) -> list[str]:
    """Key columns and those of the fields; None: all there are; none: the keys."""
    if fields is None:
        return list(have)
    unknown = [f for f in fields if f not in FIELDS]
    if unknown:
        raise UnsupportedField(f"no such fields: {unknown}")
    wanted = [c for f in fields for c in FIELDS[f]]
    missing = sorted(set(wanted) - set(have))
    if missing:
        raise UnsupportedField(f"the observation has no {missing}")
    return [*[k for k in KEYS if k in have], *[c for c in dict.fromkeys(wanted) if c not in KEYS]]


@dataclass(frozen=True)
class LazyObservation:
    """A file that is read when it is asked for. Local paths must exist; others are looked for by Spark."""

    path: str

    def __post_init__(self):
        if "://" not in self.path and not os.path.exists(self.path):
            raise FileNotFoundError(self.path)

    @property
    def name(self) -> str:
        return os.path.splitext(os.path.basename(self.path.rstrip("/")))[0]

    def schema(self, spark: SparkSession) -> T.StructType:
        return spark.read.parquet(self.path).schema

    def data(self, spark: SparkSession, fields: Sequence[str] | None = None) -> DataFrame:
        table = spark.read.parquet(self.path)
        return table.select(*columns_of(fields, table.columns)).withColumn("observation", F.lit(self.name))

    def shape(self, spark: SparkSession) -> tuple[int, int]:
        """Upper bound of (detectors, samples): the number of rows, of which Parquet footers tell, and of key values."""
        table = spark.read.parquet(self.path)
        if {"det", "samp"} <= set(table.columns):
            low = table.agg(F.approx_count_distinct("det"), F.max("samp")).first()
            return int(table.select("det").distinct().count()), int(low[1] or -1) + 1
        return 1, table.count()


@dataclass
class Reader:
    """Reads observations one by one; a broken one becomes a row of `failures` instead of an end of the job."""

    observations: Sequence[LazyObservation | str]
    fields: Sequence[str] | None = None
    known_failures: frozenset[str] = frozenset()
    failed: dict[str, str] = field(default_factory=dict)

    def reset(self) -> None:
        self.failed.clear()

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows of those that can be read, with elapsed seconds from each one's own start where it has times."""
        parts = []
        for o in self.observations:
            try:
                o = LazyObservation(o) if isinstance(o, str) else o
                if o.name in self.known_failures:
                    raise OSError("known failure")
                part = o.data(spark, self.fields)
                part.limit(1).collect()  # broken files show here, not in the middle of the job
                parts.append(part)
            except UnsupportedField:
                raise
            except Exception as e:  # whatever a source throws is that observation's failure
                self.failed[o if isinstance(o, str) else o.name] = f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
        if not parts:
            raise OSError(f"no observation could be read: {self.failed}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return rebased(out, ("observation",)) if "t" in out.columns else out

    def failures(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.failed.items()), "observation string, reason string")


def rebased(table: DataFrame, by: tuple[str, ...], time: str = "t") -> DataFrame:
    """Times from the first of each group: the starts are one row for each group, so samples are not shuffled for them."""
    starts = table.groupBy(*by).agg(F.min(time).alias("__start"))
    return table.join(F.broadcast(starts), list(by)).withColumn(time, F.col(time) - F.col("__start")).drop("__start")


def all_failures(*tables: DataFrame) -> DataFrame:
    """The failures of several readers, each once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def random_sampling(hits: DataFrame, n: int, seed: int = 0, pixel: str = "pix") -> DataFrame:
    """(draw, pix): n pixels drawn in proportion to their hits, by the inverse of the cumulative sum.

    The cumulative sum is a table of one row for each pixel hit; draws meet it in a range join on buckets of the total.
    """
    from pyspark.sql import Window

    edge = F.sum("hits").over(Window.orderBy(pixel).rowsBetween(Window.unboundedPreceding, 0))
    table = hits.where("hits > 0").select(pixel, "hits", edge.alias("__to")).withColumn("__from", F.col("__to") - F.col("hits"))
    total = table.agg(F.max("__to").alias("n")).first().n
    if not total:
        raise ValueError("no pixel is hit")
    width = max(1.0, total / 4096)
    spread = table.withColumn("__k", F.explode(F.sequence(F.floor(F.col("__from") / width), F.floor((F.col("__to") - 1e-9) / width))))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11).cast("double") + 0.5) / float(1 << 53)
    draws = hits.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform * float(total)).alias("__u")).withColumn("__k", F.floor(F.col("__u") / width))
    return draws.join(spread, "__k").where("__u >= __from and __u < __to").select("draw", pixel)


def noise_sigma(depth, resolution):
    """Noise of a pixel from a map depth and the pixel's size, in the same angle unit."""
    return depth / resolution


def focal_plane(spark: SparkSession, n: int = 30, extent: float = 0.3) -> DataFrame:
    """(det, x, y, z): unit directions of an n by n grid of detectors, `extent` radians wide, around the z axis."""
    step = extent / max(1, n - 1)
    k = F.col("id")
    x, y = F.floor(k / n) * step - extent / 2, (k % n) * step - extent / 2
    r = F.sqrt(x * x + y * y + 1)
    return spark.range(n * n).select(k.alias("det"), (x / r).alias("x"), (y / r).alias("y"), (F.lit(1.0) / r).alias("z"))


def select_detectors(dets: DataFrame, wafer: str | None = None, band: str | None = None) -> DataFrame:
    if wafer is not None:
        dets = dets.where(F.col("wafer") == wafer)
    return dets if band is None else dets.where(F.col("band") == band)


def imported_noise(fits: DataFrame) -> DataFrame:
    """Noise fits as other tools write them, in this library's terms: alpha negative, a smallest frequency where none is given."""
    return fits.withColumns({"alpha": -F.col("alpha"), "f0": F.coalesce("f0", F.lit(1e-5))})


def half_power(samples: DataFrame, value: str = "d") -> DataFrame:
    """Temperature samples as power."""
    return samples.withColumn(value, F.col(value) * 0.5)


def identity_lookup(mapping: dict[str, str], key) -> object:
    """mapping[key], or the key itself where it is not there."""
    if not mapping:
        return key
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), key)


def intervals_of(samples: DataFrame, intervals: DataFrame, by: tuple[str, ...] = ("det",), axis: str = "samp") -> DataFrame:
    """samples with `interval`: the number of the last interval [start, end) that starts at or before the sample, null where
    the sample lies behind its end or before all. One as-of window: no product of samples and intervals."""
    from pyspark.sql import Window

    events = samples.withColumn("__f", F.lit(1)).withColumn("__iv", F.lit(None).cast("struct<start:bigint,end:bigint,interval:bigint>"))
    marks = intervals.select(*by, F.col("start").alias(axis), F.lit(0).alias("__f"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("interval").cast("long").alias("interval")).alias("__iv"))
    last = F.last("__iv", ignorenulls=True).over(Window.partitionBy(*by).orderBy(axis, "__f"))
    both = events.unionByName(marks, allowMissingColumns=True).withColumn("__last", last).where("__f = 1")
    return both.withColumn("interval", F.when(F.col(axis) < F.col("__last.end"), F.col("__last.interval"))).drop("__f", "__iv", "__last")
