"""Domain tables from the driver's tables: time-ordered data, sky, sparse matrix, series.

`tod` adds row numbers to the event stream with one window by detector; everything else is a projection of a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NPIX = 48


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, obs, det, samp, t seconds, d, valid, pix, psi): one row for each sample."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    e = e.select("event_id", F.col("user_id").alias("det"), (F.row_number().over(order) - 1).cast("long").alias("samp"), ((micros - F.min(micros).over(Window.partitionBy("user_id"))) / 1e6).alias("t"), F.col("value").alias("d"), (F.col("event_type") != "error").alias("valid"))
    return e.select((F.col("event_id") % 4).alias("obs"), "*", ((F.col("event_id") * 31 + F.col("det") * 17) % NPIX).alias("pix"), (F.col("samp") * 0.37 + F.col("det") * 0.11).alias("psi"))


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pix, i, q, u, v): a Stokes map of one row for each part."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("pix"), (F.col("p_retailprice") / 1000).alias("i"), (F.col("p_size") / 50.0 - 0.5).alias("q"), F.sin(k.cast("double")).alias("u"), F.cos(k * 2.0).alias("v"))


def coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, val): a sparse matrix."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, k, v): the components of every vector, k from 0."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("k", "x")).select("id", F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("v"))


#: The same tables in SQL, for oracles.
SQL = {
    "tod": f"tod AS (SELECT event_id, event_id % 4 AS obs, user_id AS det, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS samp, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, value AS d, event_type <> 'error' AS valid, (event_id * 31 + user_id * 17) % {NPIX} AS pix, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 0.37::DOUBLE + user_id * 0.11::DOUBLE AS psi FROM events)",
    "sky": "sky AS (SELECT p_partkey AS pix, p_retailprice / 1000 AS i, p_size / 50.0::DOUBLE - 0.5 AS q, sin(p_partkey::DOUBLE) AS u, cos(p_partkey * 2.0::DOUBLE) AS v FROM part)",
    "coo": "coo AS (SELECT l_orderkey AS row_, l_partkey AS col_, l_quantity AS val FROM lineitem)",
    "series": "series AS (SELECT vec_id AS id, unnest(range(0, len(embedding)))::BIGINT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)",
}
