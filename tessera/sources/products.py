"""Map products: one Parquet table each, and a JSON table of facts. Works on any path that Spark writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

REQUIRED = ("map", "hit_map", "icov")


def save(folder: str, products: dict[str, DataFrame], facts: dict | None = None) -> None:
    for name, table in products.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    if facts is not None:
        spark = next(iter(products.values())).sparkSession
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/facts")


def load(spark: SparkSession, folder: str, names: tuple[str, ...] = REQUIRED) -> dict[str, DataFrame]:
    missing = set(REQUIRED) - set(names)
    if missing:
        raise ValueError(f"products {sorted(missing)} are mandatory")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
