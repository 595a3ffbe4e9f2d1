"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges never come to the driver; each step is written to the shared folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches. Loops and repeated edges do no harm."""
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = durable(now, "edges")
    last = None
    while True:  # ends when a step changes nothing; the number of steps grows with the logarithm of the input
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = durable(small, "edges")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == last:
            break
        last = mark
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
