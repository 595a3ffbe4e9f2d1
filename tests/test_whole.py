"""Queries over the whole of what their operators take."""

from pyspark.sql import functions as F

from tessera.plans import catalog
from tessera.plans.catalog import Tables

SF = "/root/testdata/sf0.001"


def test_whole_queries_have_every_row(spark):
    t, run = Tables(spark, SF), catalog.queries()
    series, vec = t.series.count(), t.vec.count()
    for name in ("dense_block_diagonal", "dense_block_diagonal_transpose"):
        out = run[name](spark, SF)
        assert out.count() == series and out.agg(F.countDistinct("k")).first()[0] == 64
    assert run["tree_matmat"](spark, SF).count() == 64 * 64
    assert run["cg_diagonal"](spark, SF).count() == vec
